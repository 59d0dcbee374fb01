"""Ids of whole texts by the `tokenizers` library, with each distinct word encoded once.

A byte-level BPE tokenizer cuts a text before every single space that stands between two other
characters, and merges never cross such a cut. So a text is the sequence of its words, each with its
space, and the library needs to see a word only once: its ids are then kept as bytes. Texts with runs of
white space are cut at the safe spaces only, which gives the same ids. The strings of added tokens
(such as `<|endoftext|>`) are cut out of a text first, as the library does, and stand for their own ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from quarry.llm.common import process_cache

#: Words that a worker keeps; beyond it the store starts anew. It bounds memory, results do not depend on it.
KEPT_WORDS = 1_000_000
#: Marks that a word may end with.
STOPS = ".,;:!?"
#: Characters of a text that are cut into words at once.
SLICE = 1 << 20


def encoder(path: str, kept: int = KEPT_WORDS) -> BpeEncoder:
    """This process's encoder for a tokenizer file."""
    held = process_cache("bpe")
    if path not in held:
        held[path] = BpeEncoder(path, kept)
    held[path].kept = kept
    return held[path]


def _safe(left: str, right: str) -> bool:
    return bool(left) and bool(right) and not left[-1].isspace() and not right[0].isspace()


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about `size` characters, each but the first starting with a safe space."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class BpeEncoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that take or need their surroundings aren't supported")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=lambda t: (-len(t), t)))) + ")")
        self.tokenizer.model._resize_cache(0)  # our own store is the larger one
        self.kept = kept
        self.words: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes] = {}
        self.stops = dict(zip(STOPS, self._encode(list(STOPS)), strict=True))
        vocabulary = self.tokenizer.get_vocab()
        self.n_ids = max(vocabulary.values()) + 1
        self.opens = np.zeros(self.n_ids, bool)  # ids whose piece starts with a space
        for piece, i in vocabulary.items():
            self.opens[i] = piece.startswith("Ġ")

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, needed: set[str]) -> None:
        new = needed.difference(self.words)
        if len(self.words) + len(new) > self.kept:
            self.words.clear()
            self.heads.clear()
            new = needed
        unsafe = {w for w in new if not w or len(w.strip()) < len(w)}
        self.words.update(dict.fromkeys(unsafe))
        # a stop after a letter is cut off the word before merges, so the word's own ids serve
        stopped = {w for w in new - unsafe if w[-1:] in self.stops and w[-2:-1].isalpha()}
        known = list(({w[:-1] for w in stopped}.difference(self.words) | new).difference(unsafe, stopped))
        if known:
            self._add(known)
        words, stops = self.words, self.stops
        words.update([(w, words[w[:-1]] + stops[w[-1]]) for w in stopped])

    def _add(self, known: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(known)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(known):
            raise ValueError("a word's ids don't start with its space")
        raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        self.words.update(zip(known, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    def _head(self, part: str) -> bytes:
        """The ids of a text's first word, which has no space before it."""
        if part not in self.heads:
            self._learn_heads({part})
        return self.heads[part]

    def _learn_heads(self, parts: set[str]) -> None:
        if new := list(parts.difference(self.heads)):
            self.heads.update(zip(new, self._encode(new), strict=True))

    def _merged(self, parts: list[str], opened: bool) -> bytes:
        """The ids of parts, some of which touch other white space; opened: a space stands before the first."""
        runs, run = [], [parts[0]]
        for left, right in zip(parts, parts[1:], strict=False):
            if _safe(left, right):
                runs.append(run)
                run = []
            run.append(right)
        runs.append(run)
        texts = [" " * (opened or i > 0) + " ".join(run) for i, run in enumerate(runs)]
        odd = [i for i, run in enumerate(runs) if len(run) > 1 or i == 0 and not opened or self.words.get(run[0]) is None]
        found = dict(zip(odd, self._encode([texts[i] for i in odd]), strict=True))
        return b"".join(found[i] if i in found else self.words[run[0]] for i, run in enumerate(runs))

    def _one(self, parts: list[str]) -> bytes:
        """parts: a text, cut at each space."""
        get = self.words.__getitem__
        if opened := len(parts) > 1 and not parts[0] and _safe("-", parts[1]):
            parts = parts[1:]
        elif len(parts) == 1:
            return self._head(parts[0]) if parts[0] else b""
        try:
            if opened:
                return b"".join(map(get, parts))
            if _safe(parts[0], parts[1]):
                return self._head(parts[0]) + b"".join(map(get, parts[1:]))
        except TypeError:  # a word beside other white space
            pass
        return self._merged(parts, opened)

    def ids(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, text in enumerate(texts) if any(mark in text for mark in self.added)]
        if not marked:
            return self._plain(texts)
        plain = list(texts)
        for i in marked:
            plain[i] = ""
        done = self._plain(plain)
        for i in marked:
            parts = self.cut.split(texts[i])  # text and mark in turn
            between = self._plain(parts[::2])
            done[i] = b"".join(between[k // 2] if k % 2 == 0 else self.added[part] for k, part in enumerate(parts))
        return done

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Of texts that hold no added token."""
        cut = [[text] if len(text) <= SLICE else list(slices(text)) for text in texts]
        done = []
        for group in cut:
            if len(group) > 1:  # a long text: the words of one slice at a time
                done.append(b"".join(self._batch([part])[0] for part in group))
            else:
                done.append(None)
        short = iter(self._batch([group[0] for group in cut if len(group) == 1]))
        return [next(short) if x is None else x for x in done]

    def _batch(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        self._learn(set().union(*(s[1:] for s in split)))
        self._learn_heads({s[0] for s in split})
        return [self._one(s) for s in split]

"""Token counts of a unigram tokenizer: Aho-Corasick matches and a count-only Viterbi search.

The tokenizer is a vocabulary of pieces with log scores. A text gets a space at its start, and each space becomes a
metaspace mark. Its segmentation is the best sum of scores; an automaton over the pieces lists, for each end position,
the pieces that end there, and dynamic programming keeps for each position the best score and the number of pieces, never
the pieces. Tie rules are those of the tokenizers library's unigram model: starts are visited in order and a later one
must be strictly better, so of equal sums the earliest start, the longest last piece, wins; a character that is no piece is
an unknown of the least score less 10, and a run of unknowns is one token, or, with byte fallback, a token for each byte.

No piece of more than marks has a mark inside, so the best path of a text is that of its words, each with the marks
before it. Scores are multiples of 1/1024, so sums are exact in doubles in any order, and a word's count is kept and used
again. Words are cut where a mark follows another character.

No public unigram file is at hand, and tokenizers are never trained: the vocabulary's pieces are those of
piece_bpe_32k.model, a piece's score is minus the logarithm of its rank, as in Zipf's law.

Defined results: null or empty text has no token; texts of any length are cut into words first; a word of any length
takes time in proportion to it; repeated rows get equal results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_columns, process_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 500_000
SLICE = 1 << 20

def vocabulary(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """((piece, score) by id, the unknown's id) of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = []
    for i in range(model.get_piece_size()):
        # control and byte pieces never match a text: they stay under every rank
        plain = not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
        pieces.append((model.id_to_piece(i), -round(1024 * math.log(i + 2)) / 1024 if plain else -16.0))
    return pieces, model.unk_id()


class Counter:
    """counts(texts): tokens of each text."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_fallback: bool = True, kept: int = KEPT_WORDS) -> None:
        import ahocorasick

        self.least = min(score for _, score in pieces)
        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in (0, 255))
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if i != unknown and piece:
                if MARK in piece.strip(MARK) or piece.rstrip(MARK) != piece and piece.strip(MARK):
                    raise ValueError(f"{piece!r} crosses words")
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = {piece for i, (piece, _) in enumerate(pieces) if i != unknown}
        self.words: dict[str, int] = {}
        self.kept = kept

    def _unknowns(self, word: str, start: int, stop: int) -> int:
        """Tokens of a run of unknown characters; a run that is itself a piece is that piece."""
        if word[start:stop] in self.pieces:
            return 1
        return len(word[start:stop].encode("utf-8", "surrogatepass")) if self.fallback else 1

    def word(self, word: str) -> int:
        """The number of tokens of a word with its marks."""
        n = len(word)
        found: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(word):
            found.setdefault(end + 1, []).append(match)
        score, count, unknown_from = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        lowest = self.least - UNKNOWN_PENALTY
        for end in range(1, n + 1):
            best, size = None, 0
            one = False
            for length, gain in sorted(found.get(end, ()), reverse=True):  # earliest start first
                got = score[end - length] + gain
                one = one or length == 1
                if best is None or got > best:
                    best, size = got, length
            if not one:
                got = score[end - 1] + lowest
                if best is None or got > best:
                    best, size = got, 0
            score[end] = best
            if size:
                count[end] = count[end - size] + 1
            else:  # the run of unknowns that ends here counts as a whole
                start = unknown_from[end] = unknown_from[end - 1] if unknown_from[end - 1] >= 0 else end - 1
                count[end] = count[start] + self._unknowns(word, start, end)
        return count[n]

    def counts(self, texts: list[str]) -> list[int]:
        out, words = [], self.words
        for text in texts:
            total, at = 0, 0
            while at < len(text):
                # a slice ends before a space that follows another character
                stop = at + SLICE
                while stop < len(text) and not (text[stop] in (" ", MARK) and text[stop - 1] not in (" ", MARK)):
                    stop += 1
                part = text[at:stop].replace(MARK, " ")
                first, *rest = part.split(" ")
                parts = [first, *rest] if at == 0 else rest
                if "" in parts:
                    parts = self._runs(part if at == 0 else part[1:])
                for w in set(parts).difference(words):
                    if len(words) >= self.kept:
                        words.clear()
                        words.update((x, self.word(MARK + x)) for x in set(parts))
                        break
                    words[w] = self.word(MARK + w)
                total += sum(map(words.__getitem__, parts))
                at = stop
            out.append(total)
        return out

    @staticmethod
    def _runs(part: str) -> list[str]:
        """Words less their first mark, where spaces stand together; part is less its first space."""
        out, start = [], 0
        text = " " + part
        for i in range(1, len(text)):
            if text[i] == " " and text[i - 1] != " ":
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return [w[1:].replace(" ", MARK) for w in out]


def _counted(model_file: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(counter.counts(texts), pa.int64()), pa.array(map(len, texts), pa.int64())],
                    ["doc_id", "n_tokens", "n_chars"],
                )

    return counted


def counter_of(model_file: str) -> Counter:
    """This process's counter of a vocabulary file."""
    held = process_cache("token counts")
    if model_file not in held:
        held[model_file] = Counter(*vocabulary(model_file))
    return held[model_file]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_chars and characters a token (null where there is none)."""
    rows = doc_columns(docs).mapInArrow(_counted(model_file), "doc_id long, n_tokens long, n_chars long")
    return rows.withColumn("chars_per_token", F.when(F.col("n_tokens") > 0, F.col("n_chars") / F.col("n_tokens")))

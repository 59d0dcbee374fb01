"""Benchmark decontamination: CGK embeddings, repeated bit sampling, exact edit verification.

The CGK walk reads a string of words with a pointer that moves on or stays by a random bit of (step, word); the word under it at
each step is the embedding's coordinate. Strings of few edits between them have embeddings of few differing
coordinates, so a sample of coordinates is equal with good chance. A word has one random number; a repetition has a random factor for each
step, and the sign of their product is the bit, so memory grows with the vocabulary alone. A repetition has its own sample too, and a
window of a document that equals an item's window in one repetition's sample is a candidate. Windows are as long as items, up to LONGEST words:
lengths go by classes in steps of about 1.5, and of an item windows of its class side by side, the last one and the middle one are indexed, so one of a long item's has
no more than its share of the edits; a document's windows start at every word.

Sampled coordinates are compared one after another over a whole batch of texts, so most windows leave after the first two.
A candidate is verified exactly: the least number of word edits that turn the item into some part of the text around it
(free start and end) must be at most (1 - similarity) of its words. `repetitions` is set for the recall that tests
measure (0.95 or more at the limit's edits).

The benchmark is a stated query set: it is written to the shared folder in blocks of about BLOCK_ITEMS items, and tasks read one block and index it. No item
passes through the driver, and a task holds one block's index.

An item of fewer words than the least class has too few coordinates to sample and room for one edit at most, so one of its halves is
untouched: its halves (all of it, where there is no room) are looked up as they are, and the candidates verified likewise.

Defined results: null or empty texts and items without words match nothing; equal items are all reported; repeated rows are reported each; an empty table or
benchmark gives an empty result; other columns are not read by contaminated() and pass decontaminate() unchanged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import doc_columns, fresh_dir, open_fs, process_cache
from quarry.llm.words import words

BLOCK_ITEMS = 20_000
LEAST = 8
#: Words of the longest window: the longer a walk, the less likely that edits leave its later coordinates alone.
LONGEST = 40
SAMPLED = 4
REPETITIONS = 16
SIMILARITY = 0.8
#: Coordinates that all classes share: drawn from these ranges.
FIRST, SECOND = (0, 3), (3, 8)
FACTOR = 1_000_003


def length_class(n: int) -> int:
    """The longest class that n >= LEAST words exceed by a quarter, so that windows at both ends differ, and that isn't over LONGEST."""
    size = LEAST
    while (more := size + size // 2) * 5 <= n * 4 and more <= LONGEST:
        size = more
    return size


def window_offsets(n: int, size: int) -> list[int]:
    """Where the windows of an item of n words start: side by side, the last, and one in the middle."""
    return sorted({*range(0, n - size + 1, size), n - size, (n - size) // 2})


def edits_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, end): the least edits between item and a part of text, and where that part ends; edits > most if none."""
    row = np.zeros(len(text) + 1, np.int32)
    steps = np.arange(len(text) + 1, dtype=np.int32)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # a word of the text left out costs one
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted, non-empty table."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Index:
    """The items of one block: words, random walks, and each repetition's sampled keys."""

    def __init__(self, items: list[tuple[int, str]], repetitions: int = REPETITIONS, similarity: float = SIMILARITY, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int32), int((1 - similarity) * len(ids) + 1e-9)))
        self.gap = len(self.vocabulary) + 1  # stands between texts
        longest = max((len(x[1]) for x in self.items), default=0)
        classes = sorted({length_class(len(x[1])) for x in self.items if len(x[1]) >= LEAST})
        self.short: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
        for n, (_, ids, most) in enumerate(self.items):
            if len(ids) < LEAST:
                half = len(ids) // 2 if most else 0
                for offset, part in [(0, ids[:half]), (half, ids[half:])]:
                    if len(part):
                        self.short[int(part[0])].append((n, offset, part.tolist()))
        self.short_first = np.isin(np.arange(self.gap + 1), list(self.short))
        self.margin = 2 * longest + 16
        steps = 2 * max(classes, default=0) + 16
        self.drawn = rng.integers(-(1 << 63), 1 << 63, self.gap + 1, np.int64)
        self.factors = rng.integers(-(1 << 62), 1 << 62, (repetitions, steps), np.int64) * 2 + 1
        self.first = [int(rng.integers(*FIRST)) for _ in range(repetitions)]
        self.second = [int(rng.integers(*SECOND)) for _ in range(repetitions)]
        self.rest = [{c: self._rest(rng, c) for c in classes} for _ in range(repetitions)]
        # all windows of a class: (item, offset) and the windows' words, each followed by the gap
        windows = {c: [(n, at) for n, (_, ids, _) in enumerate(self.items) if len(ids) >= LEAST and length_class(len(ids)) == c for at in window_offsets(len(ids), c)] for c in classes}
        texts = {c: np.full((len(own), c + steps), self.gap, np.int32) for c, own in windows.items()}
        for c, own in windows.items():
            for k, (n, at) in enumerate(own):
                texts[c][k, :c] = self.items[n][1][at : at + c]
        self.ones, self.twos, self.keys = [], [], []
        for r in range(repetitions):
            one, two = np.zeros(self.gap + 1, bool), [np.zeros(0, np.int64)]
            self.keys.append({})
            for c, own in windows.items():
                a, b, *more = self._walk(r, texts[c], [self.first[r], self.second[r], *self.rest[r][c]])
                one[a] = True
                two.append(a * FACTOR + b)
                key = two[-1].astype(np.uint64)
                for x in more:
                    key = key * np.uint64(FACTOR) + x.astype(np.uint64)
                found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for k, place in zip(key.tolist(), own, strict=True):
                    found[k].append(place)
                self.keys[r][c] = (np.unique(key), found)
            one[self.gap] = False
            self.ones.append(one)
            self.twos.append(np.unique(np.concatenate(two)))

    @staticmethod
    def _rest(rng: np.random.Generator, size: int) -> list[int]:
        low, high = SECOND[1], max(SECOND[1] + SAMPLED, int(1.4 * size))
        return sorted(rng.choice(np.arange(low, high), SAMPLED - 2, replace=False).tolist())

    def _walk(self, r: int, texts: np.ndarray, at: list[int]) -> list[np.ndarray]:
        """The words that the walks from the start of texts (windows, words) are at after each number of steps in `at`."""
        rows, out, drawn = np.arange(len(texts)), [], self.drawn[texts]
        p = np.zeros(len(texts), np.int64)
        for step in range(max(at) + 1):
            if step in at:
                out.append(texts[rows, p].astype(np.int64))
            p += drawn[rows, p] * self.factors[r, step] < 0
        return out

    def candidates(self, flat: np.ndarray) -> set[tuple[int, int]]:
        """(item, place in flat where it would start)."""
        found: set[tuple[int, int]] = set()
        usable = len(flat) - self.margin
        for i in np.flatnonzero(self.short_first.take(flat[:usable])).tolist() if self.short else ():
            found.update((n, i - offset) for n, offset, part in self.short[int(flat[i])] if flat[i : i + len(part)].tolist() == part)
        if not self.rest[0]:
            return found
        drawn = self.drawn.take(flat)
        for r, factors in enumerate(self.factors):
            p = np.arange(usable)
            for step in range(self.first[r]):
                p += drawn.take(p) * factors[step] < 0
            a = flat.take(p)
            start = np.flatnonzero(self.ones[r].take(a))
            p, a = p[start], a[start].astype(np.int64)
            for step in range(self.first[r], self.second[r]):
                p += drawn.take(p) * factors[step] < 0
            key = a * FACTOR + flat.take(p)
            near = _among(key, self.twos[r])
            start, p, key = start[near], p[near], key[near]
            for size, (sorted_keys, items) in self.keys[r].items():
                q, h, step = p.copy(), key.astype(np.uint64), self.second[r]
                for stop in self.rest[r][size]:
                    for now in range(step, stop):
                        q += drawn.take(q) * factors[now] < 0
                    h, step = h * np.uint64(FACTOR) + flat.take(q).astype(np.uint64), stop
                for i in np.flatnonzero(_among(h, sorted_keys)).tolist():
                    found.update((n, int(start[i]) - offset) for n, offset in items[int(h[i])])
        return found

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, edits, words of the item, word where the match ends), one for each item found."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        get, parts, starts, at = self.vocabulary.get, [], [0], 0
        gap = np.full(1, self.gap, np.int32)
        for text in texts:
            listed = words(text)
            parts += [np.fromiter(map(get, listed, repeat(0)), np.int32, len(listed)), gap]
            at += len(listed) + 1
            starts.append(at)
        flat, bounds = np.concatenate([*parts, np.full(self.margin, self.gap, np.int32)]), np.array(starts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, start in sorted(self.candidates(flat)):
            _, ids, most = self.items[n]
            for doc in {int(np.searchsorted(bounds, min(max(x, 0), at - 1), "right")) - 1 for x in (start, start + len(ids) // 2, start + len(ids) - 1)}:
                low, high = max(bounds[doc], start - most), min(bounds[doc + 1] - 1, start + len(ids) + most + 1)
                own = flat[low:high]
                if best.get((doc, n), (most + 1, 0))[0] == 0 or len(own) < len(ids) - most:
                    continue
                have, need = Counter(own.tolist()), Counter(ids.tolist())
                if sum(min(k, have[w]) for w, k in need.items()) < len(ids) - most:
                    continue  # so many words are missing that no alignment can do
                edits, end = edits_within(ids, own, most)
                if edits < best.get((doc, n), (most + 1, 0))[0]:
                    best[doc, n] = (edits, int(low - bounds[doc]) + end)
        for (doc, n), (edits, end) in best.items():
            out[doc].append((self.items[n][0], edits, len(self.items[n][1]), end))
        return out


@dataclass(frozen=True)
class Block:
    """A stored block of items; each process builds its own index of it."""

    uri: str
    repetitions: int
    similarity: float

    def index(self) -> Index:
        held = process_cache("decontamination")
        if self not in held:
            held.clear()
            held[self] = Index(self.items(), self.repetitions, self.similarity)
        return held[self]

    def items(self) -> list[tuple[int, str]]:
        from pyarrow import fs, parquet

        system, path = open_fs(self.uri)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        tables = [parquet.read_table(f.path, filesystem=system, partitioning=None) for f in found if f.path.endswith(".parquet")]
        rows = [row for t in tables for row in zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True)]
        return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def blocks(benchmark: DataFrame, repetitions: int, similarity: float, size: int = BLOCK_ITEMS) -> list[Block]:
    """The items, written to the shared folder, about `size` in each block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n, place = max(1, -(-items.count() // size)), fresh_dir(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).write.partitionBy("block").parquet(place)
    return [Block(f"{place}/block={k}", repetitions, similarity) for k in range(n)]


#: Characters of the texts that are looked through together.
BATCH_CHARS = 1 << 21


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first text's number, texts) of about BATCH_CHARS characters."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _hits(block: Block):
    names, kinds = ["doc_id", "item_id", "edits", "item_words", "end_word"], [pa.int64()] * 5

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.index()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[first + i], *hit) for first, group in _groups(texts) for i, found in enumerate(index.hits(group)) for hit in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repetitions: int = REPETITIONS) -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word: one row for each document and item that it holds; clean documents have none."""
    out = None
    for block in blocks(benchmark, repetitions, similarity):
        found = doc_columns(docs).mapInArrow(_hits(block), "doc_id long, item_id long, edits long, item_words long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(block: Block, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.index()
        for batch in batches:
            texts = batch.column(place).fill_null("").to_pylist()
            keep = [not found for _, group in _groups(texts) for found in index.hits(group)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repetitions: int = REPETITIONS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    for block in blocks(benchmark, repetitions, similarity):
        docs = docs.mapInArrow(_clean(block, docs.columns.index("text")), docs.schema)
    return docs

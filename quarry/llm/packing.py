"""Hierarchical multi-length packing of documents into sequences.

Each document's ids, with the end id, are routed by length: whole windows of the longest size first, then the rest to
the smallest tier (256, 512, 1024, 2048) that holds it; each tier has a stock of its own. Tiers are packed one after another, from long to short.
A window of a tier opens with the longest document of its stock; its gap is filled with the longest documents that fit, of its own tier and
then of shorter ones, and what then remains with the start of one document that is cut, whose rest goes to the tier of its new
length. So each window is full. When a partition's documents end, the last window is cut into powers of two, which need no padding.

The windows of a block are dealt into step groups of equal token numbers: those of one length, in order of attention
cost (sum of squared piece lengths), forward and backward in turn.

Packing is local to a partition of the input, so nothing is shuffled and memory is bounded by one block of documents;
sequence and step group numbers hold the partition's number above bit 33.

Defined results: null text is an empty document (the end id alone); a null doc_id is kept; repeated rows are separate
documents; documents of equal length keep their order; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.bpe import KEPT_WORDS, encoder
from quarry.llm.common import doc_columns

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 2_000_000
BATCH = 128
STEP_WINDOWS = 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step_group long"

#: A piece of document number `doc`: (doc, start, length).
Piece = tuple[int, int, int]


class Lengths:
    """Rests of documents by length, with the lengths in use as the bits of one integer."""

    def __init__(self) -> None:
        self.mask, self.rests = 0, {}

    def put(self, doc: int, start: int, length: int) -> None:
        self.rests.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        rests = self.rests[length]
        found = rests.pop()
        if not rests:
            self.mask &= ~(1 << length)
        return found

    def longest(self, most: int) -> int:
        """The greatest length in use up to `most`, or 0."""
        return max(0, (self.mask & ((1 << most + 1) - 1)).bit_length() - 1)

    def shortest(self, over: int) -> int:
        """The least length in use above `over`, or 0."""
        rest = self.mask >> over + 1
        return over + (rest & -rest).bit_length() if rest else 0


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, the pieces that are left): document i has lengths[i] > 0 ids."""
    windows, most, stocks = [], tiers[-1], {tier: Lengths() for tier in tiers}
    tier_of = [next(t for t in tiers if t >= n) for n in range(most + 1)]
    for doc, n in enumerate(lengths):
        whole = n // most * most
        windows += ([(doc, at, most)] for at in range(0, whole, most))
        if n > whole:
            stocks[tier_of[n - whole]].put(doc, whole, n - whole)
    for tier in reversed(tiers):
        own = stocks[tier]
        while first := own.longest(tier):
            window, gap = [(*own.take(first), first)], tier - first
            while gap:
                # shorter tiers hold nothing longer, so the first that has a fit has the best one
                fit = next((t for t in reversed(tiers) if t <= tier and stocks[t].longest(gap)), None)
                if fit:
                    n = stocks[fit].longest(gap)
                    window.append((*stocks[fit].take(n), n))
                    gap -= n
                elif cut := next((t for t in tiers if t <= tier and stocks[t].shortest(gap)), None):
                    n = stocks[cut].shortest(gap)
                    doc, start = stocks[cut].take(n)
                    window.append((doc, start, gap))
                    stocks[tier_of[n - gap]].put(doc, start + gap, n - gap)
                    gap = 0
                else:
                    return windows, window
            windows.append(window)
    return windows, []


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are distinct powers of two, longest first, that hold pieces in order."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            need, window = 1 << bit, []
            while need:
                doc, start, n = queue.pop()
                used = min(n, need)
                window.append((doc, start, used))
                need -= used
                if n > used:
                    queue.append((doc, start + used, n - used))
            out.append(window)
    return out


def step_groups(windows: list[list[Piece]], per_group: int = STEP_WINDOWS) -> list[int]:
    """A group for each window: groups hold windows of one length, equal in number and near in attention cost."""
    size = [sum(p[2] for p in w) for w in windows]
    cost = [sum(p[2] ** 2 for p in w) for w in windows]
    group, base = [0] * len(windows), 0
    for length in sorted(set(size), reverse=True):
        own = sorted((i for i in range(len(windows)) if size[i] == length), key=lambda i: (-cost[i], i))
        groups = -(-len(own) // per_group)
        for k, i in enumerate(own):
            turn, at = divmod(k, groups)
            group[i] = base + (groups - 1 - at if turn % 2 else at)
        base += groups
    return group


def _packed(tokenizer: str, end_id: int, tiers: tuple[int, ...], block_tokens: int, kept_words: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, kept_words), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes, int]] = []  # doc_id, ids, ids that went into earlier windows
        sequence, groups, waiting = 0, 0, 0

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence, groups, waiting
            windows, left = pack([len(raw) // 4 - used for _, raw, used in held], tiers)
            kept = []
            if last:
                windows += powers(left)
            else:  # what is left starts the next block
                kept = [(i, start, n) for i, start, n in left]
            rows, number = [], step_groups(windows)
            for w, window in enumerate(windows):
                offset, length = 0, sum(p[2] for p in window)
                for i, start, n in window:
                    doc_id, raw, used = held[i]
                    at = used + start
                    rows.append((doc_id, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(raw) // 4, base + sequence + w, offset, length, next((t for t in tiers if t >= length), length), base + groups + number[w]))
                    offset += n
            sequence += len(windows)
            groups += max(number, default=-1) + 1
            # a piece that is left runs to its document's end, as only starts are cut off
            held = [(held[i][0], held[i][1], held[i][2] + start) for i, start, _ in kept]
            waiting = sum(len(raw) // 4 - used for _, raw, used in held)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                made = enc.ids(batch.column(1).slice(at, BATCH).to_pylist())
                for doc_id, raw in zip(batch.column(0).slice(at, BATCH).to_pylist(), made, strict=True):
                    held.append((doc_id, raw + end, 0))
                    waiting += len(raw) // 4 + 1
                    if waiting >= block_tokens:
                        yield from block(False)
        yield from block(True)

    return packed


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: its document and place there, the crc32 of its ids, its sequence and place there, tier and step group."""
    return doc_columns(docs).mapInArrow(_packed(tokenizer, end_id, tiers, block_tokens, kept_words), SCHEMA)

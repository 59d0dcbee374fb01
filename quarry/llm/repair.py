"""Conversation structure repair: A* on the edit lattice.

A conversation's rows, in order of turn, are edited into role initials of the form (s?(ua)+)?: an optional system turn, then user and assistant
in turn. Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn) 5; a truncated row that isn't deleted adds 5, a blank or a
duplicate row must be deleted. A state of the lattice is (rows read, last initial), so there are four a row. The heuristic is a suffix sum: 2 for each
row that is still to come and must be deleted, and 2 for each truncated one, which costs a deletion at least. No edit of a row costs less than its
share, so the heuristic is consistent and a state's first visit is its cheapest.

The queue is keyed by (cost plus heuristic, audit), the audit being the edits' initials so far. Keys grow along a path, so of the cheapest ways to a state the one of the
ASCII-least audit comes first, and as two of them never are prefixes of one another, the least audit of the whole passes through the least
one of each state. An audit is a node of a tree with skip pointers: it takes constant memory, and two are compared in logarithmic time, so a
conversation of n rows takes O(n log n) steps.

Rows of a conversation are read as a sorted stream; one conversation is held at a time, as its repaired form is one value.

Defined results: null role and text are one space, as are a null conv_id or turn in the string that decides a row's damage; null turns come first; rows of one turn are
ordered by role and text; rows without a conv_id are one conversation, of null id; an initial is the role's first character, whatever follows it; repeated rows are
duplicates; an empty text is blank; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import process_cache

SPACE = " \t\n\x0b\x0c\r"
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CHARGE = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
#: The initial that must follow.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}

REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes stops away, 3 repeats, 4 makes the user speak."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    hurt = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return hurt.drop("col")


class Audit:
    """Edits' initials as a node of a tree; less is less as text."""

    __slots__ = ("depth", "jump", "letter", "up")

    def __init__(self, up: Audit | None, letter: str = "") -> None:
        self.up, self.letter = up or self, letter
        self.depth = up.depth + 1 if up else 0
        self.jump = self if up is None else up.jump.jump if up.depth - up.jump.depth == up.jump.depth - up.jump.jump.depth else up

    def at(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.up
        return node

    def __lt__(self, other: Audit) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.at(depth), other.at(depth)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up
        return "".join(reversed(letters))


def edits(last: str, initial: str, fault: int) -> Iterator[tuple[str, int, str]]:
    """(letter, cost, initial after it) of the edits of a row; a Rerole to what the row has already never pays."""
    yield "D", DELETE, last
    if fault in (BLANK, DUPLICATE):
        return
    charge, after = CHARGE if fault == TRUNCATED else 0, NEXT[last]
    if initial == after or (initial == SYSTEM and last == START):
        yield "K", charge, initial
    if initial != after:
        yield "R", charge + REROLE, after


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The least cost of a repair and, of the repairs that have it, the ASCII-least audit."""
    n = len(initials)
    rest = [*accumulate((0 if f == GOOD else DELETE for f in reversed(faults)), initial=0)][::-1]
    queue: list[tuple[int, Audit, int, str]] = [(rest[0], Audit(None), 0, START)]
    closed: set[tuple[int, str]] = set()
    while queue:
        key, audit, i, last = heappop(queue)
        if (i, last) in closed:
            continue
        if i == n and last in (START, ASSISTANT):
            return key, str(audit)
        closed.add((i, last))
        spent = key - rest[i]
        if i < n:
            for letter, cost, after in edits(last, initials[i], faults[i]):
                if (i + 1, after) not in closed:
                    heappush(queue, (spent + cost + rest[i + 1], Audit(audit, letter), i + 1, after))
        if (i, NEXT[last]) not in closed:
            heappush(queue, (key + INSERT, Audit(audit, "I"), i, NEXT[last]))
    raise AssertionError("deleting every row is a repair")


def repaired(roles: list[str], texts: list[str], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that the edits give."""
    last, rows = START, zip(roles, texts, strict=True)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        last = role[:1] if letter == "K" else NEXT[last]
        yield role if letter == "K" else ROLES[last], text


def fault_of(role: str, text: str, seen: set[bytes]) -> int:
    """The row's first fault; seen has digests of the conversation's earlier rows."""
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
    again, last = digest in seen, text.rstrip(SPACE)[-1:]
    seen.add(digest)
    return BLANK if not last else DUPLICATE if again else GOOD if last in ".!?" else TRUNCATED


def repair_one(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    seen: set[bytes] = set()
    faults = [fault_of(role, text, seen) for role, text in zip(roles, texts, strict=True)]
    initials = [role[:1] for role in roles]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(initials, faults)
    turned = [{"role": r, "text": t} for r, t in repaired(roles, texts, audit)]
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, turned


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    process_cache()
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    conv, held, began = None, ([], [], []), False

    def flushed() -> pa.RecordBatch:
        row = (conv, *repair_one(*held))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if began and conv_id != conv:
                yield flushed()
                held = ([], [], [])
            conv, began = conv_id, True
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if began:
        yield flushed()


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation of rows (conv_id, turn, role, text): its faults, the least cost, the audit, and the repaired turns."""
    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(_repaired, REPAIRED)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """repair() of damaged(): a row for every conv_id of the input, those that lost all rows with zeros."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = repair(damaged(conversations))
    whole = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), "repaired")

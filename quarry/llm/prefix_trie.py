"""Trie of conversation prefixes, by an external mergesort whose runs carry longest common prefixes (LCPs).

A conversation is a path: for each turn 16 bytes of the SHA-256 of role and text, and the number of words of its text. Equal paths are merged (a row
with their number and least conv_id), so a conversation that everybody has is one row. Distinct paths are dealt by range, and each task sorts its own:

1. Rows are cut into runs of RUN_BYTES, each sorted, each row with the number of turns that it shares with the one before it. Runs beyond MEMORY_BYTES go to the
   shared folder until they are merged.
2. A loser tree merges the runs. Each candidate has its LCP with the row last put out: the one that shares more is the lesser, whatever follows, and only where
   two share as much are turns compared, from the first that isn't shared on. So no shared turn is compared again.
3. The merged stream has the LCP of neighbours, so a stack of the open path is all that is held: a row closes the nodes deeper than its LCP, which are finished, and opens its own.

A node on the first or the last path of a task may have members in other tasks as well. Such nodes are put out as parts, at most two paths a task, and one task
adds the parts up from the deepest to the root; all other nodes are final when they close. A node's name is a chained hash of its turns, so parts of different tasks meet,
and a parent's least conv_id and the list of a node's ends are joined by it.

Ends of a node are hashed as a sorted stream, in constant memory; the digest of one node's ends can only be computed in order, by one task.

Defined results: rows of a null conv_id belong to no conversation and are left out; null turns come first; rows of one turn are ordered by their digest, so repeated rows are repeated
turns; null role or text is empty; a negative conv_id c borrows from the next multiple of twenty at or below it; a conversation is a value of 20 bytes a turn; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, fresh_dir, open_fs, process_cache, text_of

TOKEN = 16
TURN = TOKEN + 4
RUN_BYTES = 1 << 20
MEMORY_BYTES = 64 << 20
ROWS = 4096
ROOT = bytes(TOKEN)
NODES = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PARTS = f"{NODES}, words long, open boolean"

Row = tuple[bytes, int, int]  # path, conversations, least conv_id
Run = Iterator[tuple[int, Row]]  # LCP with the row before


def word_count(column: str) -> Column:
    return F.regexp_count(column, F.lit("[^\\x20\\x09-\\x0D]+"))


def tokens(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, token, words of every row."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.substring(digest, 1, 2 * TOKEN)).alias("token"), word_count("text").alias("words"))


def name_of(path: bytes, name: bytes = ROOT, start: int = 0) -> bytes:
    """The node's name: each turn's token hashed with the name of the node above."""
    for at in range(start, len(path), TURN):
        name = hashlib.sha256(name + path[at : at + TOKEN]).digest()[:TOKEN]
    return name


def borrowed_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % 4


def _paths(base_of: int):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache()
        head, lender, conv, own = [], None, None, []

        def flushed() -> tuple[int, bytes, bytes]:
            nonlocal head, lender
            lends = conv - conv % base_of
            if conv == lends:
                head, lender = own[:3], conv
            taken = borrowed_turns(conv)
            path = b"".join([*(head[:taken] if lender == lends else []), *own[taken:]])
            return conv, path, name_of(path)

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "end"])

        done: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            for conv_id, token, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is not None and conv_id != conv:
                    done.append(flushed())
                    own = []
                conv = conv_id
                own.append(token + words.to_bytes(4, "big"))
            if done:
                yield out(done)
                done = []
        if conv is not None:
            yield out([flushed()])

    return paths


def rebuilt(conversations: DataFrame, group: int = 20) -> DataFrame:
    """conv_id, path, end (the name of its last node) of every conversation, the first turns borrowed from the first of its group."""
    rows = tokens(conversations).withColumn("lender", F.col("conv_id") - F.pmod("conv_id", F.lit(group)))
    ordered = rows.repartition("lender").sortWithinPartitions("lender", "conv_id", F.asc_nulls_first("turn"), "token").select("conv_id", "token", "words")
    return ordered.mapInArrow(_paths(group), "conv_id long, path binary, end binary")


def shared_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """The number of turns at which both begin, start of them known."""
    at, least = start * TURN, min(len(a), len(b))
    while at < least and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(rows: list[Row]) -> Run:
    rows.sort()
    before = b""
    for row in rows:
        yield shared_turns(before, row[0]), row
        before = row[0]


def _stored(rows: list[Row], folder: str) -> Run:
    """The run, by way of a file in the shared folder, read a batch at a time and then deleted."""
    system, place = open_fs(folder)
    system.create_dir(place, recursive=True)
    path = f"{place}/{uuid.uuid4().hex}"
    run = list(sorted_run(rows))
    columns = zip(*((lcp, *row) for lcp, row in run), strict=True)
    data = pa.table(dict(zip(("lcp", "path", "n", "least"), (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)), strict=True)))
    with system.open_output_stream(path) as sink, pa.ipc.new_stream(sink, data.schema) as writer:
        writer.write_table(data, max_chunksize=ROWS)

    def read() -> Run:
        with system.open_input_stream(path) as source:
            for batch in pa.ipc.open_stream(source):
                for lcp, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield lcp, tuple(row)
        system.delete_file(path)

    return read()


class LoserTree:
    """Merges runs; every candidate has its LCP with the row last put out. An inner node has the run that lost there."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs, self.k, self.compared = runs, len(runs), 0
        self.heads = [next(r, None) for r in runs]
        self.lcp = [0] * self.k
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser's LCP becomes that with the winner."""
        first, second = self.heads[a], self.heads[b]
        if first is None or second is None:
            return second is None
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        x, y = first[1][0], second[1][0]
        shared = shared_turns(x, y, self.lcp[a])
        self.compared += shared - self.lcp[a] + 1
        less = x[shared * TURN : (shared + 1) * TURN] <= y[shared * TURN : (shared + 1) * TURN]
        self.lcp[b if less else a] = shared
        return less

    def _play(self, run: int) -> None:
        """From the run's leaf up: the loser stays, the winner goes on; at first, who finds a place empty waits there."""
        at, winner = (run + self.k) // 2, run
        while at:
            if self.losers[at] < 0:
                self.losers[at] = winner
                return
            if self._less(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Run:
        while self.k and (head := self.heads[run := self.losers[0]]) is not None:
            yield self.lcp[run], head[1]
            following = self.heads[run] = next(self.runs[run], None)
            self.lcp[run] = following[0] if following else 0
            self._play(run)


def merged(rows: Iterator[Row], folder: str, run_bytes: int = RUN_BYTES, memory_bytes: int = MEMORY_BYTES) -> Run:
    """All rows in order with their LCPs: runs in memory, those beyond memory_bytes in the folder."""
    runs: list[Run] = []
    held, size, kept = [], 0, 0

    def cut() -> None:
        nonlocal held, size, kept
        if kept + size > memory_bytes:
            runs.append(_stored(held, folder))
        else:
            runs.append(iter(list(sorted_run(held))))
            kept += size
        held, size = [], 0

    for row in rows:
        held.append(row)
        size += len(row[0]) + 100
        if size >= run_bytes:
            cut()
    if held:
        cut()
    yield from LoserTree(runs)


class Open:
    """A node whose subtree isn't whole yet."""

    __slots__ = ("children", "edge", "leaves", "least", "n", "name", "saved", "words")

    def __init__(self, name: bytes, words: int, edge: bool) -> None:
        self.name, self.words, self.edge = name, words, edge
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def meet(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n

    def take(self, leaves: int, saved: int) -> None:
        """A whole child's subtree."""
        self.children += 1
        self.leaves += leaves
        self.saved += saved

    def whole(self) -> tuple[int, int]:
        """Leaves and saved tokens of the whole subtree."""
        return self.leaves if self.children else 1, self.saved + (self.n - 1) * self.words


def nodes_of(run: Run) -> Iterator[tuple]:
    """Rows of PARTS from sorted paths: nodes as they close, those of the first and the last path as parts."""
    stack: list[Open] = []

    def close() -> tuple:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above:
            above.meet(node.least, node.n)
        leaves, saved = (node.leaves, node.saved) if node.edge else node.whole()
        if above and not node.edge:
            above.take(leaves, saved)
        return node.name, above.name if above else None, depth, node.least, node.n, node.children, leaves, saved, node.words, node.edge

    for lcp, (path, n, least) in run:
        first = not stack
        if first:
            stack.append(Open(ROOT, 0, True))
        while len(stack) - 1 > lcp:
            yield close()
        for at in range((len(stack) - 1) * TURN, len(path), TURN):
            stack.append(Open(name_of(path[: at + TURN], stack[-1].name, at), int.from_bytes(path[at + TOKEN : at + TURN], "big"), first))
        stack[-1].meet(least, n)
    for node in stack:
        node.edge = True
    while stack:
        yield close()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _fields(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _tries(folder: str, run_bytes: int, memory_bytes: int):
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(nodes_of(merged(rows, folder, run_bytes, memory_bytes)), _fields(PARTS))

    return tries


def summed(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of NODES from the parts of the tasks' first and last paths."""
    nodes: dict[bytes, Open] = {}
    place: dict[bytes, tuple[bytes | None, int]] = {}
    for name, parent, depth, least, n, children, leaves, saved, words, _ in parts:
        node = nodes.setdefault(name, Open(name, words, True))
        node.meet(least, n)
        node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
        place[name] = parent, depth
    for name in sorted(nodes, key=lambda x: -place[x][1]):
        node, (parent, depth) = nodes[name], place[name]
        leaves, saved = node.whole()
        if parent is not None:
            nodes[parent].take(leaves, saved)
        yield name, parent, depth, node.least, node.n, node.children, leaves, saved


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(summed(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), _fields(NODES))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """end, ends_sha256 of ids that come sorted by end and by value."""
    end, digest, done = None, hashlib.sha256(), []
    schema = _fields("end binary, ends_sha256 string")
    for batch in batches:
        for own, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own == end:
                digest.update(b",%d" % conv_id)
                continue
            if end is not None:
                done.append((end, digest.hexdigest()))
            end, digest = own, hashlib.sha256(b"%d" % conv_id)
        yield from _batches(iter(done), schema)
        done = []
    if end is not None:
        yield from _batches(iter([(end, digest.hexdigest())]), schema)


def ends(paths: DataFrame) -> DataFrame:
    """end, ends_sha256: SHA-256 of the conv_ids that end at a node, ascending, joined by commas."""
    return paths.select("end", "conv_id").repartition("end").sortWithinPartitions("end", "conv_id").mapInArrow(_hashed, "end binary, ends_sha256 string")


def trie(paths: DataFrame, run_bytes: int = RUN_BYTES, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """A row of NODES for each distinct prefix of the paths (conv_id, path, end); node and parent are names of nodes."""
    spark = paths.sparkSession
    distinct = cut_lineage(paths.groupBy("end").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("least")).select("path", "n", "least"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(distinct.repartitionByRange(tasks, "path").mapInArrow(_tries(fresh_dir(spark, "runs"), run_bytes, memory_bytes), PARTS))
    whole = parts.where("not open").drop("words", "open")
    return whole.unionByName(parts.where("open").repartition(1).mapInArrow(_summed, NODES))


def prefix_trie(conversations: DataFrame, group: int = 20, run_bytes: int = RUN_BYTES, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The trie of the rebuilt conversations: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = cut_lineage(rebuilt(conversations, group))
    nodes = cut_lineage(trie(paths, run_bytes, memory_bytes))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(parents, "parent", "left").join(ends(paths).withColumnRenamed("end", "node"), "node", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return named.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)

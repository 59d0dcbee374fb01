"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit where more than half of the XXH64 values of its shingles (A-Z lower-cased, words
between ASCII white space, space-joined, repeats included) have it. Fingerprints at `radius` or fewer differing bits are
linked, and components of links are classes.

Documents of equal fingerprints are one node. Nodes are dealt into shards: the 64 bits are cut into radius + 2 blocks, and
two fingerprints within the radius agree in at least two blocks, so each pair of blocks is a table, and each value of
its two blocks in it a shard. Whatever is linked meets in a shard. Each shard's distinct fingerprints form a BK-tree, children
keyed by their distance to the parent; all of them are then looked up in it at once, following only the edges within
the radius. A shard's tree is sent to the one task that has the shard's fingerprints, as all trees together grow with
the corpus and must not be broadcast. A shard hands on a spanning star of each of its classes, never all pairs.

A shard with over `tree_nodes` fingerprints is dealt out again by the other blocks: these are cut into radius + 1
parts, one of which two linked fingerprints share. What is still larger is dealt into blocks of about `tree_nodes`, and each two blocks
make a tree, so a tree is bounded whatever the fingerprints are.

Defined results: null or empty text, or text of white space alone, has fingerprint zero, which is linked like any other; a text with fewer
words than the shingle takes its whole sequence; component_id is the least doc_id of the class, nulls left out (null
if all are); repeated rows are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, doc_columns, process_cache
from quarry.llm.components import components

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: str, words: int = 3) -> int:
    """The text's SimHash, unsigned."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    last = min(words, len(parts)) - 1
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[last : last + n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        values = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache()
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    return each


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return doc_columns(docs).mapInArrow(_fingerprints(words), "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree of distinct 64-bit values under Hamming distance."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.children = values, {}
        todo = [(0, np.arange(1, len(values)))]  # a node and the values below it
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            distance = np.bitwise_count(values[below] ^ values[node])
            edges = self.children[node] = {}
            for d in np.unique(distance).tolist():
                under = below[distance == d]
                edges[d] = int(under[0])
                todo.append((edges[d], under[1:]))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within radius of it), following only edges that can lead there."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, asking = todo.pop()
            distance = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int16)
            if len(near := asking[distance <= radius]):
                yield node, near
            for d, child in self.children.get(node, {}).items():
                if len(rest := asking[np.abs(distance - d) <= radius]):
                    todo.append((child, rest))


def classes(values: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct value the number of the first value of its class."""
    label = np.arange(len(values))
    for node, near in BKTree(values).within(values, radius):
        met = np.unique(label[np.append(near, node)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that no run of one key (the first column) is divided."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if batch.num_rows else 0
        if held and batch.num_rows and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if cut:
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = []
        if batch.num_rows:
            held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in runs_of(batches):
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            starts, sizes = edges[:-1], np.diff(edges)
            bits = values.view(np.uint64)
            two = starts[sizes == 2]  # trees of a root and one child, all at once
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            left, right = [values[two]], [values[two + 1]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = values[start : start + size]
                label = classes(own.view(np.uint64), radius)
                linked = np.flatnonzero(label != np.arange(size))
                left.append(own[label[linked]])
                right.append(own[linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["u", "v"])

    return links


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(parts: int, width: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of near equal blocks."""
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shard_keys(fps: DataFrame, radius: int) -> DataFrame:
    """key, fp, chosen: one row for each table; chosen is the table's number, in order of block pairs."""
    keys = []
    for table, (a, b) in enumerate(combinations(_blocks(radius + 2), 2)):
        value = F.shiftleft(_part(F.col("fp"), *a), b[1]).bitwiseOR(_part(F.col("fp"), *b))
        keys.append(F.struct((value * 64 + table).alias("key"), F.lit(table).alias("chosen")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "fp", "k.chosen")


def refined(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of too large shards, dealt out again by parts of the bits that their table leaves open."""
    pairs = list(combinations(_blocks(radius + 2), 2))
    out = None
    for table, pair in enumerate(pairs):
        free = [low + i for low, width in _blocks(radius + 2) if (low, width) not in pair for i in range(width)]
        subs = []
        for j, (low, width) in enumerate(_blocks(radius + 1, len(free))):
            mask = sum(1 << bit for bit in free[low : low + width])
            subs.append(F.xxhash64("key", F.lit(j), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
        own = rows.where(F.col("chosen") == table).select(F.explode(F.array(*subs)).alias("key"), "fp", "chosen")
        out = own if out is None else out.union(own)
    return out


def in_cells(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one round of dealing, those of keys with over `most` of them once for each pair of blocks that their own is in."""
    sizes = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if not sizes.limit(1).count():
        return rows
    large = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    return rows.join(sizes, "key", "left_anti").union(large.select(F.explode(cells).alias("key"), "fp", "chosen"))


def links(fps: DataFrame, radius: int = 3, tree_nodes: int = 20_000) -> DataFrame:
    """u, v: edges whose components are those of all distinct fingerprints within the radius."""
    rows = shard_keys(fps, radius)
    hot = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes).select("key"))
    if hot.limit(1).count():
        rows = rows.join(hot, "key", "left_anti").union(in_cells(refined(rows.join(hot, "key", "left_semi"), radius), tree_nodes))
    sorted_rows = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tree_nodes: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    fps = cut_lineage(fingerprints(docs, words))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius, tree_nodes)).withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


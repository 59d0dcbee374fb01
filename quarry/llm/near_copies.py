"""Near copies by SimHash and BK-trees at a stated similarity: sets of five-word shingles with a Jaccard index of 0.8 or more.

At that similarity fingerprints (three-word shingles, 64 bits) differ in up to about a fifth of their bits and in more where lines repeat, so no distance
of theirs decides what is compared. Shards are keyed by content: each document goes to KEYS shards, one for the least of its shingles' hashes under each
of KEYS mixings; two documents of similarity 0.8 share none with chance 0.2 ** KEYS at most, and that is all that can be missed. Documents that have in a shard another whose
number of shingles allows the similarity, and those alone, bring their sets of shingles there. In the shard a BK-tree over the fingerprints finds pairs within
RADIUS bits, which are verified first; then every other pair that can be similar enough is found by the sets' rarest shingles and verified, if its documents aren't in one class yet.
A link is always an exact Jaccard index. Components of the links are classes.

Two sets of similarity s have an overlap of s times the larger one's size at least, so in any one order of all shingles they share one of each set's first
size - ceil(s size) + 1: these prefixes, rarest shingles first, are looked up, and no similar pair of the shard is passed over.

A shard hands on fewer links than it has documents. Sets move hashed to 64 bits a shingle.

A shard of over SHARD_ROWS documents is worked on in two rounds, and no task gets more than about two blocks of SHARD_ROWS. First it is dealt into blocks, each of which also
gets the shard's about PIVOTS pivots, so that the blocks of one large group of near copies are linked by these. Then its largest class and the rest are dealt into blocks, and
each block of the class meets each of the rest, and the rest's blocks each other: only documents of one class are never compared, so no pair of two classes is lost.
Where one class holds nearly all, this work grows as the shard; where many classes do, as its square over SHARD_ROWS.

Defined results: words and shingles are those of the fingerprints (A-Z lower-cased, ASCII white space); a text of fewer than five words is one
shingle; texts without words are one class; a null doc_id is no one's near copy; repeated rows are near copies of each other with one doc_id, so all stay or go; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, doc_columns, process_cache
from quarry.llm.components import components
from quarry.llm.simhash import BKTree, fingerprint, runs_of

WORDS = 5
SIMILARITY = 0.8
RADIUS = 13
KEYS = 4
SHARD_ROWS = 2000
PIVOTS = 16
SEED = 42


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(1, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def mixers(keys: int) -> np.ndarray:
    """Odd factors; a product's order is that of a mixing of the hashes."""
    return np.random.default_rng(SEED).integers(1, 1 << 63, keys, np.uint64) | np.uint64(1)


def shard_keys(hashes: np.ndarray, keys: int = KEYS) -> np.ndarray:
    least = np.array([(hashes * f).min() for f in mixers(keys)], np.uint64)
    return (least ^ np.arange(1, keys + 1, dtype=np.uint64)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    process_cache()
    for batch in batches:
        ids, sizes, keys = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = shingles(text.as_py())
            ids.append(doc_id)
            sizes.append(len(own))
            keys.append(shard_keys(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))], ["doc_id", "size", "keys"])


def neighbours(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents of one fingerprint, documents within the radius of it, these included), by a BK-tree of the distinct fingerprints."""
    values, of = np.unique(fps, return_inverse=True)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(values) + 1))
    for node, near in BKTree(values).within(values, radius):
        yield order[edges[node] : edges[node + 1]], np.concatenate([order[edges[q] : edges[q + 1]] for q in near.tolist()])


def _flagged(similarity: float):
    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, ids in runs_of(batches):
            # in order of size, whoever fits any of its shard fits the next one or the one before
            fit = (keys[1:] == keys[:-1]) & (sizes[:-1] >= similarity * sizes[1:])
            hit = np.zeros(len(keys), bool)
            hit[:-1] |= fit
            hit[1:] |= fit
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(keys[hit])], ["doc_id", "key"])

    return flagged


def prefix_candidates(hashes: list[np.ndarray], similarity: float, met_by_all: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(a set, sets before it that share a shingle of both prefixes): every pair of the similarity is among them.

    With met_by_all only the first so many sets are met, by each other and by the rest."""
    size = np.array([len(h) for h in hashes])
    _, of, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(hashes)), size)
    order = np.lexsort((rank[of], owner))
    nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    prefix = order[(nth < (size - np.ceil(similarity * size - 1e-9) + 1)[owner]) & (counts[of[order]] > 1)]
    starts = np.searchsorted(owner[prefix], np.arange(len(hashes) + 1))
    postings: dict[int, list[int]] = {}
    for a in range(len(hashes)):
        met: set[int] = set()
        for token in of[prefix[starts[a] : starts[a + 1]]].tolist():
            own = postings.setdefault(token, [])
            met.update(own)
            if met_by_all is None or a < met_by_all:
                own.append(a)
        if met:
            yield a, np.array(sorted(met))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)  # doc_id, text, root, keys
            texts = part.column(1).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.array([shingles(t).tobytes() for t in texts], pa.binary()), *part.columns[2:]], ["doc_id", "fp", "hashes", "root", "keys"])


def _linked(radius: int, similarity: float):
    def shard(later: list[bool], ids: list[int], fps: list[int], sets: list[bytes], roots: list[int]) -> Iterator[tuple[int, int]]:
        if len(ids) < 2:
            return
        hashes, label = [np.frombuffer(s, np.uint64) for s in sets], np.unique(roots, return_inverse=True)[1]
        if label.max() == 0:
            return
        size = np.array([len(h) for h in hashes])

        def verified(a: int, near: np.ndarray) -> Iterator[tuple[int, int]]:
            # by size alone, sets of other ratios can't be similar enough
            fit = near[(np.minimum(size[near], size[a]) >= similarity * np.maximum(size[near], size[a])) & (label[near] != label[a])]
            for b in fit.tolist():
                if label[a] != label[b] and jaccard(hashes[a], hashes[b]) >= similarity:
                    label[label == label[b]] = label[a]
                    yield ids[a], ids[b]

        if len(ids) > 2:
            for own, near in neighbours(np.array(fps, np.int64).view(np.uint64), radius):
                for a in own.tolist():
                    yield from verified(a, near)
            for a, near in prefix_candidates(hashes, similarity, len(later) - sum(later)):
                yield from verified(a, near)
        else:
            yield from verified(0, np.array([1]))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, ([], [], [], [], []), []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += shard(*held)
                    key, held = k, ([], [], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                out = []
        out += shard(*held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    return linked


def _links(rows: DataFrame, dealt: DataFrame, similarity: float, radius: int) -> DataFrame:
    """u, v: links inside shards; dealt has doc_id, key (the shard), later (documents that aren't compared with each other), root (the class so far)."""
    asked = dealt.groupBy("doc_id").agg(F.max("root").alias("root"), F.collect_set(F.struct("key", "later")).alias("keys"))
    sets = rows.join(cut_lineage(asked), "doc_id").mapInArrow(_sets, "doc_id long, fp long, hashes binary, root long, keys array<struct<key:long,later:boolean>>")
    met = sets.select(F.explode("keys").alias("k"), "doc_id", "fp", "hashes", "root").select("k.key", "k.later", "doc_id", "fp", "hashes", "root")
    return met.repartition("key").sortWithinPartitions("key", "later", "doc_id").mapInArrow(_linked(radius, similarity), "u long, v long")


def first_round(hot: DataFrame, shard_rows: int) -> DataFrame:
    """Documents of large shards (doc_id, key, n) in blocks, pivots in all of them."""
    blocks = F.ceil(F.col("n") / shard_rows).cast("int")
    pivot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("n")) < PIVOTS
    own = F.array(F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    cells = F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(own)
    return hot.select("doc_id", "key", F.explode(cells).alias("block")).select("doc_id", F.xxhash64("key", "block").alias("key"))


def second_round(hot: DataFrame, found: DataFrame, shard_rows: int) -> DataFrame:
    """doc_id, key, later, root: documents of large shards that hold several classes, in cells where those of different classes meet."""
    rooted = hot.join(found.select(F.col("u").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "key", F.coalesce("root", "doc_id").alias("root"))
    rooted = cut_lineage(rooted)
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("n")).where(F.col("n") > F.col("x.m"))
    blocks = lambda rows: F.ceil(rows / shard_rows).cast("int")
    largest = largest.select("key", F.col("x.root").alias("most"), blocks(F.col("x.m")).alias("outer"), blocks(F.col("n") - F.col("x.m")).alias("inner"))
    dealt = rooted.join(largest, "key").withColumn("later", F.col("root") == F.col("most"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("later"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    dealt = dealt.withColumn("own", own)
    across = F.transform(F.sequence(F.lit(0), F.when(F.col("later"), F.col("inner")).otherwise(F.col("outer")) - 1), lambda k: F.when(F.col("later"), F.xxhash64("key", F.lit("x"), "own", k)).otherwise(F.xxhash64("key", F.lit("x"), k, "own")))
    among = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda k: F.xxhash64("key", F.lit("i"), F.least("own", k), F.greatest("own", k)))
    cells = F.when(F.col("later"), across).otherwise(F.concat(across, among))
    return dealt.select("doc_id", F.explode(cells).alias("key"), "later", "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """u, root: documents that have a near copy of lesser id, with the least id of their class."""
    rows = doc_columns(docs).where("doc_id is not null")
    signed = cut_lineage(rows.mapInArrow(_signed, "doc_id long, size long, keys array<long>"))
    spread = signed.select(F.explode("keys").alias("key"), "size", "doc_id")
    large = cut_lineage(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows))
    several = bool(large.limit(1).count())
    small = spread.join(large, "key", "left_anti") if several else spread
    dealt = small.select("key", "size", "doc_id").repartition("key").sortWithinPartitions("key", "size").mapInArrow(_flagged(similarity), "doc_id long, key long")
    hot = spread.join(large, "key").select("doc_id", "key", "n")
    if several:
        dealt = dealt.unionByName(first_round(hot, shard_rows))
    own_classes = dealt.withColumns({"later": F.lit(False), "root": F.col("doc_id")})
    if not several:
        return components(_links(rows, own_classes, similarity, radius))
    links = cut_lineage(_links(rows, own_classes, similarity, radius))
    rest = second_round(hot, components(links), shard_rows)
    return components(links.unionByName(_links(rows, rest, similarity, radius)))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, but for near copies of a document of lesser id."""
    return docs.join(classes(docs, similarity, radius).select(F.col("u").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)

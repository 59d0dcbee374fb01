"""Near copies by SetSketch registers: sets of three-word shingles whose Jaccard index is at least a stated share.

A register of a set is the least of its elements' exponential values, on a logarithmic scale: floor(1 - log_BASE(value)), cut to 0 .. LIMIT. An element's values are a
Poisson process whose points fall on registers at random, so every register gets independent exponentials, and only the points below the largest of all registers
need to be made. Registers of a union are the larger ones, register by register (`merged`), they give the set's size (`cardinality`), and two sets' registers agree with a chance of about their
Jaccard index, as BASE is near to 1.

1. Equal sets are one node (128 bits of a set's sorted hashes), with the least doc_id. Sketches are made in one pass.
2. BANDS bands of BAND registers each are hashed. Two sets of similarity 0.85 share no band with a chance of (1 - 0.85 ** 5) ** 32 = 7e-9, which is all that can be missed here.
3. Nodes that share a band with another bring their registers there. The Jaccard index of two of them is the one of greatest likelihood, given how many registers
   are greater, less and equal, and given both sizes (`joint_estimate`). Pairs within SLACK standard errors of the limit are candidates; a node of a band's class of candidates needs no second link to it.
   SLACK = 6 loses a pair at the limit with a chance of 1e-9.
4. Each class of candidates is then verified on full sets, which are moved once for each node: two sets are compared unless they are in one class already. A link is an exact Jaccard index.
   Components of links are classes.

A band's or a class's rows over GROUP_ROWS (or of that many thousand shingles) are dealt as in near_copies: blocks that each hold some pivots, then what isn't in the largest class against blocks of it and of
the rest, so no task holds a whole large group and no pair of two classes is passed over. A group whose members are all near the limit but in many classes costs its square over GROUP_ROWS.

Defined results: words are runs of characters other than ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle; a null or empty text, or one of white space
alone, has the empty set and is linked with nothing; a null doc_id is linked with nothing (component_id null, not kept); rows of one doc_id are one document, linked with what any of them is;
repeated rows are kept as rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, doc_columns, process_cache
from quarry.llm.components import components
from quarry.llm.near_copies import first_round, second_round

WORDS = 3
SEED = 42
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
BANDS, BAND = 32, 5
REGISTERS = BANDS * BAND
SLACK = 6.0
GROUP_ROWS = 2000
#: Documents that are sketched at once, and hashes.
TEXTS, ELEMENTS = 512, 1 << 19


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order; none of a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """The registers of each set, a row each; the empty set's are 0.

    An element's next point of the process comes after an exponential time of the rate registers x RATE. Elements go on in rounds, until their time is beyond every register of their set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    least = np.full(len(sets) * registers, np.inf)
    time, step = np.zeros(len(elements)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(elements):
            step += np.uint64(1)
            draw = mixed(elements + step * np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (RATE * registers)
            place = owner * registers + (mixed(draw ^ np.uint64(SEED)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(least, place, time)
            rest = time < least.reshape(-1, registers).max(1)[owner]
            elements, owner, time = elements[rest], owner[rest], time[rest]
    scaled = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(scaled, 0, LIMIT).astype(np.uint16).reshape(-1, registers)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def cardinality(sketch: np.ndarray) -> float:
    """The estimated size of the set."""
    return len(sketch) * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -sketch.astype(np.float64)))


def likelihood_slope(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """The slope at j of the likelihood's logarithm, for pairs of sets of sizes a and b and Jaccard index j, of whose registers so many of the first are greater than, less than and equal
    to the second's.

    A register of the first is the greater one with the chance p(u - v j), of the second with p(v - u j), where u and v are the shares of the sizes in their sum."""
    u, v = a / (a + b), b / (a + b)
    k = (BASE - 1) / BASE
    x, y = u - v * j, v - u * j
    p, q = -np.log1p(-x * k) / np.log(BASE), -np.log1p(-y * k) / np.log(BASE)
    dp, dq = -v * k / ((1 - x * k) * np.log(BASE)), -u * k / ((1 - y * k) * np.log(BASE))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(greater > 0, greater * dp / p, 0) + np.where(less > 0, less * dq / q, 0) - np.where(equal > 0, equal * (dp + dq) / (1 - p - q), 0)


def joint_estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard index of greatest likelihood: the likelihood's logarithm is concave, so its slope is bisected."""
    low, high = np.zeros(len(a)), np.minimum(a / b, b / a)
    for _ in range(30):
        j = (low + high) / 2
        up = likelihood_slope(greater, less, equal, a, b, j) > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    weights = np.random.default_rng(SEED).integers(1, 1 << 63, REGISTERS, np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        sums = (mixed(sketch.astype(np.uint64) + weights) * weights).reshape(-1, BANDS, BAND).sum(2, dtype=np.uint64)
        return mixed(sums + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    process_cache()

    def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        regs = [row.tobytes() for row in sketches(sets)]
        sizes = [len(s) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "size", "name", "registers"])

    for batch in batches:
        ids, sets, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            sets.append(shingles(text.as_py()))
            held += len(sets[-1])
            if len(sets) == TEXTS or held >= ELEMENTS:
                yield out(ids, sets)
                ids, sets, held = [], [], 0
        if sets:
            yield out(ids, sets)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        ids = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(np.asarray(batch.column(1)), BANDS), pa.int64()), pa.array(keys.ravel(), pa.int64())], ["doc_id", "size", "key"])


#: (sizes, payloads, one's place, others' places) to which of the others it is linked with.
Test = Callable[[np.ndarray, list[np.ndarray], int, np.ndarray], np.ndarray]


def estimated(similarity: float, slack: float = SLACK) -> Test:
    """Whether the likeliest Jaccard index is within slack standard errors of the similarity: whether the likelihood rises there, as it has one peak."""
    least = similarity - slack * (similarity * (1 - similarity) / REGISTERS) ** 0.5

    def test(sizes: np.ndarray, payload: list[np.ndarray], a: int, near: np.ndarray) -> np.ndarray:
        others = np.stack([payload[b] for b in near.tolist()])
        greater, less = (payload[a] > others).sum(1), (payload[a] < others).sum(1)
        return likelihood_slope(greater, less, REGISTERS - greater - less, float(sizes[a]), sizes[near].astype(np.float64), least) >= 0

    return test


def verified(similarity: float) -> Test:
    """Whether sets have the similarity: 100 x the intersection's size is 100 x similarity x the union's at least, in whole numbers."""
    percent = round(100 * similarity)

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    return lambda sizes, payload, a, near: np.array([similar(payload[a], payload[b]) for b in near.tolist()], bool)


def linked(later: np.ndarray, ids: list[int], label: np.ndarray, payload: list[np.ndarray], sizes: np.ndarray, similarity: float, test: Test, step: int) -> Iterator[tuple[int, int]]:
    """Links whose components are those of all pairs that pass the test, but for pairs of later rows. Rows of one label are in one class already.

    Each meets those before it in size whose size allows the similarity, step at a time; whoever has come into its class meanwhile isn't tested."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    for place, a in enumerate(order.tolist()):
        near = order[np.searchsorted(ranked, int(np.ceil(similarity * sizes[a] - 1e-9))) : place]
        near = near[label[near] != label[a]]
        near = near[~later[near]] if later[a] else near
        while len(near):
            asked, near = near[:step], near[step:]
            hits = asked[test(sizes, payload, a, asked)]
            for b in hits.tolist():
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    yield ids[a], ids[b]
            if len(hits):
                near = near[label[near] != label[a]]


def _linked(kind: type, similarity: float, test: Test, step: int):
    def group(held: tuple[list, ...]) -> Iterator[tuple[int, int]]:
        sizes, later, ids, roots, raw = held
        label = np.unique(roots, return_inverse=True)[1]
        if len(ids) > 1 and label.any():
            yield from linked(np.array(later, bool), ids, label, [np.frombuffer(x, kind) for x in raw], np.array(sizes), similarity, test, step)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache()
        key, held, pairs = None, ([], [], [], [], []), []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    pairs += group(held)
                    key, held = k, ([], [], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["u", "v"])
                pairs = []
        if pairs := list(group(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["u", "v"])

    return each


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, more to doc_id, size, payload, more."""
    process_cache()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(text.as_py()) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[2:]], ["doc_id", "size", "payload", "root", "keys"])


Bring = Callable[[DataFrame], DataFrame]


def grouped_classes(members: DataFrame, bring: Bring, each: Callable, group_rows: int) -> DataFrame:
    """u, root: the classes that links inside groups make. members: doc_id, size, key (the group); bring adds size and payload to doc_id, root, keys."""

    def links(dealt: DataFrame) -> DataFrame:
        asked = dealt.groupBy("doc_id").agg(F.max("root").alias("root"), F.collect_set(F.struct("key", "later")).alias("keys"))
        met = bring(cut_lineage(asked)).select(F.explode("keys").alias("k"), "size", "doc_id", "root", "payload").select("k.key", "size", "k.later", "doc_id", "root", "payload")
        return met.repartition("key").sortWithinPartitions("key").mapInArrow(each, "u long, v long")

    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where("n > 1")
    counts = cut_lineage(counts.select("key", F.greatest(F.col("n"), F.ceil(F.col("w") / 1000)).cast("long").alias("n")))
    apart = {"later": F.lit(False), "root": F.col("doc_id")}
    dealt = members.join(counts.where(F.col("n") <= group_rows), "key").select("doc_id", "key")
    hot = members.join(counts.where(F.col("n") > group_rows), "key").select("doc_id", "key", "n")
    if not counts.where(F.col("n") > group_rows).limit(1).count():
        return components(links(dealt.withColumns(apart)))
    first = cut_lineage(links(dealt.unionByName(first_round(hot, group_rows)).withColumns(apart)))
    return components(first.unionByName(links(second_round(hot, components(first), group_rows))))


def near_duplicates(docs: DataFrame, similarity: float = 0.85, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    texts = doc_columns(docs)
    rows = cut_lineage(texts.mapInArrow(_sketched, "doc_id long, size long, name binary, registers binary"))
    known = rows.where("doc_id is not null and size > 0")
    nodes = cut_lineage(known.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("registers").alias("payload")))
    bands = nodes.select("doc_id", "size", "payload").mapInArrow(_banded, "doc_id long, size long, key long")
    registers = nodes.select("doc_id", "size", "payload")
    maybe = cut_lineage(grouped_classes(bands, lambda asked: asked.join(registers, "doc_id"), _linked(np.uint16, similarity, estimated(similarity), 256), group_rows))
    of_class = maybe.select(F.col("u").alias("doc_id"), F.col("root").alias("key")).union(maybe.select("root", "root").distinct())
    sized = of_class.join(nodes.groupBy("doc_id").agg(F.max("size").alias("size")), "doc_id").select("doc_id", "size", "key")

    def sets(asked: DataFrame) -> DataFrame:
        own = texts.where("doc_id is not null").join(asked, "doc_id").select("doc_id", "text", "root", "keys")
        return own.mapInArrow(_sets, "doc_id long, size long, payload binary, root long, keys array<struct<key:long,later:boolean>>").where("size > 0")

    roots = grouped_classes(sized, sets, _linked(np.uint64, similarity, verified(similarity), 1), group_rows).withColumnRenamed("u", "doc_id")
    found = nodes.join(roots, "doc_id", "left").select("name", F.coalesce("root", "doc_id").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("doc_id")))
    whole = rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("name")).alias("name")).join(found, "name", "left")
    return whole.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

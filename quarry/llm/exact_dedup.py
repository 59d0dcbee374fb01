"""Exact dedup by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of fixed size. All distinct blocks are sorted and numbered, so a block's integer
name stands for its bytes. Then, level by level, adjacent names are paired (a last one alone pairs with NO_NAME), and all
distinct pairs are sorted and numbered, until one name is left of each document. Level and last name are the document's
identity: equal texts get equal identities, and as each name stands for one value only, nothing else does.

Blocks are sorted by (XXH64, bytes). Their bytes are moved once, to find the distinct ones; unless two blocks share a
hash, which is then settled by their bytes, a block's rank and its look-up need its hash alone. Sorting is by bucket (a hash
modulo BUCKETS): a name is rank times BUCKETS plus bucket, so names depend on the set of values only, neither on partitions
nor on which executor computed them. Copies are merged before every shuffle; a hot block is one row of the names, and joins
that look names up can be split. Each level's names go to the shared folder. At the end a group of over 1 / HOT_GROUPS of all rows gets its result by
a broadcast, as there are at most HOT_GROUPS of them; the rest are joined by name.

A row is told apart from others of its doc_id by two independent XXH64 values of its text, 128 bits.

Defined results: null text is empty, and all empty texts are one group; of equal texts the row of the largest doc_id is
kept, a null doc_id only where all are null; rows that repeat doc_id and text count in group_size and share their
result; rows of one doc_id and different texts are different documents; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage, doc_columns, process_cache

BLOCK_BYTES = 4096
BUCKETS = 4096
HOT_GROUPS = 1000
NO_NAME = -1


#: What tells a row's text apart from others of its doc_id.
TEXT = ["text_hash", "text_check"]


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias(TEXT[0]), F.xxhash64(F.lit(1), "text").alias(TEXT[1])]


def _cut(size: int, hash_bits: int, with_bytes: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        process_cache()
        digest, half, mask = xxhash.xxh64_intdigest, 1 << 63, (1 << hash_bits) - 1

        def signed(raw: bytes) -> int:
            h = digest(raw, 42)
            return h - ((h & half) << 1)

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, raw, first, second in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                n = max(1, -(-len(raw) // size))
                for pos in range(n):
                    block = raw[pos * size : (pos + 1) * size]
                    h = signed(block)
                    rows.append((doc_id, first, second, n, pos, h if hash_bits == 64 else h & mask, block if with_bytes else None))
                    held += len(block)
                    if held > 1 << 23:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", *TEXT, "n", "pos", "hash", "block"])


def _blocks(docs: DataFrame, size: int, hash_bits: int, with_bytes: bool) -> DataFrame:
    raw = doc_columns(docs).select("doc_id", F.col("text").cast("binary").alias("raw"), *_text_keys())
    return raw.mapInArrow(_cut(size, hash_bits, with_bytes), "doc_id long, text_hash long, text_check long, n long, pos long, hash long, block binary")


def _named(values: DataFrame, *order: str) -> DataFrame:
    """Distinct values with their integer names."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS))
    ranked = values.withColumn("bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).cast("long") - 1
    return ranked.withColumn("name", rank * BUCKETS + F.col("bucket")).drop("bucket")


def _block_names(docs: DataFrame, size: int, hash_bits: int) -> DataFrame:
    """doc_id, text_hash, text_check, n, pos, name of each block of each document."""
    distinct = _blocks(docs, size, hash_bits, True).groupBy("hash", "block").count()
    hashes = cut_lineage(distinct.groupBy("hash").agg(F.count("*").alias("twins")))
    alone = _named(hashes.where("twins = 1").select("hash"), "hash")
    placed = _blocks(docs, size, hash_bits, False).select("doc_id", *TEXT, "n", "pos", "hash")
    names = placed.join(alone, "hash")
    twins = hashes.where("twins > 1").select("hash")
    if twins.limit(1).count():
        # names of hashes that several blocks share go below NO_NAME, so they meet no other name
        several = _blocks(docs, size, hash_bits, True).join(twins, "hash")
        own = _named(several.select("hash", "block").distinct(), "hash", "block").withColumn("name", -2 - F.col("name"))
        names = names.unionByName(several.join(own, ["hash", "block"]).drop("block"))
    return cut_lineage(names.drop("hash"))


def _as_key(column: str) -> list[Column]:
    """Two columns that join null with null."""
    return [F.coalesce(F.col(column), F.lit(0)).alias(f"{column}_key"), F.col(column).isNull().alias(f"{column}_null")]


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_hash, text_check, level, name: one row per document (rows that repeat doc_id and text are one).

    hash_bits is for tests, which make blocks share hashes."""
    level, here, done = 0, _block_names(docs, block_bytes, hash_bits), []
    document = ["doc_id", *TEXT]
    while True:
        done.append(here.where("n = 1").select(*document, F.lit(level).alias("level"), "name").distinct())
        longer = here.where("n > 1")
        if not longer.limit(1).count():
            break
        pairs = longer.groupBy(*document, "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("right"),
        )
        pairs = cut_lineage(pairs)
        names = _named(pairs.select("left", "right").distinct(), "left", "right")
        here = pairs.join(names, ["left", "right"]).select(*document, F.expr("(n + 1) div 2").alias("n"), "pos", "name")
        here, level = cut_lineage(here), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    rows = doc_columns(docs).select("doc_id", *_text_keys(), F.sha2("text", 256).alias("text_sha256"))
    ids = identities(docs, block_bytes, hash_bits).select(*_as_key("doc_id"), *TEXT, "level", "name")
    keyed = rows.select("*", *_as_key("doc_id")).join(ids, ["doc_id_key", "doc_id_null", *TEXT])
    keyed = cut_lineage(keyed.select("doc_id", "text_sha256", "level", "name"))
    groups = cut_lineage(keyed.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    share = keyed.count() // hot_groups
    hot = groups.where(F.col("group_size") > share).withColumn("hot", F.lit(True))
    dealt = keyed.join(F.broadcast(hot), ["level", "name"], "left")
    rest = dealt.where("hot is null").drop("keep_id", "group_size").join(groups.where(F.col("group_size") <= share), ["level", "name"])
    out = [part.select("doc_id", "keep_id", "group_size", "text_sha256") for part in (dealt.where("hot"), rest)]
    return out[0].unionByName(out[1]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each group of equal texts: that of the largest doc_id."""
    rows = exact_duplicates(docs).where("kept").select(*_as_key("doc_id"), "text_sha256").distinct()
    # the row is one column meanwhile, so no column of the input can clash
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    keyed = docs.select(F.struct("*").alias("row"), *_as_key("doc_id"), sha.alias("text_sha256"))
    keys = ["doc_id_key", "doc_id_null", "text_sha256"]
    # of rows that repeat doc_id and text, the one whose columns hash lowest
    one = Window.partitionBy(*keys).orderBy(F.xxhash64(*(F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind)))
    kept = keyed.join(rows, keys, "left_semi").withColumn("copy", F.row_number().over(one))
    return kept.where("copy = 1").select("row.*")

"""Sharding by fixed virtual slots, with DataFrame functions alone.

Texts are hashed into SLOTS virtual slots, so equal texts share a slot and thus a shard. Bytes are summed per slot, and
a versioned map gives each slot a shard: the first version deals slots to the lightest shard, heaviest slots first; a
later version edits an earlier one by moving as few bytes as evening out takes. The law is `bytes`: shards are near
equal in bytes, as far as one group of equal texts, which is never divided, allows.

A row's place in its shard is gapless from 0. It is the rows of the shard's earlier cells plus the row's rank in its own
cell. A cell is a part of a slot: a slot has one for each 1/65,536 of all rows that it holds, so a hot slot is ranked by
many tasks and no window holds more than a few cells' rows. Only the sums of the SLOTS slots reach the driver.

Defined results: null text has no bytes, so size 1, and shares the slot of empty text; null doc_id ranks first; repeated
rows have places of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_dir, text_of

SLOTS = 4096
CELL_SHARE = 65_536


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards and each slot's shard."""

    version: int
    shards: int
    slots: tuple[int, ...]


def first_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Heaviest slots first, each to the shard that has the fewest bytes (ties: the lower number)."""
    heap, placed = [(0, shard) for shard in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        held, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (held + slot_bytes.get(slot, 0), shard))
    return SlotMap(1, shards, tuple(placed))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the heaviest to the lightest shard while that narrows the spread beyond tolerance.

    With more shards the new ones start empty; with fewer, the slots of those that go are dealt out first."""
    shards = shards or old.shards
    placed, held = list(old.slots), [0] * max(shards, old.shards)
    for slot, shard in enumerate(placed):
        held[shard] += slot_bytes.get(slot, 0)
    for slot in sorted((s for s, shard in enumerate(placed) if shard >= shards), key=lambda s: (-slot_bytes.get(s, 0), s)):
        to = min(range(shards), key=lambda s: (held[s], s))
        held[to] += slot_bytes.get(slot, 0)
        placed[slot] = to
    held = held[:shards]
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(placed):
        own[shard].append((slot_bytes.get(slot, 0), slot))
    mean = sum(held) / shards
    for _ in range(len(placed)):
        high, low = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[high] - held[low]
        fitting = [x for x in own[high] if 0 < x[0] < gap]
        if gap <= tolerance * mean or not fitting:
            break
        moved = min(fitting, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        own[high].remove(moved)
        own[low].append(moved)
        placed[moved[1]] = low
        held[high] -= moved[0]
        held[low] += moved[0]
    return replace(old, version=old.version + 1, shards=shards, slots=tuple(placed))


def map_table(spark: SparkSession, slot_map: SlotMap, cells: dict[int, int] | None = None) -> DataFrame:
    """virtual_slot, shard, cells: one row per slot, from a literal of fixed size."""
    rows = [{"shard": shard, "cells": (cells or {}).get(slot, 1)} for slot, shard in enumerate(slot_map.slots)]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<shard:int,cells:long>>")
    return spark.range(1).select(F.posexplode(listed).alias("virtual_slot", "x")).select("virtual_slot", "x.shard", "x.cells")


def save_map(spark: SparkSession, slot_map: SlotMap, uri: str) -> None:
    """Adds a version to the stored map; a version is never overwritten."""
    kept = map_table(spark, slot_map).select("virtual_slot", "shard", F.lit(slot_map.shards).alias("shards"))
    kept.coalesce(1).write.mode("error").parquet(f"{uri}/version={slot_map.version}")


def load_map(spark: SparkSession, uri: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{uri}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: what sharding needs of a document, without its text."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """(bytes, rows) of each slot that has any: at most one row per slot."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: r.bytes for r in sums}, {r.virtual_slot: r.n for r in sums}


def place(rows: DataFrame, slot_map: SlotMap, slot_rows: dict[int, int]) -> DataFrame:
    """rows with shard and slot (the place in the shard)."""
    per_cell = max(512, -(-sum(slot_rows.values()) // CELL_SHARE))
    mapped = map_table(rows.sparkSession, slot_map, {slot: -(-n // per_cell) for slot, n in slot_rows.items()})
    dealt = rows.join(F.broadcast(mapped), "virtual_slot").withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("cells")))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("shard", "virtual_slot", "cell").agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "shard")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32"))
    ranked = dealt.withColumn("rank", rank - 1).join(bases, ["virtual_slot", "cell"])
    return ranked.withColumn("slot", (F.col("base") + F.col("rank")).cast("long"))


def shard_documents(docs: DataFrame, shards: int, uri: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the virtual slot; the map's first version is stored under uri."""
    spark = docs.sparkSession
    uri = uri or fresh_dir(spark, "slots")
    measured(docs).write.parquet(f"{uri}/rows")
    rows = spark.read.parquet(f"{uri}/rows")
    slot_bytes, slot_rows = slot_sums(rows)
    slot_map = first_map(slot_bytes, shards)
    save_map(spark, slot_map, f"{uri}/map")
    return place(rows, slot_map, slot_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )

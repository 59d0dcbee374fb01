"""The folder that driver and executors share: checkpoints, and tables that tasks read by blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa
    from pyarrow import parquet

#: Shares of a stored table that tasks with the same block of questions read.
SLABS = 8


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own where none is set and all run in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
            place = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(place)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_blocks(rows: DataFrame, key: str, most: int) -> list[str]:
    """URIs of blocks of about `most` keys, each with all rows of its keys; nothing passes through the driver but the number of keys."""
    n = max(1, -(-rows.select(key).distinct().count() // most))
    place = fresh(rows.sparkSession, "blocks")
    rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n))).write.partitionBy("_block").parquet(place)
    return [f"{place}/_block={b}" for b in range(n)]


def read_block(uri: str) -> pa.Table | None:
    """A block's rows, inside a task; None where it has none."""
    import pyarrow as pa
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    tables = [parquet.read_table(f.path, filesystem=system, partitioning=None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None


def opened(uri: str) -> Iterator[parquet.ParquetFile]:
    """The files of a stored table, inside a task, one open at a time."""
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with system.open_input_file(name) as source:
            yield parquet.ParquetFile(source)


def grid(spark: SparkSession, blocks: int, slabs: int) -> DataFrame:
    """block, slab: every pair, each in a task of its own."""
    n = blocks * slabs
    return spark.range(0, n, 1, n).select(F.expr(f"id div {slabs}").alias("block"), (F.col("id") % slabs).alias("slab"))

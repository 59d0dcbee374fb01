"""What the operators share: input columns, the shared folder, and small file access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no extra column of the input can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process (tests)."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        place = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", place)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared one; whoever writes first creates it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def open_fs(uri: str):
    """(file system, path) of a URI or local path, for readers and writers inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def local_path(uri: str) -> str | None:
    """The path of a URI that can be memory-mapped, else None."""
    from pyarrow import fs

    system, path = open_fs(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


_caches: dict[str, dict] = {}


def process_cache(owner: str = "") -> dict:
    """This worker process's cache of one operator. Those of other operators are let go: workers outlive the stages that filled them."""
    for other in [name for name in _caches if name != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0

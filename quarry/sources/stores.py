"""Keyed stores of chunks and vectors: upsert, look-up, filters, names (s12, s13, s16, i12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector; others aren't stored."""
    return chunks.where(F.size("embedding") > 0)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't new, and the new rows (of equal keys in `new`, one)."""
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*new.columns)))).where("_n = 1").drop("_n")
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def where_equal(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows whose columns equal the given values; the test reaches the scan."""
    for column, value in values.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def collection_name(prefix: Column, repo: Column) -> Column:
    """At most 63 characters, lower case, others than letters, digits, _ and - replaced."""
    return F.substring(F.regexp_replace(F.lower(F.concat_ws("__", prefix, repo)), "[^a-z0-9_-]", "_"), 1, 63)


class Collections:
    """Named tables of chunks under a folder; each upsert writes a new version, and readers take the latest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs
        self.system = self.paths.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.paths.Path("/".join([self.folder, *names]))

    def _versions(self, name: str) -> list[str]:
        if not self.exists(name):
            raise KeyError(name)
        return sorted(f.getPath().getName() for f in self.system.listStatus(self._path(name)) if f.getPath().getName().startswith("v="))

    def get_or_create(self, name: str) -> str:
        self.system.mkdirs(self._path(name))
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return bool(self.system.exists(self._path(name)))

    def delete(self, name: str) -> bool:
        return bool(self.exists(name) and self.system.delete(self._path(name), True))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self._path()) if f.isDirectory()) if self.system.exists(self._path()) else []

    def read(self, name: str) -> DataFrame | None:
        """The latest version, or None before the first."""
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.get_or_create(name)}/{versions[-1]}") if versions else None

    def count(self, name: str) -> int:
        rows = self.read(name)
        return rows.count() if rows is not None else 0

    def upsert(self, name: str, chunks: DataFrame, key: str) -> None:
        """Rows that have a vector replace those of their keys. Readers see the old version until the new one is whole."""
        place, versions, new = self.get_or_create(name), self._versions(name), with_vectors(chunks)
        rows = upsert(self.read(name) if versions else new.limit(0), new, key)
        rows.write.mode("error").parquet(f"{place}/v={len(versions):09d}")

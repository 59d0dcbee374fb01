"""An extension: the job store over a stream of events. The batch operators are those of quarry.operators.context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.context import progress


def job_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def latest_jobs(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """repo_key, status, progress, created_at: the newest event of each repository (events: repo_key, status, raw_progress, created_at); later ones than `late` are dropped."""
    newest = F.max(F.struct("created_at", "status", progress(F.col("raw_progress")).alias("progress"))).alias("x")
    return events.withWatermark("created_at", late).groupBy("repo_key").agg(newest).select("repo_key", "x.status", "x.progress", "x.created_at")


def progress_windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, phase, events: how many events of each phase came in each window."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "phase").agg(F.count("*").alias("events"))

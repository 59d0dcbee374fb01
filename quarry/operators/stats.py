"""Aggregates over files, functions, edges and chunks: a01-a19."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.filters import language, parts


def language_stats(files: DataFrame) -> DataFrame:
    """language, file_count, byte_count, percentage of files with a known language."""
    known = files.select(language(F.col("path")).alias("language"), "size_bytes").where("language is not null")
    sums = known.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("size_bytes").cast("long").alias("byte_count"))
    return sums.withColumn("percentage", F.round(100 * F.col("byte_count") / F.sum("byte_count").over(Window.partitionBy()), 1))


def language_flags(stats: DataFrame) -> DataFrame:
    """One row: primary_language (ties: first by name), is_monorepo (3 languages of 15 % or more), has_multiple_primary (first two within 10 points)."""
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("byte_count"), "language")))
    first, second = (F.max(F.when(F.col("rank") == n, F.col("percentage"))) for n in (1, 2))
    return ranked.agg(
        F.max(F.when(F.col("rank") == 1, F.col("language"))).alias("primary_language"),
        (F.count_if(F.col("percentage") >= 15) >= 3).alias("is_monorepo"),
        F.coalesce(F.abs(first - second) <= 10, F.lit(False)).alias("has_multiple_primary"),
        F.sum("file_count").cast("long").alias("total_files"), F.sum("byte_count").cast("long").alias("total_bytes"),
    )


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("in_degree"))


def top_in_degree(edges: DataFrame, n: int = 10) -> DataFrame:
    return in_degrees(edges).orderBy(F.desc("in_degree"), "id").limit(n)


def hubs(edges: DataFrame, threshold: int = config.HUB_THRESHOLD) -> DataFrame:
    return in_degrees(edges).where(F.col("in_degree") >= threshold)


def orphans(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Nodes that nothing calls, entry points aside."""
    out = nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return out if entries is None else out.join(entries.select("id"), "id", "left_anti")


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, of each type, and their tokens' sum, whole mean and maximum."""
    return chunks.agg(
        F.count("*").alias("total"), F.count_if(F.col("chunk_type") == "function").alias("functions"),
        F.count_if(F.col("chunk_type") == "file_summary").alias("file_summaries"),
        F.sum("token_count").cast("long").alias("tokens"), F.expr("sum(token_count) div count(*)").alias("mean_tokens"), F.max("token_count").alias("max_tokens"),
    )


def call_volume(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Files by 2 x calls in + calls out, top n."""
    file = nodes.select("id", "file")
    out = edges.join(file, edges.src == file.id).groupBy("file").agg(F.count("*").alias("calls_out"))
    into = edges.join(file, edges.dst == file.id).groupBy("file").agg(F.count("*").alias("calls_in"))
    both = out.join(into, "file", "full").select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls_in", "calls_out")])
    return both.withColumn("score", 2 * F.col("calls_in") + F.col("calls_out")).orderBy(F.desc("score"), "file").limit(n)


def core_utilities(nodes: DataFrame, edges: DataFrame, least: int = 3, n: int = 10) -> DataFrame:
    """Files called from at least so many other files, top n."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("file").alias("from_file")), nodes.select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    pairs = edges.join(a, "src").join(b, "dst").where("from_file <> to_file").groupBy("to_file").agg(F.countDistinct("from_file").alias("callers"))
    return pairs.where(F.col("callers") >= least).orderBy(F.desc("callers"), "to_file").limit(n)


def hotspots(nodes: DataFrame, n: int = 5) -> DataFrame:
    """`file::name` of the most complex functions; ties by label, last first."""
    labelled = nodes.select(F.concat_ws("::", "file", "name").alias("label"), "complexity")
    return labelled.orderBy(F.desc("complexity"), F.desc("label")).limit(n)


def layer_groups(nodes: DataFrame) -> DataFrame:
    """layer, nodes (how many), names (in order) of the nodes that a traversal kept."""
    return nodes.groupBy("layer").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list("name")).alias("names"))


def matching_directories(files: DataFrame, names: list[str]) -> DataFrame:
    """One row: the number of distinct directories with one of the names."""
    inner = F.slice(parts(F.col("path")), 1, F.greatest(F.size(parts(F.col("path"))) - 1, F.lit(0)))
    found = files.select(F.explode(inner).alias("part")).where(F.lower("part").isin(names))
    return found.agg(F.countDistinct("part").alias("directories"))

"""What a repository's story is told from, and the story that stands in where none can be generated: c13, c14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph, rules, stats
from quarry.operators.filters import file_name

# How many entry points, modules and hotspots a story names; repositories of fewer files may get a stand-in story.
ENTRY_POINTS, MODULES, HOTSPOTS, SMALL_FILES = 3, 10, 5, 5


def _listed(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """One row: the values of a few rows, in order."""
    seat = F.row_number().over(Window.orderBy(*order))
    ordered = rows.select(seat.alias("seat"), value.alias("value"))
    return ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("seat", "value"))), lambda x: x["value"]).alias(name))


def story_context(files: DataFrame, nodes: DataFrame, edges: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """One row on a repository of files (path, size_bytes) with functions as nodes (id, name, file, complexity), calls as edges, entry points (path, score) and patterns (pattern, confidence).

    Each part is an aggregate or one of the first few rows of an order, so the row's size doesn't grow with the repository."""
    languages = stats.language_stats(files)
    shares = _listed(languages, [F.desc("byte_count"), F.col("language")], F.format_string("%s (%s%%)", "language", F.col("percentage").cast("string")), "shares")
    totals = files.agg(F.count("*").alias("total_files")).crossJoin(nodes.agg(F.count("*").alias("total_functions")))
    pattern = found.agg(F.max(F.struct("confidence", "pattern"))["pattern"].alias("pattern")).select(F.coalesce("pattern", F.lit("Unknown")).alias("detected_pattern"))
    first = _listed(entries.orderBy(F.desc("score"), "path").limit(ENTRY_POINTS), [F.desc("score"), F.col("path")], file_name(F.col("path")), "entry_points")
    core = _listed(stats.core_utilities(nodes, edges), [F.desc("callers"), F.col("to_file")], F.col("to_file"), "core_utilities")
    functions = nodes.groupBy("file").agg(F.count("*").alias("functions"))
    busiest = stats.call_volume(nodes, edges, MODULES).join(functions, "file", "left")
    module = F.struct(F.col("file"), "calls_in", "calls_out", F.coalesce("functions", F.lit(0)).alias("functions"))
    modules = _listed(busiest, [F.desc("score"), F.col("file")], module, "top_modules")
    between = graph.file_edges(nodes, edges).select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"))
    circular = graph.mutual(between).limit(1).agg((F.count("*") > 0).alias("has_circular_deps"))
    hot = _listed(stats.hotspots(nodes, HOTSPOTS), [F.desc("complexity"), F.desc("label")], F.col("label"), "complexity_hotspots")
    flags = rules.path_flags(files)
    signals = flags.select(F.filter(F.array(*[F.when(F.col(c), c) for c in flags.columns]), lambda x: x.isNotNull()).alias("architectural_signals"))
    out = totals.crossJoin(shares)
    for part in (pattern, first, core, modules, circular, hot, signals):
        out = out.crossJoin(part)
    primary = F.regexp_extract(F.coalesce(F.get("shares", F.lit(0)), F.lit("Unknown (")), r"^(.*?) \(", 1)
    return out.select(primary.alias("primary_language"), F.array_join("shares", ", ").alias("languages"), *[c for c in out.columns if c != "shares"])


def fallback_story(context: DataFrame) -> DataFrame:
    """story: the JSON text that stands in for a generated story of a repository of fewer than SMALL_FILES files; larger ones get none."""
    c = F.col
    # The stand-in's sentences.
    module = F.transform(F.slice("top_modules", 1, 3), lambda m: F.struct(
        F.replace(file_name(m["file"]), F.lit("."), F.lit("_")).alias("module_id"), F.lit("Core Module").alias("role_title"),
        F.concat(F.lit("Contains "), m["functions"], F.lit(" functions. This module handles the primary logic of the library.")).alias("explanation"),
    ))
    story = F.struct(
        F.concat(F.lit("This is a focused "), c("primary_language"), F.lit(" library with "), c("total_files"), F.lit(" files and "), c("total_functions"), F.lit(" functions. It appears to be a small, single-purpose tool.")).alias("project_summary"),
        F.array("primary_language").alias("tech_stack"),
        F.concat(F.lit("This is a minimal "), c("primary_language"), F.lit(" library with "), c("total_files"), F.lit(" files.")).alias("primary_commitment"),
        F.concat(F.lit("The codebase is intentionally small and focused. With only "), c("total_functions"), F.lit(" functions across "), c("total_files"), F.lit(" files, it prioritizes simplicity over architectural complexity.")).alias("origin_story"),
        F.lit("The control flow is straightforward and linear. There are no complex abstractions or layered architectures — just direct function calls serving a single, well-defined purpose.").alias("how_it_flows"),
        module.alias("key_modules"),
        F.lit("The main tension is between keeping the codebase minimal and adding features. Every new function risks bloating what should remain a focused tool.").alias("design_tensions"),
        F.lit("This codebase is a Swiss Army knife — small, portable, and designed to do one thing exceptionally well.").alias("founding_metaphor"),
        F.lit("This is a well-constructed minimal library. It would break if feature creep led to architectural complexity without a corresponding refactor into proper layers.").alias("verdict"),
    )
    return context.where(c("total_files") < SMALL_FILES).select(F.to_json(story).alias("story"))

"""Diagrams: g01-g12."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.filters import file_name
from quarry.operators.resolve import module_matches, stem


def short_name(qualified: Column) -> Column:
    """The last two segments."""
    steps = F.split(qualified, r"\.")
    return F.array_join(F.slice(steps, F.greatest(F.size(steps) - 1, F.lit(1)), 2), ".")


def node_ids(files: DataFrame) -> DataFrame:
    """path, node_id: stems of letters, digits and _, starting with a letter; a repeated one gets _1, _2 in order of path."""
    plain = F.regexp_replace(stem(F.col("path")), "[^a-zA-Z0-9_]", "_")
    base = F.when(plain.rlike("^[A-Za-z]"), plain).otherwise(F.concat(F.lit("n_"), plain))
    n = F.row_number().over(Window.partitionBy("base").orderBy("path")) - 1
    return files.select("path", base.alias("base")).distinct().withColumn("n", n).select("path", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("node_id"))


def node_kind(path: Column, entries: list[str]) -> Column:
    hit = F.lit(False)
    for entry in entries:
        hit = hit | path.endswith(entry)
    return F.when(hit, "entry_point").otherwise("module")


def nodes(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, most: int = 8, lines: int = 40) -> DataFrame:
    """path, label, functions, classes, imports (the first `most`), snippet (the first lines) of each file (path, content); names in order of their lines."""
    kinds = {"functions": (functions, "name"), "classes": (classes, "name"), "imports": (imports, "module")}
    named = [rows.select(F.col("file_path").alias("path"), F.lit(kind).alias("kind"), "line", F.col(value).alias("x")) for kind, (rows, value) in kinds.items()]
    ordered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", "x"))))
    listed = reduce(DataFrame.unionByName, named).groupBy("path").agg(*[F.transform(ordered(kind), lambda e: e["x"]).alias(kind) for kind in kinds])
    snippet = F.array_join(F.slice(F.split("content", "\n", lines + 1), 1, lines), "\n")
    out = files.select("path", file_name(F.col("path")).alias("label"), snippet.alias("snippet")).join(listed, "path", "left")
    names = [F.coalesce(kind, F.array().cast("array<string>")).alias(kind) for kind in kinds]
    return out.select("path", "label", *names, "snippet").withColumn("imports", F.slice("imports", 1, most))


def edge_counts(edges: DataFrame, least: int = 3) -> DataFrame:
    """file, calls_out, calls_in, type of file edges (from_file, to_file); one called by `least` files is a core utility."""
    out = edges.groupBy(F.col("from_file").alias("file")).agg(F.count("*").alias("calls_out"))
    into = edges.groupBy(F.col("to_file").alias("file")).agg(F.count("*").alias("calls_in"))
    both = out.join(into, "file", "full").select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls_out", "calls_in")])
    return both.withColumn("type", F.when(F.col("calls_in") >= least, "core_utility").otherwise("module"))


def description(classes: Column, functions: Column, imports: Column) -> Column:
    part = lambda head, x, n: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(F.slice(x, 1, n), ", ")))
    return F.concat_ws(" | ", part("Classes: ", classes, 3), part("Functions: ", functions, 4), part("Depends on: ", imports, 4))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: the flowchart's lines (nodes: node_id, label, type; edges: from_id, to_id, kind), by part and then as they are ordered."""
    shape = F.when(F.col("type") == "entry_point", F.concat(F.lit('(["'), "label", F.lit('"])'))).when(F.col("type") == "core_utility", F.concat(F.lit("{{"), "label", F.lit("}}"))).otherwise(F.concat(F.lit('["'), "label", F.lit('"]')))
    style = F.when(F.col("type") == "entry_point", "entryPoint").when(F.col("type") == "core_utility", "coreUtil").otherwise("module")
    a = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), "node_id", shape).alias("line"))
    b = edges.distinct().select(F.lit(2).alias("part"), F.concat(F.lit("  "), "from_id", F.when(F.col("kind") == "import", " --> ").otherwise(" -.-> "), "to_id").alias("line"))
    c = nodes.select(F.lit(3).alias("part"), F.concat(F.lit("  class "), "node_id", F.lit(" "), style).alias("line"))
    return a.unionByName(b).unionByName(c)


def mermaid_text(lines: DataFrame) -> DataFrame:
    """One row: the whole chart; a diagram has few nodes."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "line")))
    return lines.agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("chart"))


def parsed_edges(lines: DataFrame) -> DataFrame:
    """source, target of lines that are arrows."""
    arrow = r"^\s*(\S+)\s+(?:-->|-\.->)\s+(\S+)"
    bare = lambda i: F.regexp_replace(F.regexp_extract("line", arrow, i), "[()\\[\\]{}\"']", "")
    return lines.where(F.col("line").rlike(arrow)).select(bare(1).alias("source"), bare(2).alias("target")).where("source <> '' and target <> '' and source <> '%%'")


def layout(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """id, x, y of nodes (id, type), of each diagram where they have its key, `by`: tiers from entry points to modules; modules in about 1.5 times as many columns as rows."""
    # A card's width and height, the gaps, the canvas's middle and its top.
    card_w, card_h, gap_x, gap_y, middle, top = 160, 80, 50, 100, 520, 100
    tier = F.when(F.col("type") == "entry_point", 0).when(F.col("type") == "core_utility", 1).otherwise(2)
    placed = nodes.select(*by, "id", tier.alias("tier")).withColumn("i", F.row_number().over(Window.partitionBy(*by, "tier").orderBy("id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by, "tier")))
    columns = F.when((F.col("tier") == 2) & (F.col("n") > 5), F.ceil(F.sqrt(F.col("n") * 1.5))).otherwise(F.col("n"))
    placed = placed.withColumn("columns", columns)
    heights = placed.select(*by, "tier", "n", "columns").distinct().withColumn("height", F.ceil(F.col("n") / F.col("columns")) * (card_h + gap_y) + 40)
    starts = heights.withColumn("start", top + F.coalesce(F.sum("height").over(Window.partitionBy(*by).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*by, "tier", "start")
    row, column = F.expr("i div columns"), F.expr("i % columns")
    in_row = F.least(F.col("columns"), F.col("n") - row * F.col("columns"))
    width = in_row * card_w + (in_row - 1) * gap_x
    x = F.floor(middle - width / 2 + card_w / 2 + column * (card_w + gap_x) + 0.5)
    return placed.join(starts, [*by, "tier"]).select(*by, "id", x.cast("long").alias("x"), (F.col("start") + row * (card_h + gap_y)).cast("long").alias("y"))


def total_progress(phase: Column, percent: Column) -> Column:
    """Progress of the whole run by that of a phase."""
    return (
        F.when(phase == "parse", 30 + F.floor(percent * 0.25)).when(phase == "chunk", 55 + F.floor(percent * 0.25)).when(phase.isin("diagram", "story"), 80 + F.floor(percent * 0.2)).otherwise(F.floor(percent * 0.3))
    ).cast("long")


def preview(nodes: DataFrame, edges: DataFrame, most: int = 20, chars: int = 20) -> DataFrame:
    """preview: one chart of the nodes (id, name, layer) that most others call, a group for each layer, and the calls between them.

    Groups come in order of their first node, nodes in order of calls and id; names longer than `chars` are cut."""
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "id").limit(most)
    top = degree.join(nodes.select("id", "name", "layer"), "id")
    first = F.min(F.struct(-F.col("n"), F.col("id"))).over(Window.partitionBy("layer"))
    seat = F.row_number().over(Window.orderBy("first", "layer", F.desc("n"), "id"))
    seated = top.withColumn("first", first).withColumn("seat", seat)  # at most `most` rows
    last = F.element_at(F.split("name", r"\."), -1)
    shown = F.when(F.length(last) > chars, F.concat(F.substring(last, 1, chars - 3), F.lit("..."))).otherwise(last)
    line = F.format_string('    node%d["%s"]', F.col("seat"), shown)
    groups = seated.withColumn("line", line).groupBy("layer").agg(F.min("seat").alias("seat"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seat", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    boxes = groups.select(F.lit(1).alias("part"), F.col("seat").alias("a"), F.lit(0).alias("b"), F.concat(F.format_string('  subgraph %s["%s Layer"]\n', F.col("layer"), F.upper("layer")), "lines", F.lit("\n  end")).alias("text"))
    a, b = seated.select(F.col("id").alias("src"), F.col("seat").alias("a")), seated.select(F.col("id").alias("dst"), F.col("seat").alias("b"))
    between = edges.select("src", "dst").distinct().join(F.broadcast(a), "src").join(F.broadcast(b), "dst")
    arrows = between.select(F.lit(2).alias("part"), "a", "b", F.format_string("  node%d --> node%d", F.col("a"), F.col("b")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "a", "b", "text")))
    body = boxes.unionByName(arrows).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("```mermaid\ngraph TD\n"), "body", F.lit("\n```\n")).alias("preview"))


def edges_or_imports(edges: DataFrame, imports: DataFrame, paths: DataFrame) -> DataFrame:
    """The file edges (from_file, to_file), or where there is none at all those that imports make: each import's first match that isn't its own file."""
    known = edges.select("from_file", "to_file")
    made = module_matches(imports, paths).select(F.col("file_path").alias("from_file"), F.col("target").alias("to_file")).distinct()
    none = known.limit(1).agg((F.count("*") == 0).alias("none")).where("none")
    return known.unionByName(made.join(F.broadcast(none), how="left_semi", on=F.lit(True)))

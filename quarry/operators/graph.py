"""Graph operators over edges (src, dst) and nodes (id, name, file, layer, complexity): r01-r13, u01, u02, j12, j15.

Traversals go level by level: a frontier is joined with the edges, nodes that were met before are left out, and each level is written to the shared
folder, so plans stay short and survive lost executors. Work is that of the edges met, never of all pairs of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.shared import cut

#: Neighbours of a node that are one row.
LIST = 1024


def levels(edges: DataFrame, sources: DataFrame, keys: list[str], max_depth: int | None = None, later: DataFrame | None = None, along: list[str] | None = None) -> DataFrame:
    """keys, id, depth: what each source (a row of keys and id) reaches along edges, at its least number of steps; sources are at 0, those of `later` (keys, id) at 1.

    Edges may have keys of their own, those in `along`; a source then follows the edges of its key."""
    on = along or []
    steps = edges.select(*on, F.col("src").alias("id"), F.col("dst").alias("_to"))
    frontier = met = cut(sources.select(*keys, "id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(steps, [*on, "id"]).select(*keys, F.col("_to").alias("id"))
        if depth == 1 and later is not None:
            found = found.unionByName(later.select(*keys, "id"))
        frontier = cut(found.distinct().join(met, [*keys, "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        met = met.unionByName(frontier)
    return met


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, successors, predecessors: how many distinct ones each node has."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("successors"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("predecessors"))
    return out.join(into, "id", "full").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("successors", "predecessors")])


def related(edges: DataFrame, queries: DataFrame, relation: str = "both") -> DataFrame:
    """query, id, relation: callees (`calls`) and callers (`called_by`) of each queried node."""
    own = queries.select(F.col("id").alias("query"))
    calls = own.join(edges, own["query"] == edges["src"]).select("query", F.col("dst").alias("id"), F.lit("calls").alias("relation"))
    called = own.join(edges, own["query"] == edges["dst"]).select("query", F.col("src").alias("id"), F.lit("called_by").alias("relation"))
    return {"calls": calls, "called_by": called}.get(relation, calls.unionByName(called)).distinct()


def neighbours(edges: DataFrame, queries: DataFrame, depth: int = 2) -> DataFrame:
    """query, id: nodes within depth steps forward or within depth steps backward, the node itself left out."""
    both = edges.select(F.lit(1).alias("way"), "src", "dst").unionByName(reversed_edges(edges).select(F.lit(-1).alias("way"), "src", "dst"))
    sources = queries.select(F.col("id").alias("query"), "id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    return levels(both, sources, ["query", "way"], depth, along=["way"]).where("id <> query").select("query", "id").distinct()


def seeds(edges: DataFrame, entries: DataFrame, n: int = 3) -> DataFrame:
    """The entry points, or the n nodes of highest in-degree where there is none."""
    top = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")
    none = entries.agg((F.count("*") == 0).alias("none"))
    return entries.select("id").unionByName(top.join(none.where("none"), how="left_semi", on=F.lit(True)))


def traverse(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int = config.MAX_TRAVERSAL_DEPTH, max_nodes: int = config.MAX_TRAVERSAL_NODES) -> DataFrame:
    """id, depth: breadth first from the start, whose callers join at depth 1; of all, the first max_nodes by (depth, -complexity, name)."""
    callers = edges.join(start.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    ranked = levels(edges, start, [], max_depth, later=callers).join(nodes.select("id", "complexity", "name"), "id")
    return ranked.orderBy("depth", F.desc("complexity"), "name", "id").limit(max_nodes).select("id", "depth")


def shortest_paths(edges: DataFrame, source: int, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, path of each reachable target: the shortest path, of equal ones the first in order."""
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("_to"))
    start = targets.sparkSession.range(1).select(F.lit(source).cast("long").alias("id")).withColumn("path", F.array("id"))
    frontier = met = cut(start)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        longer = frontier.join(steps, "id").select(F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"))
        frontier = cut(longer.join(met, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if not frontier.limit(1).count():
            break
        met = met.unionByName(frontier)
    return met.join(targets.select("id"), "id", "left_semi")


def listed(edges: DataFrame, key: str, value: str) -> DataFrame:
    """id, to: each key's values in arrays of about LIST, so that a round sorts and moves nodes and not edges."""
    most = edges.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64(value), F.lit(-(-most // LIST)))
    return edges.groupBy(F.col(key).alias("id"), part.alias("_part")).agg(F.collect_list(value).alias("to")).select("id", "to")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: nodes on a cycle, by the largest node of their strongly connected component.

    Nodes without a way in or out are trimmed; then each node takes the largest node that reaches it, and the nodes of one such colour that reach its
    largest node are a component. Components go, and the rest is done again."""
    return _components(cut(edges.where("src <> dst").select("src", "dst").distinct()))


def _components(rest: DataFrame) -> DataFrame:
    """strong_components() of written, distinct edges between different nodes."""
    out = None
    while True:
        while True:
            ways = F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(way).alias("way")) for c, way in (("src", 1), ("dst", 2))]))
            lone = cut(rest.select(ways.alias("x")).select("x.*").groupBy("id").agg(F.bit_or("way").alias("way")).where("way < 3").select("id"))
            if not lone.limit(1).count():
                break
            rest = _without(rest, lone)
        if not rest.limit(1).count():
            return out if out is not None else rest.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
        there, back = cut(listed(rest, "src", "dst")), cut(listed(rest, "dst", "src"))
        colour = moved = cut(there.select("id").distinct().withColumn("colour", F.col("id")))
        while True:
            coming = there.join(moved, "id").select(F.explode("to").alias("id"), "colour").groupBy("id").agg(F.max("colour").alias("most"))
            new = cut(colour.join(coming, "id", "left").select("id", F.greatest("colour", "most").alias("colour"), (F.col("most") > F.col("colour")).alias("moved")))
            moved = new.where("moved").select("id", "colour")
            if not moved.limit(1).count():
                break
            colour = new.select("id", "colour")
        alike = colour.select("id", F.col("colour").alias("component"))
        found = frontier = cut(alike.where("id = component"))
        while True:
            reached = frontier.join(back, "id").select(F.explode("to").alias("id"), "component").distinct()
            frontier = cut(reached.join(alike, ["id", "component"], "left_semi").join(found, ["id", "component"], "left_anti"))
            if not frontier.limit(1).count():
                break
            found = found.unionByName(frontier)
        out = found if out is None else out.unionByName(found)
        if found.count() == colour.count():
            return out
        rest = _without(rest, found.select("id"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return cut(edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """id of every node that is on a cycle."""
    others = strong_components(edges).where("id <> component")
    return others.select("id").unionByName(others.select(F.col("component").alias("id")).distinct())


def short_cycles(edges: DataFrame) -> DataFrame:
    """a, b, c of each simple cycle of two nodes (c is -1) or three, starting at its least node.

    A cycle of three is found from its node of the fewest edges, so no pair of edges is formed at a hub unless its cycle's other nodes are hubs too."""
    ab = cut(edges.select("src", "dst").where("src <> dst").distinct())
    degree = ab.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ends = [degree.select(F.col("id").alias(c), F.struct("n", "id").alias(f"{c}_rank")) for c in ("src", "dst")]
    ranked = cut(ab.join(ends[0], "src").join(ends[1], "dst"))
    into = ranked.where("dst_rank < src_rank").select(F.col("dst").alias("v"), F.col("src").alias("u"))
    out = ranked.where("src_rank < dst_rank").select(F.col("src").alias("v"), F.col("dst").alias("w"))
    closed = into.join(out, "v").where("u <> w").join(ab.toDF("w", "u"), ["w", "u"], "left_semi")
    three = closed.select(F.when(F.least("v", "w", "u") == F.col("v"), F.array("v", "w", "u")).when(F.least("v", "w", "u") == F.col("w"), F.array("w", "u", "v")).otherwise(F.array("u", "v", "w")).alias("x"))
    two = ab.where("src < dst").join(ab.toDF("dst", "src"), ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(-1).cast("long").alias("c"))
    return two.unionByName(three.select(*[F.col("x")[i].alias(c) for i, c in enumerate("abc")]))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """nodes: every simple cycle of at most `longest` nodes, once, from its least id on; an edge of a node to itself is a cycle of one. `longest` is part of what is asked: there may be exponentially many without it.

    Only edges inside a strongly connected component count. A cycle is put together from the half that leaves its node of the fewest edges (ties: the lesser id) and the half that leads back to it, whose other nodes all have
    more; so paths have half a cycle's length, and paths from a hub meet hubs alone."""
    distinct = cut(edges.select("src", "dst").distinct())
    out = distinct.where("src = dst").select(F.array("src").alias("nodes"))
    if longest < 2:
        return out.where(F.lit(longest > 0))
    between = distinct.where("src <> dst")
    part = cut(_components(between))
    ends = [part.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part")) for c in ("src", "dst")]
    inside = cut(between.join(ends[0], "src").join(ends[1], "dst").where("src_part = dst_part").select("src", "dst"))
    degree = inside.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ranks = [degree.select(F.col("id").alias(c), F.struct("n", "id").alias(f"{c}_rank")) for c in ("src", "dst")]
    ranked = cut(inside.join(ranks[0], "src").join(ranks[1], "dst"))
    halves = []
    # the longest half is met once, so it isn't written; of odd cycles the longest way back is met twice
    for way, most, once in ((("src", "dst"), -(-longest // 2), True), (("dst", "src"), longest // 2, longest % 2 == 0)):
        steps = ranked.select(F.col(way[0]).alias("end"), F.col(way[1]).alias("_to"), F.col(f"{way[0]}_rank").alias("_from_rank"), F.col(f"{way[1]}_rank").alias("_rank"))
        path = cut(steps.where("_from_rank < _rank").select(F.col("end").alias("start"), F.col("_from_rank").alias("least"), F.col("_to").alias("end"), F.array().cast("array<long>").alias("inner")))
        found = [path]
        for n in range(2, most + 1):
            longer = path.join(steps, "end").where("_rank > least and end <> _to and not array_contains(inner, _to)")
            path = longer.select("start", "least", F.col("_to").alias("end"), F.concat("inner", F.array("end")).alias("inner"))
            path = path if once and n == most else cut(path)
            found.append(path)
        halves.append(found)
    for n, there in enumerate(halves[0], 1):
        # ways back of as many steps and of one less, together, so that a half moves once
        back = reduce(DataFrame.unionByName, [x.select("start", "end", F.col("inner").alias("rest")) for x in halves[1][max(n - 2, 0) : n]])
        closed = there.select("start", "end", "inner").join(back, ["start", "end"]).where(~F.arrays_overlap("inner", "rest"))
        whole = closed.select(F.concat(F.array("start"), "inner", F.array("end"), F.reverse("rest")).alias("c")).withColumn("at", F.array_position("c", F.array_min("c")).cast("int"))
        out = out.unionByName(whole.select(F.concat(F.expr("slice(c, at, size(c))"), F.expr("slice(c, 1, at - 1)")).alias("nodes")))
    return out


def subgraph(edges: DataFrame, root: DataFrame, depth: int = 2) -> DataFrame:
    """Edges whose source is within depth steps of the root."""
    inside = levels(edges, root, [], depth).select(F.col("id").alias("src"), F.col("depth").alias("src_depth"))
    return edges.join(inside, "src").select("src", "dst", "src_depth")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, nodes that call nothing, and those that nothing calls."""
    quiet = nodes.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("leaves"))
    unreached = nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(quiet).crossJoin(unreached.agg(F.count("*").alias("unreached")))


def has_nodes(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """id, known, name of each asked id."""
    own = nodes.select("id", "name", F.lit(True).alias("_known"))
    return asked.join(own, "id", "left").select("id", F.coalesce("_known", F.lit(False)).alias("known"), "name")


def edge_attributes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, cross_file, cross_layer."""
    a = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"), F.col("layer").alias("src_layer"))
    b = nodes.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), F.col("layer").alias("dst_layer"))
    both = edges.join(a, "src").join(b, "dst")
    return both.select("src", "dst", (F.col("src_file") != F.col("dst_file")).alias("cross_file"), (F.col("src_layer") != F.col("dst_layer")).alias("cross_layer"))


def expanded(primary: DataFrame, edges: DataFrame, first: int = 5, each: int = 10, most: int = config.MAX_EXPANSION_CHUNKS, factor: float = 0.7, depth: int = 2, callers_only: bool = False) -> DataFrame:
    """query, id, score: neighbours of a query's first chunks (query, id, score, rank), at factor times their score.

    Of each of the first chunks, `each` neighbours in order of id; those among the query's own chunks are left out, one that several bring counts once, at its best;
    at most `most` a query. Neighbours are nodes within `depth` steps either way, or callers alone."""
    top = primary.where(F.col("rank") <= first)
    asked = top.select("id").distinct()
    near = related(edges, asked, "called_by").where("id <> query").select("query", "id") if callers_only else neighbours(edges, asked, depth)
    near = near.withColumnRenamed("query", "chunk").withColumnRenamed("id", "near")
    cut_each = near.withColumn("n", F.row_number().over(Window.partitionBy("chunk").orderBy("near"))).where(F.col("n") <= each)
    pairs = top.select("query", F.col("id").alias("chunk"), "score", "rank").join(cut_each, "chunk")
    new = pairs.join(primary.select("query", F.col("id").alias("near")), ["query", "near"], "left_anti")
    best = new.withColumn("b", F.row_number().over(Window.partitionBy("query", "near").orderBy("rank", "chunk"))).where("b = 1")
    kept = best.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank", "near"))).where(F.col("k") <= most)
    return kept.select("query", F.col("near").alias("id"), F.round(F.col("score") * factor, 8).alias("score"))


def file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between files that functions' edges make, none to itself."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("file").alias("from_file")), nodes.select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    return edges.join(a, "src").join(b, "dst").where("from_file <> to_file").select("from_file", "to_file").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """a, b with edges both ways, a < b."""
    return edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), ["a", "b"], "left_semi")

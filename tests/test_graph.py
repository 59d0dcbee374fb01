"""Cycles and components against brute force on small graphs of several shapes."""

import random

import pytest

from quarry.operators import graph


def listed(edges, longest):
    out, after = set(), {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def walk(path):
        for b in after.get(path[-1], ()):
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                walk([*path, b])

    for a in after:
        walk([a])
    return {c for c in out if len(c) <= longest}


def components(edges):
    nodes = {x for e in edges for x in e}
    after = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    to = {n: reach(n) for n in nodes}
    return {n: max(m for m in nodes if m in to[n] and n in to[m]) for n in nodes if any(m != n and m in to[n] and n in to[m] for m in nodes)}


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


GRAPHS = {
    "random": random_graph(14, 40, 1),
    "hub": [(0, n) for n in range(1, 12)] + [(n, 0) for n in range(1, 12)] + [(3, 4), (4, 5), (5, 3), (9, 9)],
    "complete": [(a, b) for a in range(5) for b in range(5)],
    "none": [(a, a + 1) for a in range(9)],
}


@pytest.mark.parametrize("shape", GRAPHS)
@pytest.mark.parametrize("longest", [1, 5])
def test_cycles(spark, shape, longest):
    edges = GRAPHS[shape]
    rows = graph.cycles(spark.createDataFrame(edges + edges[:3], "src long, dst long"), longest).collect()
    got = [tuple(r.nodes) for r in rows]
    assert len(got) == len(set(got)) and set(got) == listed(edges, longest)


RING = [(n, (n + 1) % 9) for n in range(9)]
SHAPES = {**GRAPHS, "chain_of_rings": RING + [(7, 1000), (1000, 1001), (1001, 1002), (1002, 1000), (1001, 1005)], "pair": [(1, 2), (2, 1)]}


@pytest.mark.parametrize("shape", SHAPES)
def test_strong_components(spark, shape):
    edges = SHAPES[shape]
    found = graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    sizes = {}
    for r in found:
        sizes[r.component] = sizes.get(r.component, 0) + 1
    assert {r.id: r.component for r in found if sizes[r.component] > 1} == components(edges)


def test_cycles_of_no_edges(spark):
    assert graph.cycles(spark.createDataFrame([], "src long, dst long"), 4).count() == 0


def test_rounds_move_nodes_and_not_edges(spark, monkeypatch):
    """F16, F24: edges are written once as lists, not met again in each round; lists of a hub are cut."""
    edges = spark.createDataFrame(GRAPHS["hub"], "src long, dst long")
    monkeypatch.setattr(graph, "LIST", 4)
    lists = graph.listed(edges, "src", "dst").collect()
    assert len([r for r in lists if r.id == 0]) > 1 and sorted((r.id, x) for r in lists for x in r.to) == sorted(GRAPHS["hub"])
    assert sorted(r.id for r in graph.on_cycles(edges).collect()) == list(range(12))
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(df.columns) or cut(df))
    graph.on_cycles(spark.createDataFrame([(n, (n + 1) % 9) for n in range(9)], "src long, dst long")).count()
    assert written.count(["src", "dst"]) == 1


def test_the_longest_half_of_a_cycle_is_not_written(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or cut(df))
    edges = [(a, b) for a in range(5) for b in range(5) if a != b]
    assert graph.cycles(spark.createDataFrame(edges, "src long, dst long"), 4).count() == 10 + 20 + 30
    assert sum("start" in columns for columns in written) == 2

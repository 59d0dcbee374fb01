"""The vector index against all pairs: whole results by the exact second pass, recall without it, files and blocks that are split."""

import numpy as np
import pytest

from quarry.operators import search, vectors

K = 15


def brute(rows, asks, k):
    scores = np.round(np.maximum(np.array([v for _, v in asks]) @ np.array([v for _, v in rows]).T, 0), 6)
    ids = np.array([i for i, _ in rows])
    return {(q, int(ids[n]), float(s[n]), at) for (q, _), s in zip(asks, scores, strict=True) for at, n in enumerate(np.lexsort((ids, -s))[:k], 1)}


def result(df):
    return {(r["query"], r.id, r.score, r["rank"]) for r in df.collect()}


def clustered(n, width, groups, noise, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tables(spark):
    """Clusters, one row in three a copy of one vector, lengths that differ, a vector of zeros."""
    rows = clustered(3000, 24, 60, 0.4, 1)
    rows[::3] = rows[0]
    rows[1::7] *= 1.7
    rows[5] = 0
    listed = [(i * 13 % 4001, v.tolist()) for i, v in enumerate(rows)]
    asks = listed[1::90]
    made = spark.createDataFrame(listed, "id long, v array<double>").repartition(5)
    return listed, asks, made, spark.createDataFrame(asks, "query long, q array<double>")


def test_exact_pass_equals_all_pairs(tables):
    rows, asks, df, queries = tables
    index = vectors.build(df, 40, 800, 200)
    assert result(vectors.nearest(index, queries, K, 2, True, 8)) == brute(rows, asks, K)


def test_recall_of_the_nearest_cells(spark):
    rows = list(enumerate(clustered(4000, 32, 80, 0.5, 2).tolist()))
    asks = rows[::100]
    index = vectors.build(spark.createDataFrame(rows, "id long, v array<double>"), 64, 2000)
    got = result(vectors.nearest(index, spark.createDataFrame(asks, "query long, q array<double>"), K, 8, False))
    want = {x[:2] for x in brute(rows, asks, K)}
    assert len(want & {x[:2] for x in got}) >= 0.95 * len(want)


def test_every_row_is_indexed_in_files_of_bounded_size(spark, tables):
    rows, _, df, _ = tables
    index = vectors.build(df, 40, 800, 200)
    held = spark.read.parquet(index.place)
    assert held.select("id").distinct().count() == held.count() == len(rows)
    sizes = held.selectExpr("_metadata.file_path AS f").groupBy("f").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 200


def test_nulls_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    alike = df.where("id <> 5")
    queries = spark.createDataFrame([(9, [0.0, 1.0]), (10, None), (11, [])], "query long, q array<double>")
    got = result(vectors.nearest(vectors.build(alike, 2), queries, 2, 1, True))
    assert got == {(9, 4, 1.0, 1), (9, 6, 0.8, 2)}
    assert vectors.build(df.limit(0)) is None and vectors.nearest(None, queries, 2).count() == 0
    assert vectors.nearest(vectors.build(alike, 2), queries.limit(0), 2).count() == 0
    assert search.nearest(alike.where("id = 1"), queries.where("query = 9"), 1).first()["score"] == 0.0


def test_a_cell_is_one_file_and_pairs_go_to_many_tasks(spark, monkeypatch):
    rows = list(enumerate(clustered(2000, 8, 20, 0.4, 3).tolist()))
    index = vectors.build(spark.createDataFrame(rows, "id long, v array<double>").repartition(16), 20, 2000)
    files = spark.read.parquet(index.place).selectExpr("cell", "_metadata.file_path AS f").distinct()
    assert files.count() == files.select("cell").distinct().count()
    held, cut = [], vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda df: held.append(cut(df)) or held[-1])
    vectors.nearest(index, spark.createDataFrame(rows[::100], "query long, q array<double>"), K, 20, False)
    assert held[-1].rdd.getNumPartitions() >= 15


def test_rows_below_the_floor_stay_in_their_task(spark):
    rows = list(enumerate(clustered(600, 8, 6, 0.4, 4).tolist()))
    index = vectors.build(spark.createDataFrame(rows, "id long, v array<double>"), 6, 600)
    want = brute(rows, rows[:5], K)
    floors = {q: min(score for query, _, score, _ in want if query == q) for q, _ in rows[:5]}
    asked = spark.createDataFrame([(q, v, floors[q]) for q, v in rows[:5]], "query long, q array<double>, floor double")
    got = vectors._pass(spark, index, asked, K, 0, 8).collect()
    assert {(r["query"], r.id, r.score) for r in got} >= {x[:3] for x in want} and all(r.score >= floors[r["query"]] for r in got)


def test_the_best_of_raw_products():
    rng = np.random.default_rng(6)
    products = np.round(rng.normal(size=(9, 400)), 2) * 0.3 + rng.choice([0, 4e-7, -4e-7], (9, 400))
    products[0] = -1
    products[1, 50:] = 0
    ids, best = rng.permutation(400), search.Best(9, 7)
    for at in range(0, 400, 37):
        best.add(products[:, at : at + 37], ids[at : at + 37])
    scores = np.round(np.maximum(products, 0), 6)
    for n in range(9):
        order = np.lexsort((ids, -scores[n]))[:7]
        assert best.id[n].tolist() == ids[order].tolist() and best.score[n].tolist() == scores[n][order].tolist()

"""Exact values of single operators."""

import random
from pyspark.sql import functions as F

from quarry.operators import chunks, context, filters, folds, graph, parsing, resolve, search, stats
from quarry.sources import repository, stores


def test_entry_point_module_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_fill_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([50, 60, 30, 25, None, 20])] + [("b", 0, 500), ("b", 1, 400), ("c", 0, 500), ("c", 1, 50), (None, 0, 7)], "k string, i int, n int")
    got = {(r.k, r.i): (r.accepted, r.used) for r in folds.greedy_fill(rows, "k", ["i"], "n", 100).collect()}
    want = {("a", 0): (True, 50), ("a", 1): (False, 50), ("a", 2): (True, 80), ("a", 3): (False, 80), ("a", 4): (True, 80), ("a", 5): (True, 100)}
    assert got == want | {("b", 0): (False, 0), ("b", 1): (False, 0), ("c", 0): (False, 0), ("c", 1): (True, 50), (None, 0): (True, 7)}
    kept = {(r.k, r.i): (r.accepted, r.used) for r in folds.greedy_fill(rows, "k", ["i"], "n", 100, at_least_one=True).collect()}
    assert kept == got | {("b", 0): (True, 500)}
    assert folds.greedy_fill(rows.limit(0), "k", ["i"], "n", 100, at_least_one=True).count() == 0


def test_binary_heuristic(spark):
    rows = spark.createDataFrame([("text\n" * 10,), ("\x00" * 5 + "x" * 95,), ("\x01\x02\x03x",), ("",), ("\u0085\u200b\u00a0x",), ("é ü\t日本\r\n",), ("\u0378" * 4 + "x" * 6,)], "t string")
    assert [r[0] for r in rows.select(filters.likely_binary(F.col("t"))).collect()] == [False, True, True, False, True, False, True]
    texts = [r.t for r in rows.collect() if r.t]
    odd = lambda t: sum(not c.isprintable() and c not in "\n\r\t" for c in t) / len(t) > 0.3 or t.count("\0") / len(t) > 0.01
    assert [odd(t) for t in texts] == [r[0] for r in rows.where("t <> ''").select(filters.likely_binary(F.col("t"))).collect()]


def test_split_lines_overlaps():
    text = "".join(f"line {i:03d} " + "x" * 70 + "\n" for i in range(40))
    groups = chunks.split_lines(text)
    assert len(groups) > 1 and all(len(g) // 4 <= 200 + 20 for g in groups)
    assert all(b.startswith(a.splitlines(keepends=True)[-1]) or a.splitlines(keepends=True)[-1] in b for a, b in zip(groups, groups[1:], strict=False))
    assert chunks.split_lines("x" * 5000) == ["x" * 5000]


def test_shortest_path_prefers_first_in_order(spark):
    edges = spark.createDataFrame([(0, 2), (0, 1), (1, 3), (2, 3), (3, 0)], "src long, dst long")
    got = graph.shortest_paths(edges, 0, spark.createDataFrame([(3,), (9,)], "id long")).collect()
    assert [(r.id, r.path) for r in got] == [(3, [0, 1, 3])]


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (6, 1)], "src long, dst long")
    assert {(r.id, r.component) for r in graph.strong_components(edges).collect()} == {(1, 2), (2, 2), (3, 5), (4, 5), (5, 5)}
    assert {r.id for r in graph.on_cycles(edges).collect()} == {1, 2, 3, 4, 5}
    assert graph.on_cycles(edges.limit(0)).count() == 0


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert graph.neighbours(edges, spark.createDataFrame([(1,)], "id long")).count() == 0
    assert stats.in_degrees(edges).count() == 0


def test_last_turns(spark):
    turns = spark.createDataFrame([(1, i, f"q{i}", "a" * (400 if i == 4 else 1)) for i in range(1, 5)], "conv_id long, turn long, question string, answer string")
    text = context.history(turns).first().history
    assert "q1" not in text and text.index("q2") < text.index("q3") < text.index("q4") and text.endswith("a" * 297 + "...")


def test_python_that_does_not_compile():
    kinds = [e[1] for e in parsing.parse("x.py", "def a(:\n  pass\nclass B:\n", "Python")]
    assert "error" in kinds and "function" in kinds and "class" in kinds
    assert parsing.parse("x.py", "", "Python") == [] and parsing.parse("x.js", "x" * 20_000, "JavaScript") == []


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, stores.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"\xef\xbb\xbfx = 1\r\ny\r")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    got = {r.path: r.text for r in repository.scan_tree(spark, str(tmp_path)).select("path", repository.decoded(F.col("raw")).alias("text")).collect()}
    assert got == {"src/a.py": "x = 1\ny\n", "b.txt": "café"}


def test_nearest_by_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(30)] + [(99, [])], "id long, v array<float>")
    queries = vectors.where("id < 3").select(F.col("id").alias("query"), F.col("v").alias("q"))
    want = sorted((q, i, 1.0) for q in range(3) for i in range(q, 12, 3))
    for block in (1, 2048):
        got = search.nearest(vectors.repartition(4), queries, 4, block).collect()
        assert sorted((r["query"], r.id, r.score) for r in got) == want
    assert search.nearest(vectors, queries.limit(0), 4).count() == 0


def test_bm25_by_blocks(spark):
    """Against the formula, whatever the blocks; documents of score 0 fill up what is missing."""
    import math
    import random

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefghij", [9, 8, 7, 3, 2, 1, 1, 1, 1, 1], k=rng.randrange(30)))) for i in range(60)] + [(60, None), (61, "  "), (62, "other words alone")]
    asks = [(q, " ".join(rng.choices("abcdefghijz", k=4))) for q in range(9)] + [(9, "nothing here"), (10, " "), (11, None)]
    split = {i: (t or "").split() for i, t in docs}
    df = {t: sum(t in w for w in split.values()) for w in split.values() for t in w}
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    weight = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    mean = sum(map(len, split.values())) / len(docs)
    want = set()
    for q, text in asks:
        scores = [(-round(sum(weight.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in (text or "").split()), 6), i) for i, w in split.items()]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:10], 1)} if (text or "").split() else set()
    rows, questions = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asks, "query long, text string")
    for block in (3, 2048):
        assert {(r["query"], r.id, r.score, r["rank"]) for r in search.bm25(rows.repartition(70), questions, 10, block).collect()} == want


def test_shortest_paths_of_any_length(spark, tmp_path):
    """r07 against a brute-force search, on a sparse graph whose targets lie up to eleven steps away."""
    from quarry.plans import catalog

    pairs = [(a, a + 1) for a in range(9)] + [(9, 100), (4, 200), (3, 201), (201, 200), (400, 0), (100, 500)]
    lines = [row for order, (a, b) in enumerate(pairs) for row in ((order, a, 1), (order, b, 2))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "n", "f", "l", 1) for i in (*range(10), 100, 200, 201, 300, 400, 500)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    best, frontier = {0: [0]}, [[0]]
    while frontier:
        longer = sorted([*p, b] for p in frontier for a, b in pairs if a == p[-1] and b not in best)
        frontier = [p for i, p in enumerate(longer) if p[-1] not in {q[-1] for q in longer[:i]}]
        best |= {p[-1]: p for p in frontier}
    want = {i: ">".join(map(str, p)) for i, p in best.items() if i % 100 == 0}
    assert {0, 100, 200, 500} == set(want)
    assert {r.id: r.path for r in catalog.QUERIES["r07_shortest_paths"](spark, str(tmp_path)).collect()} == want


def test_ask_from_question_to_sources(spark):
    """A small repository, worked out by hand: a question about callers, one whose pronoun stands for the last answer's class, and an empty one."""
    from quarry.plans import pipeline

    docs = spark.createDataFrame(
        [
            (1, "def load_user alpha beta", "a.py", "function", "load_user", 10, False), (2, "class UserService gamma", "b.py", "class_summary", "UserService", 1, False),
            (3, "def save delta", "a.py", "function", "save", 2, True), (4, "word " * 4000, "c.py", "function", "big", 1, False),
        ],
        "id long, text string, file string, chunk_type string, name string, start_line long, is_entry boolean",
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.6, 0.8, 0.0]), (4, [0.9, 0.0, 0.43589])], "id long, v array<float>")
    asked = [(1, "what calls load_user", None, None), (2, "Where is it", "Q: hi\nA: See UserService or load_user", "See UserService or load_user"), (3, " ", None, None)]
    questions = spark.createDataFrame([(*q, None) for q in asked], "query long, text string, history string, previous string, cited array<string>")
    asked_vectors = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0]), (2, 0, [0.0, 1.0, 0.0])], "query long, kind int, q array<float>")
    names, edges = spark.createDataFrame([("load_user", 1)], "name string, id long"), spark.createDataFrame([(3, 1), (1, 2)], "src long, dst long")
    got = {r["query"]: r for r in pipeline.ask(questions, docs, vectors, asked_vectors, names, edges).collect()}
    save, load, service = "Function: save\ndef save delta", "Function: load_user\ndef load_user alpha beta", "Class: UserService\nclass UserService gamma"
    # the class isn't a function, the long chunk doesn't fit, a file's chunks come in order of lines
    assert got[1].context == f"{save}\n\n---\n\n{load}" and (got[1].type, got[1].chunks, got[1].citations, got[1].confidence) == ("what_calls", 2, 2, "medium")
    assert got[1].answer == f"According to the code: {got[1].context}\n\n---\nSources:\n• a.py:10-10 — load_user\n• a.py:2-2 — save"
    assert got[2].type == "where_is" and got[2].context == f"{service}\n\n---\n\n{save}\n\n---\n\n{load}"
    assert got[2].answer.endswith("Sources:\n• b.py:1-1 — UserService\n• a.py:2-2 — save\n• a.py:10-10 — load_user")
    assert (got[3].chunks, got[3].confidence, got[3].context) == (0, "low", None) and got[3].answer.startswith("No relevant code was found.")
    # neighbours of a question about relations that isn't about callers alone
    kinds = spark.createDataFrame([(1, "general", True, False), (2, "general", False, False)], "query long, type string, graph_query boolean, multi_hop boolean")
    primary = spark.createDataFrame([(1, 3, 1.0, 1), (2, 3, 1.0, 1)], "query long, id long, score double, rank int")
    assert sorted(map(tuple, pipeline.expanded(primary, kinds, edges).collect())) == [(1, 1, 0.7), (1, 2, 0.7)]


def test_paths_with(spark):
    """Texts of any length against a comparison with every path."""
    rng = random.Random(9)
    paths = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    asked = [["".join(rng.choice("ab/.c") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 3))] for _ in range(150)]
    got = resolve.paths_with(spark.createDataFrame([(a,) for a in asked], "parts array<string>"), spark.createDataFrame([(p,) for p in paths], "path string"), 2)
    want = {(tuple(a), p) for a in asked for p in sorted({p for p in paths if all(x in p for x in a)})[:2]}
    assert {(tuple(r.parts), r.path) for r in got.collect()} == want


def test_a_key_of_many_rows_is_not_one_task(spark, monkeypatch):
    """rows of a frequent key, or of none, don't go through the join that deals rows by key."""
    from quarry.operators import resolve

    monkeypatch.setattr(resolve, "OFTEN", 5)
    rows = spark.createDataFrame([(n, "same" if n < 50 else "absent" if n < 90 else None if n < 95 else f"k{n}") for n in range(100)], "n long, key string")
    known = spark.createDataFrame([("same", 1), ("k96", 2), ("other", 3)], "key string, value long")
    got = {(r.n, r.key, r.value) for r in resolve.spread_join(rows, known, "key").collect()}
    assert got == {(r.n, r.key, {"same": 1, "k96": 2}.get(r.key)) for r in rows.collect()}
    imports = spark.createDataFrame([(f"d{n}/a.py", "com.x.Tool" if n % 2 else ".b", "Python") for n in range(40)], "file_path string, module string, language string")
    paths = spark.createDataFrame([(f"d{n}/b.py",) for n in range(40)] + [("lib/Tool.py",)], "path string")
    found = {(r.file_path, r.target) for r in resolve.import_files(imports, paths).collect()}
    assert found == {(f"d{n}/a.py", "lib/Tool.py" if n % 2 else f"d{n}/b.py") for n in range(40)}


def test_entry_points_search_each_text_once(spark):
    """the texts' signals are tested in one place of the plan, and by no pattern."""
    import re

    from quarry.operators import rules

    columns = "path string, language string, body string, has_main_block boolean, has_exports boolean, flagged boolean, imported boolean, imports_others boolean, main_functions int, static_main boolean"
    rows = [("d/a.py", "Python", "x\napp = Flask(1)", False, False, False, True, False, 0, False), ("d/b.py", "Python", "x", False, False, False, True, False, 0, False), ("d/c.py", "Python", None, True, False, False, True, False, 0, False)]
    found = rules.entry_points(spark.createDataFrame(rows, columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "gin" in plan and not re.search("RLIKE", plan) and plan.count("gin.New()") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("d/a.py", 2, "web", "low"), ("d/c.py", 3, "main_block", "medium")]

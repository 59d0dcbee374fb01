"""Queries against their SQL on small tables with what only larger ones have: far nodes, many ids, texts that cancel out."""

import pyarrow as pa
import pytest
from pyarrow import parquet

from quarry.plans import catalog
from tests.compare import same


@pytest.fixture
def held(spark, tmp_path):
    """Holds a query against its SQL over the tables that are given."""
    import duckdb

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for table, rows in tables.items():
            parquet.write_table(pa.table(rows), tmp_path / f"{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
        return con.sql(catalog.ORACLES[name]).fetchall()

    return check


def parts(ids):
    return {"p_partkey": pa.array(ids, pa.int64()), "p_name": [f"name {i}" for i in ids], "p_brand": ["b"] * len(ids), "p_type": ["t"] * len(ids), "p_size": pa.array([1] * len(ids), pa.int32())}


def lines(edges):
    """An order of two lines for each edge."""
    return {"l_orderkey": pa.array([n for n, _ in enumerate(edges) for _ in "ab"], pa.int64()), "l_partkey": pa.array([x for e in edges for x in e], pa.int64()), "l_linenumber": pa.array([1, 2] * len(edges), pa.int32())}


FAR = [0, *range(1, 13), 500]


def test_paths_end_at_the_stated_length(held):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 100), (4, 5), (5, 200), (0, 7), (7, 300)]
    rows = held("r07_shortest_paths", part=parts([0, 1, 2, 3, 4, 5, 7, 100, 200]), lineitem=lines(edges))
    assert sorted(r[0] for r in rows) == [0, 100, 300]


def test_levels_end_at_the_stated_depth(held):
    rows = held("r04_call_depth", part=parts(FAR), lineitem=lines(list(zip(FAR, FAR[1:], strict=False))))
    assert max(depth for _, depth in rows) == 12


def test_shifted_ids_of_many_parts(held):
    rows = held("r10_has_node", part=parts([1, 2, 3, 100_001, 200_002, 200_001]))
    assert sum(known for _, known, _ in rows) == 2


def test_words_that_cancel_out_have_a_vector(held):
    from zlib import crc32

    signs = {}
    for n in range(5000):
        h = crc32(f"w{n}".encode())
        signs.setdefault(h % 384, {})[h >> 16 & 1] = f"w{n}"
    texts = [" ".join(x.values()) for x in signs.values() if len(x) == 2][:3]
    rows = held("x14_embedding", documents={"doc_id": pa.array(range(6), pa.int64()), "text": [*texts, "", None, "one two"]})
    assert sorted(r[2] for r in rows) == [0, 0, 1, 1, 1, 1]


def test_files_without_entities_are_no_nodes_and_files_are_parsed_once(spark, held, tmp_path):
    rows = held("g01_nodes", documents={"doc_id": pa.array([1, 2], pa.int64()), "text": ["short", "x" * 50_000]})
    assert sorted(r[0] for r in rows) == ["src/1/b.js", "src/1/e.go"]
    plan = catalog.QUERIES["g01_nodes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1


def test_no_characters_are_in_every_path(spark):
    from quarry.operators import resolve

    paths = spark.createDataFrame([("a/b.py",), ("c.py",), ("d.py",)], "path string")
    got = resolve.paths_with(spark.createDataFrame([([""],), (["", "y"],), (["py", "a/b"],)], "parts array<string>"), paths, 2).collect()
    assert sorted((r.parts, r.path) for r in got) == [([""], "a/b.py"), ([""], "c.py"), (["", "y"], "a/b.py"), (["", "y"], "c.py"), (["py", "a/b"], "a/b.py")]


def test_parts_leave_before_a_batch_is_split():
    from quarry.operators import chunks

    n = 10 * chunks.ROWS
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["f"] * n), pa.array(["function"] * n), pa.array(["x = 1\n" * 2000] * n)], ["id", "name", "chunk_type", "content"])
    sizes = [b.num_rows for b in chunks.splitted(iter([batch]))]
    assert len(sizes) >= 10 and max(sizes) < sum(sizes) / 5


def test_a_chunk_of_the_index_ends_inside_a_batch(monkeypatch):
    from quarry.operators import inverted

    monkeypatch.setattr(inverted, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    words = [[f"w{d % 7}", f"v{d}", "all"] for d in range(100)] + [["long"] * 50, [], ["last"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words, pa.list_(pa.string()))], ["id", "listed"])
    rows = [r for b in inverted._posted(3.0, 30, 256)(iter([batch.slice(0, 90), batch.slice(90)])) for r in b.to_pylist()]
    docs = {}
    for r in rows:
        docs.setdefault(r["chunk"], set()).update(r["ids"])
    assert sorted(d for ids in docs.values() for d in ids) == [d for d, w in enumerate(words) if w]
    assert all(sum(len(words[d]) for d in sorted(ids)[:-1]) < 30 for ids in docs.values())
    assert {(r["term"], d) for r in rows for d in r["ids"]} == {(w, d) for d, x in enumerate(words) for w in x}


def test_few_questions_are_probed_together():
    import numpy as np

    from quarry.operators import vectors

    n, centres = 5 * vectors.PROBED, np.eye(4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([[1.0, 0.5, 0.2, 0.1]] * n), pa.array([0.0] * n)], ["query", "q", "floor"])
    out = list(vectors._probe(centres, np.zeros(4), np.ones(4), 1)(iter([batch])))
    assert max(b.num_rows for b in out) <= 4 * vectors.PROBED and sum(b.num_rows for b in out) == 3 * n


def sources(ids, texts):
    return {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": ["src1"] * len(ids), "n_chars": pa.array([1] * len(ids), pa.int32())}


def test_a_mirror_keeps_files_of_one_path_and_of_no_content(held):
    rows = held("s07_mirror", documents=sources([1, 1, 1, 2, 3, 4], ["one", "one", "one", None, "", "é"]))
    assert sorted(size is None for _, _, size, _ in rows) == [False] * 5 + [True] and len({destination for _, destination, _, _ in rows}) == 5


def test_a_scan_lists_files_of_one_path_and_of_no_content(held):
    rows = held("s01_tree_scan", documents=sources([1, 1, 1, 2, 3, 3, 4], ["one", "two", "three", None, "", None, "é"]))
    assert len(rows) == 7 and sum(sha is None for _, sha, _, _ in rows) == 2


def test_a_scan_finds_empty_files_and_names_that_spark_hides(spark, tmp_path):
    from quarry.sources import repository

    held = {"a/__init__.py": b"", "a/.env/x": b"1", "_b.py": b"22", "c d%20.py": b"333", "a/b/c/d.md": b""}
    for path, raw in held.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    (tmp_path / "none").mkdir()
    rows = repository.scan_tree(spark, f"file://{tmp_path}").collect()
    assert {r.path: bytes(r.raw) for r in rows} == held and all(r.size_bytes == len(r.raw) and r.modified for r in rows)
    assert {r.path for r in repository.list_tree(spark, str(tmp_path), "*.py").collect()} == {"a/__init__.py", "_b.py", "c d%20.py"}


def test_entity_tables_hold_no_texts(spark, monkeypatch):
    from quarry.operators import graph

    held, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: held.append(df.columns) or cut(df))
    from tests.conftest import SF

    catalog.QUERIES["p11_entity_tables"](spark, SF)
    assert held == [["path", "kind"]]

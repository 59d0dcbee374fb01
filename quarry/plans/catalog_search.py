"""Queries of retrieval (x11-x16, x24, j09-j11, j14, t01-t05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import graph, search, vectors
from quarry.plans.fixtures import ddb, each_document, planted, table, view
from quarry.plans.registry import query

_BM = f"""tok AS MATERIALIZED (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents),
  post AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS MATERIALIZED (SELECT doc_id AS id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT id AS doc_id, count(*) AS n FROM tok GROUP BY id) USING (doc_id)),
  nn AS MATERIALIZED (SELECT count(*) AS docs, avg(n) AS mean FROM len), raw AS MATERIALIZED (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), nn),
  idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN {config.BM25_EPSILON} * mean_raw ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean_raw FROM raw)),
  ask AS (SELECT item_id AS query, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark), w AS MATERIALIZED (SELECT query, term, count(*) AS times FROM ask GROUP BY ALL),
  pos AS MATERIALIZED (SELECT query, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM w JOIN idf USING (term) JOIN post USING (term) JOIN len USING (id), nn GROUP BY query, id),
  bm AS (SELECT q.query, d.id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query FROM w) q CROSS JOIN len d LEFT JOIN pos p ON p.query = q.query AND p.id = d.id),
  kw AS MATERIALIZED (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= {config.TOP_KEYWORD})"""
_COS = f"""cs AS (SELECT q.vec_id AS query, v.vec_id AS id, round(greatest(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 0), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
  sem AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= {config.TOP_SEMANTIC})"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: all benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir), config.TOP_KEYWORD)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated query set: those whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows, rows.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(*_vectors(spark, sf_dir), config.TOP_SEMANTIC)


@query("x11_tokens", "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lengths(_docs(spark, sf_dir)).toDF("doc_id", "words")


@query("x12_bm25", f"WITH {_BM} SELECT query, id, score, rank FROM kw")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("x12_idf", f"WITH {_BM} SELECT term, round(idf, 6) AS idf FROM idf")
def x12_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.idf(_docs(spark, sf_dir)).select("term", F.round("idf", 6).alias("idf"))


@query("x13_cosine", f"WITH {_COS} SELECT query, id, score, rank FROM sem")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("x13_vector_index", f"WITH {_COS} SELECT query, id, score, rank FROM sem")
def x13_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the index: the nearest cells, then every other cell that can hold a better row."""
    rows, queries = _vectors(spark, sf_dir)
    return vectors.nearest(vectors.build(rows), queries, config.TOP_SEMANTIC, exact=True).withColumn("rank", F.col("rank").cast("long"))


_MIX = f"""ra AS (SELECT query, id, score FROM sem), rk AS (SELECT query // 5 * 100 AS query, id, max(score) AS score FROM kw GROUP BY 1, 2), nk AS (SELECT query, id, round(score / CASE WHEN max(score) OVER (PARTITION BY query) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query) END, 6) AS score FROM rk),
  mg AS (SELECT coalesce(a.query, k.query) AS query, coalesce(a.id, k.id) AS id, coalesce(a.score, 0) AS semantic, coalesce(k.score, 0) AS keyword, CASE WHEN k.id IS NULL THEN 'semantic' WHEN a.id IS NULL THEN 'keyword' ELSE 'semantic+keyword' END AS source FROM ra a FULL JOIN nk k ON a.query = k.query AND a.id = k.id),
  fu AS (SELECT *, round(least(0.65 * semantic + 0.35 * keyword + CASE WHEN semantic > 0 AND keyword > 0 THEN 0.1 ELSE 0 END, 1), 8) AS score FROM mg)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and texts share ids; a benchmark item asks along with vector 100 * (item // 5)."""
    keyword = _keyword(spark, sf_dir).select((F.expr("query div 5") * 100).alias("query"), "id", "score").groupBy("query", "id").agg(F.max("score").alias("score"))
    none = keyword.where("false").select("query", "id", "score")
    return search.merged(_semantic(spark, sf_dir).select("query", "id", "score"), search.normalised(keyword), none)


@query("j10_candidate_merge", f"WITH {_BM}, {_COS}, {_MIX} SELECT * FROM mg")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


@query("x15_fusion", f"WITH {_BM}, {_COS}, {_MIX} SELECT query, id, score FROM fu")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fused(_mixed(spark, sf_dir)).select("query", "id", "score")


@query("t03_rerank", f"WITH {_BM}, {_COS}, {_MIX} SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= {config.TOP_FINAL}")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.fused(_mixed(spark, sf_dir)), config.TOP_FINAL).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("t01_semantic_topk", f"WITH {_COS} SELECT query, id, rank FROM sem WHERE rank <= {config.TOP_HYDE}")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).where(F.col("rank") <= config.TOP_HYDE).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("t02_keyword_topk", f"WITH {_BM} SELECT query, id, round(score / CASE WHEN max(score) OVER (PARTITION BY query) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query) END, 6) AS score FROM kw")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.normalised(_keyword(spark, sf_dir)).select("query", "id", "score")


@query("x24_rrf", f"WITH {_BM}, {_COS}, a AS (SELECT query, id, rank FROM sem UNION ALL SELECT query // 5 * 100, id, rank FROM kw) SELECT query, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM a GROUP BY query, id")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = _keyword(spark, sf_dir).select((F.expr("query div 5") * 100).alias("query"), "id", "rank")
    return search.reciprocal_ranks(_semantic(spark, sf_dir).select("query", "id", "rank").unionByName(keyword))


_TYPED = "ty AS (SELECT query, id, score, CASE (query // 100) % 3 WHEN 0 THEN 'where_is' WHEN 1 THEN 'what_calls' ELSE 'general' END AS type, id % 4 = 0 AS is_entry, CASE id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class_summary' ELSE 'method' END AS chunk_type FROM sem)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.expr("(query div 100) % 3")
    kind = F.when(turn == 0, "where_is").when(turn == 1, "what_calls").otherwise("general")
    chunk = F.when(F.col("id") % 3 == 0, "function").when(F.col("id") % 3 == 1, "class_summary").otherwise("method")
    return _semantic(spark, sf_dir).select("query", "id", "score", kind.alias("type"), (F.col("id") % 4 == 0).alias("is_entry"), chunk.alias("chunk_type"))


@query("t04_where_is_penalty", f"WITH {_COS}, {_TYPED}, p AS (SELECT query, id, CASE WHEN type = 'where_is' AND is_entry THEN round(score * 0.8, 6) ELSE score END AS score FROM ty) SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.penalised(_typed(spark, sf_dir)).select("query", "id", "score"), config.TOP_SEMANTIC).withColumn("rank", F.col("rank").cast("long"))


@query("x16_functions_only", f"WITH {_COS}, {_TYPED} SELECT query, id, chunk_type FROM ty WHERE type <> 'what_calls' OR chunk_type IN ('function', 'method') OR NOT EXISTS (SELECT 1 FROM ty o WHERE o.query = ty.query AND o.chunk_type IN ('function', 'method'))")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.functions_only(_typed(spark, sf_dir)).select("query", "id", "chunk_type")


@query("t05_priority", f"WITH {_COS}, {_TYPED} SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY NOT is_entry, score DESC, id) AS place FROM ty")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.context import prioritised

    rows = _typed(spark, sf_dir).withColumn("source", F.when(F.col("is_entry"), "entity").otherwise("semantic"))
    return prioritised(rows).select("query", "id", F.col("place").cast("long").alias("place"))


@query("j09_entity_lookup", "SELECT DISTINCT item_id AS query, id FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS name FROM benchmark) e JOIN (SELECT lower(string_split(text, ' ')[1]) AS name, min(doc_id) AS id FROM documents GROUP BY 1) n USING (name)")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _docs(spark, sf_dir).groupBy(F.lower(F.get(F.split("text", " "), 0)).alias("name")).agg(F.min("id").alias("id"))
    asked = _questions(spark, sf_dir).select("query", F.split(F.lower("text"), " ").alias("entities"))
    return search.looked_up(asked, index)


@query("j11_neighbour_chunks", f"WITH RECURSIVE {ddb('v_edges', 'v_nodes')} SELECT src AS query, min(dst) AS first_chunk, count(*) AS chunks FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM v_edges WHERE src % 100 = 0) x WHERE n <= 10 GROUP BY src")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "v_nodes").where("id % 100 = 0")
    near = graph.related(view(spark, sf_dir, "v_edges"), asked, "calls").withColumn("score", F.lit(1.0))
    return search.top(near, 10).groupBy("query").agg(F.min("id").alias("first_chunk"), F.count("*").alias("chunks"))


@query("j14_fuzzy_lookup", each_document("('UserService#.process#', '#-2'), ('helper#', '#-5'), ('X.find#', '#-4')", "name", "chunk_id"))
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("#-1", "file_summary", "services/user#.py", "user#"), ("#-2", "method", "UserService#.process#", "process#"), ("#-3", "method", "OrderService#.process#", "process#"), ("#-4", "method", "UserRepo#.find#", "find#"), ("#-5", "function", "helper#", "helper#"), ("#-6", "class_summary", "Finder#", "find#")]
    names = planted(spark, sf_dir, [("UserService#.process#",), ("helper#",), ("X.find#",), ("none#",)], "name string").select("name")
    return search.fuzzy_lookup(names, planted(spark, sf_dir, rows, "chunk_id string, chunk_type string, qualified_name string, simple_name string"))


@query("x14_embedding", "SELECT doc_id AS id, 384 AS dimensions, CAST(CASE WHEN regexp_matches(left(text, 1024), '[\\p{L}\\p{N}_]') THEN 1 ELSE 0 END AS DOUBLE) AS norm FROM documents")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.embedding import embed

    return _docs(spark, sf_dir).select("id", embed(F.col("text")).alias("embedding")).select("id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))

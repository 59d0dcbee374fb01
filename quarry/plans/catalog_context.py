"""Queries of contexts and conversations (c), orders (t05-t10), questions (k14-k17, x17-x20) and jobs (q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import context, rules
from quarry.operators.filters import tokens
from quarry.plans.fixtures import ddb, each_document, planted, quoted, table, view
from quarry.plans.registry import query

TURNS = "WITH RECURSIVE " + ddb("v_turns")
JOBS = "WITH " + ddb("v_jobs")
_CLIP = "CASE WHEN length(answer) > 300 THEN left(answer, 297) || '...' ELSE answer END"
_HIST = f"h AS (SELECT conv_id, string_agg('Q: ' || question || chr(10) || 'A: ' || {_CLIP}, chr(10) || chr(10) ORDER BY turn) AS history FROM (SELECT * FROM v_turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) t GROUP BY conv_id)"


@query("c01_history", f"{TURNS}, {_HIST} SELECT * FROM h")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.history(view(spark, sf_dir, "v_turns"))


@query("c02_token_budget", f"{TURNS}, {_HIST} SELECT conv_id, {config.MAX_CONTEXT_TOKENS} - least(length(history) // 4, {config.MAX_HISTORY_TOKENS}) AS budget FROM h")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.history(view(spark, sf_dir, "v_turns")).select("conv_id", context.token_budget(F.col("history")).alias("budget"))


@query("c03_sessions", f"{TURNS} SELECT conv_id, left(md5(CAST(conv_id AS VARCHAR)), 8) AS session_id, count(*) AS turns, max(turn) AS last_turn FROM v_turns GROUP BY conv_id")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "v_turns").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return turns.withColumn("session_id", F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8))


@query("c04_kept_turns", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.kept_turns(table(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "total")


_CHUNKS = f"""ch AS (SELECT source AS query, doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class_summary' ELSE 'file_summary' END AS chunk_type, 'name' || doc_id AS name,
  'src/f' || (doc_id % 7) || '.py' AS file, doc_id % 50 AS start_line, text AS content, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks that a source's question found, longest first."""
    kind = F.when(F.col("doc_id") % 4 == 0, "function").when(F.col("doc_id") % 4 == 1, "method").when(F.col("doc_id") % 4 == 2, "class_summary").otherwise("file_summary")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("query"), F.col("doc_id").alias("id"), kind.alias("chunk_type"), F.concat(F.lit("name"), F.col("doc_id")).alias("name"),
        F.concat(F.lit("src/f"), F.col("doc_id") % 7, F.lit(".py")).alias("file"), (F.col("doc_id") % 50).alias("start_line"), F.col("text").alias("content"), place.alias("place"),
    )


_BLOCK = "CASE WHEN chunk_type = 'function' THEN 'Function: ' || name WHEN chunk_type = 'method' THEN 'Method: ' || name WHEN chunk_type = 'class_summary' THEN 'Class: ' || name ELSE 'File: ' || file END || chr(10) || content"


def _block():
    return context.block(*(F.col(c) for c in ("chunk_type", "name", "file", "content")))


@query("c05_blocks", f"WITH {_CHUNKS} SELECT id, {_BLOCK} AS block FROM ch")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", _block().alias("block"))


# longest first, so a source's first chunks are often larger than the budget
_FILL = f"""RECURSIVE {_CHUNKS}, sz AS (SELECT *, length(content) // 4 AS tokens FROM ch),
  f AS (SELECT query, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS place, false AS fits, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT query FROM sz) q
    UNION ALL SELECT s.query, s.id, s.place, f.used + s.tokens <= {config.MAX_CONTEXT_TOKENS}, f.used + CASE WHEN f.used + s.tokens <= {config.MAX_CONTEXT_TOKENS} THEN s.tokens ELSE 0 END FROM f JOIN sz s ON s.query = f.query AND s.place = f.place + 1),
  t AS (SELECT query, id, used FROM f WHERE fits UNION ALL SELECT query, id, tokens FROM sz WHERE place = 1 AND query NOT IN (SELECT query FROM f WHERE fits))"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.filled(_chunks(spark, sf_dir).withColumn("tokens", tokens(F.col("content"))))


@query("c07_greedy_fill", f"WITH {_FILL} SELECT query, id, CAST(used AS BIGINT) AS used FROM t")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select("query", "id", "used")


@query("t06_group_by_file", f"WITH {_FILL}, k AS (SELECT s.*, min(s.place) OVER (PARTITION BY s.query, s.file) AS fp FROM t JOIN sz s USING (id)) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY fp, file, start_line, id) AS seat FROM k")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.grouped_by_file(_filled(spark, sf_dir)).select("query", "id", F.col("seat").cast("long").alias("seat"))


@query("c06_context", f"WITH {_FILL}, k AS (SELECT s.*, min(s.place) OVER (PARTITION BY s.query, s.file) AS fp FROM t JOIN sz s USING (id)) SELECT query, string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY fp, file, start_line, id) AS context FROM k GROUP BY query")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.joined(context.grouped_by_file(_filled(spark, sf_dir)).withColumn("block", _block()))


@query("c08_subchunks", "WITH x AS (SELECT source AS query, doc_id AS id, doc_id % 3 > 0 AS is_subchunk, 'f' || (doc_id // 3) AS parent FROM documents) SELECT query, id FROM x WHERE NOT is_subchunk OR NOT EXISTS (SELECT 1 FROM x w WHERE NOT w.is_subchunk AND w.query = x.query AND w.parent = x.parent)")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.expr("doc_id div 3"))
    sub = F.col("doc_id") % 3 > 0
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), sub.alias("is_subchunk"), F.when(~sub, name).alias("qualified_name"), name.alias("parent_function"))
    return context.without_parts(rows).select("query", "id")




_CITING = """WITH x AS (SELECT doc_id, coalesce(text, '') AS content, 'a/b' || doc_id || '.py' AS path, CASE WHEN doc_id % 5 = 0 THEN 'Store.get' || doc_id ELSE 'load' || doc_id END AS name,
  CASE doc_id % 5 WHEN 0 THEN 'see STORE.get' || doc_id || ' for it' WHEN 1 THEN 'it is in B' || doc_id || '.py' WHEN 2 THEN 'it says ' || left(coalesce(text, ''), 80) WHEN 3 THEN 'nothing' ELSE 'reload' || doc_id || 'ed' END AS answer FROM documents)"""


@query("c09_citations", rf"""{_CITING} SELECT doc_id, regexp_matches(lower(answer), '(^|[^a-z0-9_])' || replace(lower(name), '.', '\.') || '($|[^a-z0-9_])') OR contains(lower(answer), 'b' || doc_id || '.py')
  OR len(list_filter(regexp_extract_all(content, '\b[a-zA-Z_][a-zA-Z0-9_]{{3,}}\b'), lambda w: contains(lower(answer), lower(w)))) >= 2 AS cited FROM x""")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk, and an answer that has its name, its file, its first words, nothing or part of a longer word."""
    made = spark.sql(f"{_CITING} SELECT * FROM x".replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return made.select("doc_id", context.cited(*(F.col(c) for c in ("answer", "name", "path", "content"))).alias("cited"))


@query("c10_relevance", f"WITH {_CHUNKS} SELECT id, CASE chunk_type WHEN 'function' THEN 'Function implementation' WHEN 'method' THEN 'Method implementation' WHEN 'class_summary' THEN 'Class definition' ELSE 'Module overview' END AS relevance FROM ch")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", context.relevance(F.col("chunk_type")).alias("relevance"))


@query("t07_top_citations", f"WITH {_CHUNKS} SELECT query, id FROM ch QUALIFY row_number() OVER (PARTITION BY query ORDER BY start_line DESC, id) <= 10")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.search import top

    return top(_chunks(spark, sf_dir).select("query", "id", F.col("start_line").alias("score")), 10).select("query", "id")


@query("c11_answers", f"{TURNS} SELECT conv_id, turn, question || chr(10) || chr(10) || '---' || chr(10) || 'Sources:' || chr(10) || '• f.py:' || turn || '-' || (turn + 9) || ' — (file summary)' AS answer FROM v_turns")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct(F.lit("f.py").alias("file"), F.col("turn").alias("start"), (F.col("turn") + 9).alias("end"), F.lit(None).cast("string").alias("name"))
    return view(spark, sf_dir, "v_turns").select("conv_id", "turn", context.sourced(F.col("question"), F.array(source)).alias("answer"))


@query("c11_no_answer", r"""WITH x AS (SELECT conv_id, turn, regexp_extract(coalesce(text, ''), '(?:^|[^\p{L}\p{N}_])([A-Z][a-zA-Z0-9]*)(?:$|[^\p{L}\p{N}_])', 1) AS name FROM conversations) SELECT conv_id, turn, 'No relevant code was found. Related questions:' || chr(10) || '• '
  || CASE WHEN name = '' THEN 'What files are in this repository?' ELSE 'Where is ' || name || ' defined?' END || chr(10) || '• What are the main classes or functions?' AS answer FROM x""")
def c11_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", context.no_answer(F.coalesce("text", F.lit(""))).alias("answer"))


@query("c12_file_budget", """WITH e AS (SELECT source AS repo, doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 80), chr(10)) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
  b AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY repo ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e) SELECT repo, 'f' || doc_id AS path, left(x, CAST(14000 - used AS INT)) AS excerpt FROM b WHERE used < 14000""")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return context.file_budget(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("f"), "doc_id").alias("path"), F.col("text").alias("content"), place.alias("place")))


@query("c14_story_json", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"a": ' || doc_id || ', "b": 2}' WHEN 1 THEN '{"a": ' || doc_id || '}' ELSE 'no json ' || doc_id END AS json, doc_id % 3 = 0 AS valid FROM documents""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each document: a fenced object, one that lacks a field, no object."""
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, F.format_string('```json\n{"a": %d, "b": 2}\n```', "doc_id")).when(kind == 1, F.format_string('{"a": %d}', "doc_id")).otherwise(F.format_string("no json %d", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", context.story_json(raw, ["a", "b"]).alias("x")).select("doc_id", "x.*")


@query("c15_prompt", f"{TURNS} SELECT conv_id, turn, 'Context:' || chr(10) || answer || chr(10) || chr(10) || 'History:' || chr(10) || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM v_turns")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_turns").select("conv_id", "turn", context.prompt(F.col("question"), F.col("answer"), F.lit(None).cast("string")).alias("prompt"))


@query("a15_mean_score", f"WITH {_CHUNKS} SELECT query, round(avg(start_line), 6) AS mean FROM ch GROUP BY query")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("query").agg(F.round(F.avg("start_line"), 6).alias("mean"))


_TYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in config.QUERY_TYPES.items()) + " WHEN contains(q, 'explain') THEN 'explain' ELSE 'general' END"
_QUESTIONS = "qs AS (SELECT conv_id, turn, lower(trim(text)) AS q, text FROM conversations)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", context.clean_question(F.col("text")).alias("q"), "text")


@query("x19_clean_question", f"WITH {_QUESTIONS} SELECT conv_id, turn, q FROM qs")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", "q")


@query("k14_query_type", f"WITH {_QUESTIONS} SELECT conv_id, turn, {_TYPE} AS type FROM qs")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", rules.query_type(F.col("q")).alias("type"))


_KINDS = [("what is this #", "what_is"), ("how does # work", "how_does"), ("where is the login #", "where_is"), ("what calls save#", "what_calls"), ("what does # import", "what_is"), ("explain the request routing flow #", "explain"), ("hello #", "general"), ("what depends on x#", "what_calls"), ("impact of removing x#", "what_breaks")]


@query("k14_query_type_literal", each_document(", ".join(f"('{q}', '{kind}')" for q, kind in _KINDS), "q", "type"))
def k14_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, [(q,) for q, _ in _KINDS], "q string").select("q", rules.query_type(F.col("q")).alias("type"))


@query("k15_flags", f"WITH {_QUESTIONS} SELECT conv_id, turn, ({_TYPE}) IN ('what_calls', 'what_imports') OR {' OR '.join(f'contains(q, {quoted([w])})' for w in config.RELATION_WORDS)} AS graph_query FROM qs")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", rules.graph_query(F.col("q"), rules.query_type(F.col("q"))).alias("graph_query"))


_DOUBT = " OR ".join(f"contains(lower(answer), {quoted([w])})" for w in config.UNCERTAIN)
_HEDGE = " OR ".join(f"contains(lower(answer), '{w}')" for w in config.HEDGING)


@query("k17_confidence", f"""{TURNS}, a AS (SELECT conv_id, turn, answer, turn % 4 AS cites, conv_id % 5 AS found, (conv_id % 100) / 100.0 AS mean FROM v_turns),
  b AS (SELECT *, CASE WHEN mean >= 0.75 THEN 3 WHEN mean >= 0.5 THEN 2 ELSE 1 END AS l FROM a), c AS (SELECT *, CASE WHEN cites = 0 THEN greatest(l - 1, 1) ELSE l END AS l2 FROM b), d AS (SELECT *, CASE WHEN {_HEDGE} THEN greatest(l2 - 1, 1) ELSE l2 END AS l3 FROM c),
  e AS (SELECT *, CASE WHEN cites >= 3 AND mean >= 0.5 AND l3 = 2 THEN 3 ELSE l3 END AS l4 FROM d) SELECT conv_id, turn, CASE WHEN found = 0 OR {_DOUBT} THEN 'low' ELSE ['low', 'medium', 'high'][l4] END AS confidence FROM e""")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = rules.confidence(F.col("answer"), F.col("conv_id") % 5, (F.col("conv_id") % 100) / 100.0, F.col("turn") % 4)
    return view(spark, sf_dir, "v_turns").select("conv_id", "turn", level.alias("confidence"))


# what a turn's text is with a phrase of its own, by turn
_PHRASES = ["ask UserService.get_user in app.py", "the HTTPClient and LoadBalancer", "How does it work with load_all?", "(find) UserRepo, UserRepo! is THIS 42 ok", "and that _x user_service.py"]
_ASKED = f"ak AS (SELECT conv_id, turn, list_extract([{quoted(_PHRASES)}], CAST(coalesce(turn, 0) % {len(_PHRASES)} AS INT) + 1) || ' ' || coalesce(text, '') AS q FROM conversations)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's whole text after a phrase that holds names of all kinds."""
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.coalesce("turn", F.lit(0)) % len(_PHRASES)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


def _names_sql(q: str) -> str:
    """DuckDB's list of the names in q, repeats included."""
    snake = rf"list_filter(regexp_extract_all({q}, '\b[a-z_][a-z0-9_]{{2,}}\b'), lambda w: contains(w, '_') OR NOT list_contains([{quoted(config.STOP_WORDS)}], w))"
    rest = rf"list_concat(regexp_extract_all({q}, '\b[A-Za-z0-9_-]+\.(?:py|js|ts|java|go|rs|c|cpp|rb|php)\b'), regexp_extract_all({q}, '\b[A-Z][a-zA-Z0-9]*\.[a-z_][a-z0-9_]*\b'))"
    return rf"list_concat(list_concat(regexp_extract_all({q}, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b'), {snake}), {rest})"


def _once(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def _swapped(q: str, entity: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches({q}, '(?i)\b{w}\b') THEN coalesce(regexp_replace({q}, '(?i)\b{w}\b', {entity}), {q})" for w in ("it", "this", "that")) + f" ELSE {q} END"


@query("x17_cited_entities", f"WITH {_ASKED}, n AS (SELECT conv_id, turn, list_concat({_names_sql('q')}, ['UserService', 'load_all']) AS l FROM ak) SELECT conv_id, turn, array_to_string({_once('l')}, ',') AS entities FROM n")
def x17_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).withColumnRenamed("q", "text").withColumn("previous", F.lit(None).cast("string")).withColumn("cited", F.array(F.lit("UserService"), F.lit("load_all")))
    return context.processed(rows).select("conv_id", "turn", F.array_join("entities", ",").alias("entities"))


@query("x20_previous_answer", f"WITH {_ASKED}, n AS (SELECT conv_id, turn, lower(trim(q)) AS q, {_names_sql('p')} AS l FROM (SELECT *, CASE WHEN conv_id % 3 > 0 THEN q END AS p FROM ak) z) SELECT conv_id, turn, {_swapped('q', 'l[1]')} AS resolved FROM n")
def x20_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn's own text as the previous answer, which a third of the conversations lack."""
    rows = _asked(spark, sf_dir).withColumn("previous", F.when(F.col("conv_id") % 3 > 0, F.col("q"))).withColumnRenamed("q", "text").withColumn("cited", F.lit(None).cast("array<string>"))
    return context.processed(rows).select("conv_id", "turn", "resolved")


@query("k15_multi_hop", f"""WITH {_ASKED}, z AS (SELECT conv_id, turn, list_extract(['explain ', 'what breaks ', 'what calls ', ''], CAST(conv_id % 4 AS INT) + 1) || q AS text FROM ak), n AS (SELECT conv_id, turn, lower(trim(text)) AS q, {_names_sql('text')} AS l FROM z), t AS (SELECT *, {_TYPE} AS type, len(list_distinct(l)) AS n FROM n)
  SELECT conv_id, turn, type IN ('explain', 'what_breaks') OR (contains(q, ' and ') AND n > 1) OR n > 2 AS multi_hop, type IN ('what_calls', 'what_imports') OR {' OR '.join(f'contains(q, {quoted([w])})' for w in config.RELATION_WORDS)} AS graph_query FROM t""")
def k15_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.array(*map(F.lit, ["explain ", "what breaks ", "what calls ", ""])), (F.col("conv_id") % 4).cast("int"))
    rows = _asked(spark, sf_dir).select("conv_id", "turn", F.concat(first, "q").alias("text"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("array<string>").alias("cited"))
    return context.processed(rows).select("conv_id", "turn", "multi_hop", "graph_query")


@query("c01_history_before", f"""{TURNS}, u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), b AS (SELECT u.conv_id, u.turn, t.question, t.answer, t.turn AS earlier, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY t.turn DESC) AS n FROM u JOIN v_turns t ON t.conv_id = u.conv_id AND t.turn < u.turn),
  g AS (SELECT conv_id, turn, string_agg('Q: ' || question || chr(10) || 'A: ' || {_CLIP}, chr(10) || chr(10) ORDER BY earlier) AS history, max(answer) FILTER (WHERE n = 1) AS previous FROM b WHERE n <= 3 GROUP BY conv_id, turn) SELECT conv_id, turn, history, previous FROM u LEFT JOIN g USING (conv_id, turn)""")
def c01_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.with_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "history", "previous")


@query("x17_entities", f"WITH {_ASKED}, n AS (SELECT conv_id, turn, {_names_sql('q')} AS l FROM ak) SELECT conv_id, turn, array_to_string({_once('l')}, ',') AS entities FROM n")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.array_join(context.entities(F.col("q")), ",").alias("entities"))


_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query("x18_keywords", rf"""WITH {_ASKED}, w AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '' AND NOT list_contains([{quoted(config.STOP_WORDS)}], w)), lambda w: trim(w, '{_MARKS}')) AS a FROM ak),
  k AS (SELECT conv_id, turn, list_filter(a, lambda w: w <> '' AND (contains(w, '_') OR regexp_matches(w, '[A-Z]') OR contains(w, '.') OR regexp_full_match(w, '[0-9]+') OR length(w) > 2)) AS l FROM w) SELECT conv_id, turn, array_to_string({_once('l')}, ',') AS words FROM k""")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.array_join(context.keywords(F.col("q")), ",").alias("words"))


@query("x20_pronouns", f"WITH {_ASKED} SELECT conv_id, turn, {_swapped('q', quoted(['UserService']))} AS resolved FROM ak")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", context.resolved_question(F.col("q"), F.lit("UserService")).alias("resolved"))


@query("t08_newest_jobs", f"{JOBS} SELECT repo_key, job_id, row_number() OVER (PARTITION BY repo_key ORDER BY created_at DESC, job_id DESC) AS place FROM v_jobs")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("repo_key").orderBy(F.desc("created_at"), F.desc("job_id"))
    return view(spark, sf_dir, "v_jobs").select("repo_key", "job_id", F.row_number().over(newest).cast("long").alias("place"))


@query("t09_sessions_by_activity", f"{JOBS} SELECT repo_key, row_number() OVER (ORDER BY last_active DESC, repo_key) AS place FROM (SELECT repo_key, max(created_at) AS last_active FROM v_jobs GROUP BY repo_key) x")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = view(spark, sf_dir, "v_jobs").groupBy("repo_key").agg(F.max("created_at").alias("last_active"))
    return context.placed(active, "repo_key", "last_active").select("repo_key", "place")


@query("q01_create", f"{JOBS} SELECT phase, status, count(*) AS jobs FROM (SELECT phase, status FROM v_jobs UNION ALL SELECT 'ingest', 'queued') x GROUP BY phase, status")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("ingest", "queued")], "phase string, status string")
    return view(spark, sf_dir, "v_jobs").select("phase", "status").unionByName(new).groupBy("phase", "status").agg(F.count("*").alias("jobs"))


@query("q02_latest_progress", f"{JOBS} SELECT repo_key, status, greatest(0, least(100, raw_progress)) AS progress FROM v_jobs QUALIFY row_number() OVER (PARTITION BY repo_key ORDER BY created_at DESC, job_id DESC) = 1")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "v_jobs").select("repo_key", "created_at", "job_id", "status", "raw_progress")
    return context.latest(jobs, "repo_key", "created_at").select("repo_key", "status", context.progress(F.col("raw_progress")).alias("progress"))


@query("q03_get", f"{JOBS} SELECT job_id, phase, status FROM v_jobs WHERE job_id = 42")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_jobs").where("job_id = 42").select("job_id", "phase", "status")


@query("q04_list", f"{JOBS} SELECT job_id, repo_key FROM v_jobs WHERE phase = 'chunk' AND status = 'running'")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.sources.stores import where_equal

    return where_equal(view(spark, sf_dir, "v_jobs"), {"phase": "chunk", "status": "running"}).orderBy(F.desc("created_at"), "job_id").select("job_id", "repo_key")


@query("q05_duplicates", f"{JOBS} SELECT phase, repo_key, min(job_id) AS job_id FROM v_jobs WHERE status IN ('queued', 'running') GROUP BY phase, repo_key")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.duplicates(view(spark, sf_dir, "v_jobs"))


@query("q06_cleanup", f"{JOBS} SELECT job_id FROM v_jobs WHERE NOT (status IN ('complete', 'failed') AND created_at < (SELECT max(created_at) FROM v_jobs) - INTERVAL 240 HOUR)")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "v_jobs")
    now = jobs.agg(F.max("created_at").alias("now"))
    return context.cleaned(jobs.crossJoin(F.broadcast(now)), F.col("now"), 240).select("job_id")


@query("q07_gate", f"{JOBS} SELECT repo_key, 'chunk' AS phase, CASE WHEN count(*) FILTER (WHERE phase = 'parse') = 0 THEN 404 WHEN count(*) FILTER (WHERE phase = 'parse' AND status = 'complete') = 0 THEN 409 ELSE 202 END AS code FROM v_jobs GROUP BY repo_key")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.gate(view(spark, sf_dir, "v_jobs"), "chunk", "parse")

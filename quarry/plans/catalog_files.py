"""Queries of filters (i), sources and sinks (s) and aggregates (a)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import filters, stats
from quarry.operators.shared import cut, fresh
from quarry.plans.fixtures import ddb, each_document, planted, quoted, table, view
from quarry.plans.registry import query
from quarry.sources import repository, stores

FILES = "WITH " + ddb("v_files")
_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{ext}' THEN '{language}'" for ext, language in config.LANGUAGE_OF.items()) + " END"
_DIRS = f"list_filter(list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1), lambda x: list_contains([{quoted(config.IGNORED_DIRECTORIES)}], x))"
_GLOB = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '[^/]*$')) GLOB '{g}' THEN '{g}'" for g in config.IGNORED_PATTERNS) + " END"


@query("i01_ignored_directory", f"{FILES} SELECT file_id, len({_DIRS}) > 0 AS ignored, {_DIRS}[1] AS directory FROM v_files")
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.ignored_directory(F.col("path"))
    return view(spark, sf_dir, "v_files").select("file_id", found.isNotNull().alias("ignored"), found.alias("directory"))


@query("i02_ignored_pattern", f"{FILES} SELECT file_id, {_GLOB} AS pattern FROM v_files")
def i02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", filters.ignored_pattern(F.col("path")).alias("pattern"))


@query("i03_supported", f"{FILES} SELECT file_id, {_EXT} AS extension, ({_LANG}) IS NOT NULL AS supported FROM v_files")
def i03(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return view(spark, sf_dir, "v_files").select("file_id", filters.extension(path).alias("extension"), filters.supported(path).alias("supported"))


@query("i04_size_limit", f"{FILES} SELECT file_id, size_bytes FROM v_files WHERE size_bytes <= {config.MAX_FILE_BYTES}")
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").where(F.col("size_bytes") <= config.MAX_FILE_BYTES).select("file_id", "size_bytes")


_REASON = f"""CASE WHEN len({_DIRS}) > 0 THEN 'ignored directory: ' || {_DIRS}[1] WHEN {_GLOB} IS NOT NULL THEN 'ignored pattern: ' || {_GLOB}
  WHEN ({_LANG}) IS NULL THEN 'unsupported extension: ' || CASE WHEN {_EXT} = '' THEN '(no extension)' ELSE {_EXT} END
  WHEN size_bytes > {config.MAX_FILE_BYTES} THEN 'file too large: ' || format('{{:,}}', size_bytes) || ' bytes (limit: {config.MAX_FILE_BYTES:,} bytes)' ELSE 'ok' END"""


@query("i05_filter_reason", f"{FILES} SELECT file_id, {_REASON} AS reason FROM v_files")
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", filters.filter_reason(F.col("path"), F.col("size_bytes")).alias("reason"))


@query("i06_likely_binary", f"{FILES} SELECT file_id, length(left(content, 8000)) > 0 AND (length(left(content, 8000)) - length(replace(left(content, 8000), chr(0), ''))) > 0.01 * length(left(content, 8000)) AS is_binary FROM v_files")
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", filters.likely_binary(F.col("content")).alias("is_binary"))


@query("i07_language", f"{FILES} SELECT file_id, {_LANG} AS language FROM v_files")
def i07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", filters.language(F.col("path")).alias("language"))


@query("i08_byte_cap", f"""WITH RECURSIVE {ddb("v_files")}, o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_id) AS rn FROM v_files),
  f AS (SELECT repo, file_id, rn, size_bytes <= 200000 AS accepted, CASE WHEN size_bytes <= 200000 THEN size_bytes ELSE 0 END AS used FROM o WHERE rn = 1
    UNION ALL SELECT o.repo, o.file_id, o.rn, f.used + o.size_bytes <= 200000, f.used + CASE WHEN f.used + o.size_bytes <= 200000 THEN o.size_bytes ELSE 0 END FROM f JOIN o ON o.repo = f.repo AND o.rn = f.rn + 1)
  SELECT repo, file_id, accepted, CAST(used AS BIGINT) AS used FROM f""")
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "v_files").select("repo", "file_id", "size_bytes")
    return filters.byte_cap(files, budget=200_000).select("repo", "file_id", "accepted", "used")


@query("i09_parse_guard", f"{FILES} SELECT file_id, list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) AS longest_line, CASE WHEN length(content) = 0 THEN 'empty' WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > {config.MINIFIED_LINE_CHARS} THEN 'minified' ELSE 'parse' END AS guard FROM v_files")
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return view(spark, sf_dir, "v_files").select("file_id", filters.longest_line(content).cast("long").alias("longest_line"), filters.parse_guard(content).alias("guard"))


@query("i10_truncation", f"{FILES} SELECT file_id, md5(CASE WHEN length(content) > {config.MAX_BODY_CHARS} THEN '[TRUNCATED]' ELSE content END) AS body_md5, left(content, 200) AS preview FROM v_files")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return view(spark, sf_dir, "v_files").select("file_id", F.md5(filters.truncated_body(content)).alias("body_md5"), F.substring(content, 1, config.PREVIEW_CHARS).alias("preview"))


@query("i11_min_tokens", f"{FILES} SELECT file_id, length(content) // 4 AS tokens FROM v_files WHERE length(content) // 4 >= {config.MIN_CHUNK_TOKENS}")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", filters.tokens(F.col("content")).alias("tokens")).where(F.col("tokens") >= config.MIN_CHUNK_TOKENS)


@query("i12_where_filter", f"{FILES} SELECT file_id, path FROM v_files WHERE repo = 'src3'")
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.where_equal(view(spark, sf_dir, "v_files"), {"repo": "src3"}).select("file_id", "path")


_URL = """WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS bare FROM pages),
  h AS (SELECT page_id, lower(regexp_replace(regexp_extract(bare, '^[^/?#]*'), ':[0-9]*$', '')) AS host, list_filter(string_split(regexp_extract(bare, '^[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM u)
  SELECT page_id, CASE WHEN host IN ('github.com', 'www.github.com') THEN CASE WHEN len(steps) = 1 THEN 'user page' WHEN len(steps) = 0 THEN 'no repository' END
    WHEN regexp_matches(host, 'gitlab|bitbucket|codeberg|gitea') THEN 'other host' ELSE 'unknown host' END AS error FROM h"""


@query("i13_repo_url_pages", _URL)
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", filters.repo_url(F.col("url"))["error"].alias("error"))


@query("i13_repo_url", each_document("""('pallets/flask#', 'pallets', 'flask#', NULL, NULL), ('https://github.com/a-b/c.d#.git', 'a-b', 'c.d#', NULL, NULL),
  ('git@github.com:Org/repo#.git', 'Org', 'repo#', NULL, NULL), ('github.com/o/r#/tree/dev/src', 'o', 'r#', 'dev', NULL),
  ('https://github.com/o/r#/blob/main/x.py?x=1', 'o', 'r#', 'main', NULL), ('https://github.com/onlyuser#', NULL, NULL, NULL, 'user page'),
  ('https://gitlab.com/o/r#', NULL, NULL, NULL, 'other host'), ('https://example.org/o/r#', NULL, NULL, NULL, 'unknown host'),
  ('https://github.com/-bad/r#', '-bad', 'r#', NULL, 'bad owner')""", "url", "owner", "repo", "branch", "error"))
def i13_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ["pallets/flask#", "https://github.com/a-b/c.d#.git", "git@github.com:Org/repo#.git", "github.com/o/r#/tree/dev/src", "https://github.com/o/r#/blob/main/x.py?x=1", "https://github.com/onlyuser#", "https://gitlab.com/o/r#", "https://example.org/o/r#", "https://github.com/-bad/r#"]
    return planted(spark, sf_dir, [(u,) for u in urls], "url string").select("url", filters.repo_url(F.col("url")).alias("x")).select("url", "x.*")


def _mirror(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """What was written of all files, and the folder."""
    folder = fresh(spark, "mirror")
    return cut(repository.write_mirror(view(spark, sf_dir, "v_files"), folder)), folder


@query("s01_tree_scan", f"{FILES} SELECT path, md5(content) AS sha, CAST(strlen(content) AS BIGINT) AS size_bytes, 'blob' AS kind FROM v_files")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of the tree that s07 writes, with what a scan finds at each place; a submodule among the listing is left out."""
    written, folder = _mirror(spark, sf_dir)
    found = repository.scan_tree(spark, folder).select(F.col("path").alias("place"), F.md5("raw").alias("sha"), "size_bytes")
    tree = written.select("path", "place").join(found, "place", "left").select("path", "sha", "size_bytes", F.lit("blob").alias("kind"))
    module = spark.createDataFrame([("lib/sub", None, 0, "commit")], tree.schema)
    return repository.blobs(tree.unionByName(module))


@query("s02_decode", """SELECT doc_id, length(text) AS chars, md5(replace(replace(text || chr(13) || chr(10) || 'x', chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents""")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.concat("text", F.lit("\r\nx")).cast("binary").alias("raw"))
    return raw.select("doc_id", "chars", F.md5(repository.decoded(F.col("raw"))).alias("text_md5"))


_ANSWERS = [
    '{"name":"r#","owner":{"login":"o","id":1},"full_name":"o/r#","description":null,"language":"Go","stargazers_count":5,"forks_count":1,"size":9,"default_branch":"main","topics":["a","b"],"created_at":"2020-01-01T00:00:00","updated_at":"2021-01-01T00:00:00","license":{"name":"MIT"},"fork":false,"archived":true,"has_wiki":true,"open_issues_count":2,"homepage":"h","visibility":"private"}',
    '{"name":"q#","owner":{"login":"p"},"full_name":"p/q#","description":"d","language":null,"stargazers_count":0,"forks_count":0,"size":0,"default_branch":"dev","license":null,"fork":true,"archived":false,"has_wiki":false,"open_issues_count":0,"homepage":""}',
]


@query("s03_repo_metadata", """SELECT t.* FROM documents, LATERAL (VALUES ('r' || doc_id, 'o', 'o/r' || doc_id, '', 'Go', CAST(5 AS BIGINT), CAST(1 AS BIGINT), CAST(9 AS BIGINT), 'main', 'a,b', '2020-01-01T00:00:00', '2021-01-01T00:00:00', 'MIT', false, true, true, CAST(2 AS BIGINT), 'h', 'private'),
  ('q' || doc_id, 'p', 'p/q' || doc_id, 'd', 'Unknown', 0, 0, 0, 'dev', '', NULL, NULL, NULL, true, false, false, 0, '', 'public')) AS t(name, owner, full_name, description, primary_language, stars, forks, size_kb, default_branch, topics, created_at, updated_at, license, is_fork, is_archived, has_wiki, open_issues_count, homepage, visibility)""")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers for each document, one of them without most fields."""
    return repository.metadata(planted(spark, sf_dir, [(a,) for a in _ANSWERS], "raw string").select("raw")).withColumn("topics", F.array_join("topics", ","))


@query("s05_json_scan", f"{FILES} SELECT path, 'unknown' AS language, size_bytes, CASE WHEN file_id % 2 = 0 THEN 'f' || file_id ELSE '' END AS functions FROM v_files")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed files as JSON, half of them without their list, none with a language, beside blank lines."""
    listed = F.when(F.col("file_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("f"), "file_id").alias("name"))))
    files = view(spark, sf_dir, "v_files").select(F.explode(F.array(F.to_json(F.struct("path", "size_bytes", listed.alias("functions"))), F.lit(" "))).alias("line"))
    rows = repository.json_lines(files, "path string, language string, size_bytes long, functions array<struct<name:string>>", {"language": "unknown"})
    return rows.withColumn("functions", F.array_join(F.transform("functions", lambda x: x["name"]), ","))


_SAFE = """c AS (SELECT file_id, path, content, list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[<>:"|?*]', '_', 'g')) AS parts FROM v_files),
  d AS (SELECT file_id, path, content, array_to_string(parts, '/') AS safe FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY lower(safe) ORDER BY path) AS n FROM d)"""
_DESTINATION = "CASE WHEN n = 1 THEN safe ELSE regexp_replace(safe, '(\\.[^./]*)?$', '_' || left(md5(path), 6) || '\\1') END"


@query("s07_safe_paths", f"{FILES}, {_SAFE} SELECT path, {_DESTINATION} AS destination FROM e")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.safe_destinations(view(spark, sf_dir, "v_files").select("path"))


@query("s07_mirror", f"{FILES}, {_SAFE} SELECT path, {_DESTINATION} AS destination, CAST(strlen(content) AS BIGINT) AS size_bytes, md5(content) AS content_md5 FROM e")
def s07_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files written as a tree and read back."""
    written, folder = _mirror(spark, sf_dir)
    back = repository.scan_tree(spark, folder).select(F.col("path").alias("place"), F.md5("raw").alias("content_md5"))
    return written.join(back, "place", "left").drop("place")


@query("s08_manifest", f"""{FILES}, l AS (SELECT repo, coalesce({_LANG}, 'unknown') AS language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_files GROUP BY ALL)
  SELECT repo, CAST(sum(files) AS BIGINT) AS total_files, CAST(sum(bytes) AS BIGINT) AS total_bytes, string_agg(language || ':' || files || ':' || bytes, ',' ORDER BY language) AS languages FROM l GROUP BY repo""")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written as JSON and read back."""
    rows, place = repository.manifest(view(spark, sf_dir, "v_files")), fresh(spark, "manifest")
    repository.write_jsonl(rows, place)
    text = F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["files"], x["bytes"]))
    return repository.read_jsonl(spark, place, rows.schema).withColumn("languages", F.array_join(text, ","))


@query("s09_latest_version", "SELECT repo_key, max(created_at) AS run_ts, count(*) AS versions FROM (" + f"WITH {ddb('v_jobs')} SELECT * FROM v_jobs WHERE phase = 'ingest') x GROUP BY repo_key")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "v_jobs").where("phase = 'ingest'").select("repo_key", F.col("created_at").alias("run_ts"))
    return repository.latest_versions(runs)


@query("s09_rotation", f"{FILES} SELECT file_id, size_bytes + 1 AS size_bytes, (SELECT 2 * count(*) FROM v_files) AS kept FROM v_files")
def s09_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written twice: the first version stays, readers get the second."""
    files, folder = view(spark, sf_dir, "v_files").select("file_id", "size_bytes"), fresh(spark, "versions")
    repository.write_version(files, folder, "2024-01-01T10-00-00")
    repository.write_version(files.withColumn("size_bytes", F.col("size_bytes") + 1), folder, "2024-02-01T10-00-00")
    kept = repository.read_versions(spark, folder).agg(F.count("*").alias("kept"))
    return repository.read_latest(spark, folder).crossJoin(F.broadcast(kept))


@query("s10_catalog_listing", "SELECT 'a__b' || doc_id AS folder, true AS complete FROM documents UNION ALL SELECT 'c__d' || doc_id, false FROM documents")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document a complete repository, one that lacks keys, and an older copy of the first."""
    rows = [("a__b#", ["owner", "repo_name", "files", "languages"]), ("c__d#", ["owner"]), ("a__b#__2024-01-01T10", ["owner", "repo_name", "files", "languages"])]
    return repository.listing(planted(spark, sf_dir, rows, "folder string, keys array<string>"))


@query("s12_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label, CAST(len(embedding) AS BIGINT) AS dimensions FROM embeddings")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors stored, then every third one again with another label, beside rows without a vector."""
    store, rows = stores.Collections(spark, fresh(spark, "collections")), table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    store.upsert("vectors", rows, "vec_id")
    third, none = rows.where("vec_id % 3 = 0").withColumn("label", F.lit(-1)), F.array().cast("array<float>")
    store.upsert("vectors", third.unionByName(rows.select((-F.col("vec_id") - 1).alias("vec_id"), "label", none.alias("embedding"))), "vec_id")
    return store.read("vectors").select("vec_id", "label", F.size("embedding").cast("long").alias("dimensions"))


@query("s13_collections", "SELECT * FROM (VALUES (1, 'exists', 'false'), (2, 'names', 'a,b'), (3, 'count', '0'), (4, 'count', (SELECT CAST(count(*) AS VARCHAR) FROM embeddings)), (5, 'deleted', 'true'), (6, 'deleted', 'false'), (7, 'names', 'b')) AS t(step, what, value)")
def s13_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a collection's life, all vectors stored in between, beside one row without a vector."""
    empty = spark.createDataFrame([(-1, [])], "vec_id long, embedding array<float>")
    store, rows = stores.Collections(spark, fresh(spark, "collections")), table(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(empty)
    steps = [("exists", store.exists("a"))]
    store.get_or_create("a"), store.get_or_create("b")
    steps += [("names", ",".join(store.names())), ("count", store.count("a"))]
    store.upsert("a", rows, "vec_id")
    steps += [("count", store.count("a")), ("deleted", store.delete("a")), ("deleted", store.delete("a")), ("names", ",".join(store.names()))]
    return spark.createDataFrame([(n, what, str(value).lower()) for n, (what, value) in enumerate(steps, 1)], "step int, what string, value string")


@query("s13_collection_stats", f"{FILES} SELECT left(regexp_replace('quarry__' || lower(repo), '[^a-z0-9_-]', '_', 'g'), 63) AS collection, count(*) AS chunks FROM v_files GROUP BY 1")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").groupBy(stores.collection_name(F.lit("quarry"), F.col("repo")).alias("collection")).agg(F.count("*").alias("chunks"))


@query("s16_keyed_fetch", f"{FILES} SELECT path AS qualified_name, min(file_id) AS chunk_id, count(*) AS chunks FROM v_files WHERE path IN (SELECT path FROM v_files WHERE file_id % 100 = 0) GROUP BY path")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "v_files").select("path", "file_id")
    keys = files.where("file_id % 100 = 0").select("path").distinct()
    return stores.by_key(files, keys, "path").groupBy(F.col("path").alias("qualified_name")).agg(F.min("file_id").alias("chunk_id"), F.count("*").alias("chunks"))


@query("s18_excerpts", f"{FILES} SELECT file_id, array_to_string(list_slice(string_split(content, chr(10)), 1, 40), chr(10)) AS excerpt FROM v_files")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("file_id", repository.excerpt(F.col("content"), 40).alias("excerpt"))


_STATS = f"""{FILES}, k AS (SELECT {_LANG} AS language, size_bytes FROM v_files), st AS (SELECT language, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS byte_count FROM k WHERE language IS NOT NULL GROUP BY language),
  sp AS (SELECT *, round(100 * byte_count / sum(byte_count) OVER (), 1) AS percentage FROM st)"""


@query("a01_language_stats", f"{_STATS} SELECT * FROM sp")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_stats(view(spark, sf_dir, "v_files"))


_FLAGS = f"{_STATS}, r AS (SELECT *, row_number() OVER (ORDER BY byte_count DESC, language) AS n FROM sp) SELECT max(CASE WHEN n = 1 THEN language END) AS primary_language, count(*) FILTER (WHERE percentage >= 15) >= 3 AS is_monorepo, coalesce(abs(max(CASE WHEN n = 1 THEN percentage END) - max(CASE WHEN n = 2 THEN percentage END)) <= 10, false) AS has_multiple_primary, CAST(sum(file_count) AS BIGINT) AS total_files, CAST(sum(byte_count) AS BIGINT) AS total_bytes FROM r"


@query("a02_primary_language", f"SELECT primary_language FROM ({_FLAGS})")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_flags(stats.language_stats(view(spark, sf_dir, "v_files"))).select("primary_language")


@query("a03_monorepo", f"SELECT is_monorepo, total_files FROM ({_FLAGS})")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_flags(stats.language_stats(view(spark, sf_dir, "v_files"))).select("is_monorepo", "total_files")


@query("a04_codominant", f"SELECT has_multiple_primary, total_bytes FROM ({_FLAGS})")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_flags(stats.language_stats(view(spark, sf_dir, "v_files"))).select("has_multiple_primary", "total_bytes")


EDGES = "WITH " + ddb("v_edges", "v_nodes")
_DEG = f"{EDGES}, deg AS (SELECT dst AS id, count(DISTINCT src) AS in_degree FROM v_edges GROUP BY dst)"


@query("a05_most_imported", f"{_DEG} SELECT * FROM deg ORDER BY in_degree DESC, id LIMIT 10")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_in_degree(view(spark, sf_dir, "v_edges"), 10)


@query("a06_hub_functions", f"{_DEG} SELECT name, in_degree FROM (SELECT * FROM deg ORDER BY in_degree DESC, id LIMIT 10) t JOIN v_nodes USING (id)")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_in_degree(view(spark, sf_dir, "v_edges"), 10).join(view(spark, sf_dir, "v_nodes"), "id").select("name", "in_degree")


@query("a07_hubs", f"{_DEG} SELECT * FROM deg WHERE in_degree >= {config.HUB_THRESHOLD}")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hubs(view(spark, sf_dir, "v_edges"))


@query("a08_orphans", "WITH e AS (SELECT o_custkey AS src, o_custkey + 1 AS dst FROM orders WHERE o_custkey IS NOT NULL), n AS (SELECT c_custkey AS id FROM customer) SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").where("o_custkey is not null").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"))
    return stats.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), edges)


@query("a09_chunk_manifest", f"{FILES} SELECT count(*) AS total, count(*) FILTER (WHERE file_id % 3 > 0) AS functions, count(*) FILTER (WHERE file_id % 3 = 0) AS file_summaries, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, CAST(sum(length(content) // 4) // count(*) AS BIGINT) AS mean_tokens, max(length(content) // 4) AS max_tokens FROM v_files")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = view(spark, sf_dir, "v_files").select(F.when(F.col("file_id") % 3 > 0, "function").otherwise("file_summary").alias("chunk_type"), filters.tokens(F.col("content")).alias("token_count"))
    return stats.chunk_manifest(chunks)


@query("a11_call_volume", f"{EDGES}, o AS (SELECT file, count(*) AS c FROM v_edges JOIN v_nodes ON src = id GROUP BY file), i AS (SELECT file, count(*) AS c FROM v_edges JOIN v_nodes ON dst = id GROUP BY file) SELECT coalesce(o.file, i.file) AS file, coalesce(i.c, 0) AS calls_in, coalesce(o.c, 0) AS calls_out, 2 * coalesce(i.c, 0) + coalesce(o.c, 0) AS score FROM o FULL JOIN i ON o.file = i.file ORDER BY score DESC, file LIMIT 10")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.call_volume(view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_edges"))


@query("a12_core_utilities", f"{EDGES} SELECT b.file AS to_file, count(DISTINCT a.file) AS callers FROM v_edges JOIN v_nodes a ON src = a.id JOIN v_nodes b ON dst = b.id WHERE a.file <> b.file GROUP BY b.file HAVING count(DISTINCT a.file) >= 3 ORDER BY callers DESC, to_file LIMIT 10")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.core_utilities(view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_edges"))


@query("a13_hotspots", f"{EDGES} SELECT file || '::' || name AS label, complexity FROM v_nodes ORDER BY complexity DESC, label DESC LIMIT 5")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hotspots(view(spark, sf_dir, "v_nodes"))


@query("a14_layer_groups", f"{EDGES} SELECT layer, count(*) AS nodes, string_agg(name, chr(10) ORDER BY name) AS names FROM v_nodes GROUP BY layer")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.layer_groups(view(spark, sf_dir, "v_nodes")).withColumn("names", F.array_join("names", "\n"))


@query("a16_sources", f"{FILES} SELECT repo, count(DISTINCT path) AS files, min(path) AS first_path FROM v_files GROUP BY repo")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").groupBy("repo").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first_path"))


@query("a17_repo_phases", f"WITH {ddb('v_jobs')} SELECT repo_key, count(DISTINCT phase) AS phases_complete FROM v_jobs WHERE status = 'complete' GROUP BY repo_key")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_jobs").where("status = 'complete'").groupBy("repo_key").agg(F.countDistinct("phase").alias("phases_complete"))


@query("a18_matching_directories", f"{FILES} SELECT count(DISTINCT part) AS directories FROM (SELECT unnest(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)) AS part FROM v_files) WHERE lower(part) IN ('build', 'web', 'src3')")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.matching_directories(view(spark, sf_dir, "v_files"), ["build", "web", "src3"])


@query("a19_node_totals", f"{EDGES} SELECT (SELECT count(*) FROM v_nodes) AS nodes, (SELECT count(*) FROM v_edges) AS edges, (SELECT count(*) FROM v_nodes WHERE complexity > 25) AS complex_nodes")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "v_nodes").agg(F.count("*").alias("nodes"), F.count_if(F.col("complexity") > 25).alias("complex_nodes"))
    return nodes.crossJoin(view(spark, sf_dir, "v_edges").agg(F.count("*").alias("edges")))

"""Queries of rules (k) and resolution joins (j01-j08, j13), and the parse manifest (a10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import filters, graph, resolve, rules
from quarry.plans.catalog_files import _EXT, _LANG, FILES
from quarry.plans.fixtures import ddb, each_document, planted, quoted, view
from quarry.plans.registry import query

EDGES = "WITH RECURSIVE " + ddb("v_edges", "v_nodes")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "m_functions").withColumn("calls", F.filter(F.split("call_list", ","), lambda x: x != ""))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = view(spark, sf_dir, "m_imports").withColumn("items", F.filter(F.split("items", ","), lambda x: x != ""))
    return resolve.import_origin(listed, view(spark, sf_dir, "m_paths"))


@query("j01_resolved_calls", each_document("""('main#', 'main#.py', 'load#', 'load#'), ('main#', 'main#.py', 'process', NULL), ('main#', 'main#.py', 'helper#', 'helper#'), ('UserService#.process', 'services#/user#.py', 'find#', 'UserRepo#.find#'),
  ('UserService#.process', 'services#/user#.py', 'helper#', 'helper#'), ('OrderService#.process', 'services#/order#.py', 'find#', 'UserRepo#.find#'), ('load#', 'utils#.py', 'helper#', 'helper#')""", "caller", "file_path", "callee", "target"))
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_calls(_functions(spark, sf_dir), _imports(spark, sf_dir))


@query("j02_local_imports", each_document("('main#.py', 'load#', 'load#'), ('services#/user#.py', 'find#', 'UserRepo#.find#')", "file_path", "key", "target"))
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.local_imports(_imports(spark, sf_dir), _functions(spark, sf_dir))


@query("j05_import_origin", each_document("""('main#.py', './utils#', 'local'), ('main#.py', 'requests', 'third_party'), ('main#.py', 'os.path', 'stdlib'), ('main#.py', 'services#.user#', 'local'), ('services#/user#.py', '..repo#/store#', 'local'),
  ('services#/order#.py', 'store#', 'local'), ('services#/order#.py', 'requests', 'third_party'), ('web#/a#.js', './b#', 'local'), ('web#/b#.js', './a#', 'local'), ('web#/a#.js', '@scope/kit', 'third_party'), ('web#/a#.js', 'fs', 'stdlib'), ('cmd#/x#.go', 'fmt', 'stdlib'),
  ('cmd#/x#.go', 'github.com/a/b', 'third_party'), ('lib#.rs', 'crate::m#', 'local'), ('App#.java', 'com.acme.Tool', 'local')""", "file_path", "module", "origin"))
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).select("file_path", "module", "origin")


@query("j04_external_dependencies", "SELECT dependency, n * (SELECT count(*) FROM documents) AS files FROM (VALUES ('requests', 2), ('@scope', 1), ('github', 1)) AS t(dependency, n)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.external_dependencies(_imports(spark, sf_dir))


@query("j03_import_files", each_document("""('main#.py', './utils#', 'utils#.py'), ('main#.py', 'services#.user#', 'services#/user#.py'), ('services#/user#.py', '..repo#/store#', 'repo#/store#.py'), ('services#/order#.py', 'store#', 'repo#/store#.py'),
  ('web#/a#.js', './b#', 'web#/b#.js'), ('web#/b#.js', './a#', 'web#/a#.js'), ('lib#.rs', 'crate::m#', NULL), ('App#.java', 'com.acme.Tool', NULL)""", "file_path", "module", "target"))
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = view(spark, sf_dir, "m_paths")
    return resolve.import_files(_imports(spark, sf_dir).where("origin = 'local'"), paths)


@query("j06_enriched_chunks", f"""{EDGES}, t AS (SELECT id, name, file, CASE id % 4 WHEN 0 THEN 'class_summary' WHEN 1 THEN 'method' ELSE 'function' END AS chunk_type FROM v_nodes),
  c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n, row_number() OVER (PARTITION BY dst ORDER BY src) AS m FROM v_edges),
  o AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS calls FROM c WHERE n <= 20 GROUP BY src), i AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS called_by FROM c WHERE m <= 20 GROUP BY dst),
  fe AS (SELECT DISTINCT a.file AS f, b.file AS g FROM v_edges JOIN v_nodes a ON src = a.id JOIN v_nodes b ON dst = b.id WHERE a.file <> b.file),
  d AS (SELECT f AS file, string_agg(g, ',' ORDER BY g) AS depends_on FROM fe GROUP BY f), e AS (SELECT g AS file, string_agg(f, ',' ORDER BY f) AS depended_by FROM fe GROUP BY g)
  SELECT id, CASE WHEN chunk_type = 'class_summary' THEN '' ELSE coalesce(calls, '') END AS calls, coalesce(called_by, '') AS called_by, coalesce(depends_on, '') AS depends_on, coalesce(depended_by, '') AS depended_by,
         file = (SELECT min(file) FROM v_nodes) OR name = (SELECT max(name) FROM v_nodes) AS is_entry
  FROM t LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN d USING (file) LEFT JOIN e USING (file)""")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = view(spark, sf_dir, "v_nodes"), graph.cut(view(spark, sf_dir, "v_edges"))
    kind = F.when(F.col("id") % 4 == 0, "class_summary").when(F.col("id") % 4 == 1, "method").otherwise("function")
    entries = nodes.agg(F.array(F.min("file"), F.max("name")).alias("x")).select(F.explode("x").alias("entry"))
    rich = resolve.enriched(nodes.select("id", "name", "file", kind.alias("chunk_type")), edges, graph.file_edges(nodes, edges), entries)
    return rich.select("id", *[F.array_join(c, ",").alias(c) for c in ("calls", "called_by", "depends_on", "depended_by")], "is_entry")


_PATHS = ["app/models/user.py", "app/views/user.py", "controllers/home.py", "services/api/routes.py", "docker-compose.yml", "cli/run.py", "web/pages/a.tsx", "a/__init__.py", "x/main.py", "y/main.go", "events/listeners.py"]
_LITERAL = ", ".join(f"({-n}, '{p}')" for n, p in enumerate(_PATHS, 1))
_TAGS = " UNION ALL ".join("SELECT file_id, '" + name + "' AS pattern FROM fs WHERE " + " OR ".join(f"contains(lower(path), '{s}')" for s in signals) for name, signals in config.PATTERN_SIGNALS.items())


@query("j07_pattern_tags", f"{FILES}, fs AS (SELECT file_id, path FROM v_files UNION ALL SELECT * FROM (VALUES {_LITERAL}) AS t(file_id, path)) {_TAGS}")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame([(-n, p) for n, p in enumerate(_PATHS, 1)], "file_id long, path string")
    return resolve.pattern_tags(view(spark, sf_dir, "v_files").select("file_id", "path").unionByName(literal))


@query("j08_used_imports", f"{FILES}, m AS (SELECT unnest(['os.path', 'a.The', 'b.und', 'requests', 'x.y.que', 'la']) AS m, unnest(range(6)) AS n) SELECT file_id, coalesce(string_agg(m, ',' ORDER BY n) FILTER (contains(lower(content), lower(list_last(string_split(m, '.'))))), '') AS used FROM v_files, m GROUP BY file_id")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = F.array(*map(F.lit, ["os.path", "a.The", "b.und", "requests", "x.y.que", "la"]))
    return view(spark, sf_dir, "v_files").select("file_id", F.array_join(resolve.used_imports(F.col("content"), modules), ",").alias("used"))


# every module against every path
_MATCHES = f"""WITH {ddb("m_imports", "m_paths")}, i AS (SELECT DISTINCT file_path, module, ltrim(module, './') AS inner_name, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS folder FROM m_imports),
  m AS (SELECT file_path, module, min(path) AS target FROM i JOIN m_paths ON path <> file_path AND (regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+?)\\.[^.]*$', '\\1') = module OR contains(path, replace(module, '.', '/'))
    OR (starts_with(module, '.') AND inner_name <> '' AND contains(path, inner_name) AND contains(path, folder))) GROUP BY file_path, module)"""


@query("j13_module_matches", f"{_MATCHES} SELECT * FROM m")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.module_matches(_imports(spark, sf_dir), view(spark, sf_dir, "m_paths"))


@query("g12_fallback_edges", f"{_MATCHES} SELECT DISTINCT file_path AS from_file, target AS to_file FROM m")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.module_matches(_imports(spark, sf_dir), view(spark, sf_dir, "m_paths")).select(F.col("file_path").alias("from_file"), F.col("target").alias("to_file")).distinct()


@query("r08_import_cycles", each_document("('web#/a#.js', 'web#/b#.js')", "a", "b"))
def r08_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = view(spark, sf_dir, "m_paths")
    edges = resolve.import_files(_imports(spark, sf_dir).where("origin = 'local'"), paths).where("target is not null")
    return graph.mutual(edges.select(F.col("file_path").alias("src"), F.col("target").alias("dst")))


def _patterns(spark: SparkSession) -> DataFrame:
    """The literal repository's patterns; its functions' names repeat, which must not count."""
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    imports = spark.createDataFrame([("services/api/routes.py", "fastapi"), ("services/api/routes.py", "repository.user"), ("cli/run.py", "click"), ("web/pages/a.tsx", "react"), ("x/main.py", "requests")], "file_path string, module string")
    functions = spark.createDataFrame([("handle_event",), ("user_service",), ("repo_get",), ("register_hook",), ("HANDLE_EVENT",), *[("Register_Hook",)] * 30], "name string")
    return rules.patterns(paths, imports, functions, spark.createDataFrame([("app.get('/x')",), ("router.post",)], "decorator string"))


# a repository for each document: what each table holds, of which a document has the rows whose number it doesn't share a remainder with
_OWN = {
    "p": ("path", [*_PATHS, "app/views.py", "app/models.py", "app/urls.py", "plugins/a.py", "k8s/x.yml", "lib/utils/helper.py", "setup.py"], 4),
    "i": ("file_path, module", [("services/api/routes.py", "fastapi"), ("services/api/routes.py", "repository.user"), ("cli/run.py", "click"), ("web/pages/a.tsx", "react"), ("x/main.py", "requests"), ("x/main.py", "sys"), ("x/main.py", "celery.app"), ("x/main.py", "django.db")], 3),
    "f": ("name", ["handle_event", "user_service", "repo_get", "register_hook", "HANDLE_EVENT", "argv", "Emit_all", "plugin_a", *(f"f{n}" for n in range(20))], 5),
    "d": ("decorator", ["app.get('/x')", "router.post", "app.ROUTE('/y')", "cached"], 3),
}
_OWN_SQL = "WITH " + ", ".join(
    f"{key} AS (SELECT doc_id, {', '.join(f'lower({c}) AS {c}' for c in columns.split(', '))} FROM documents, (VALUES "
    + ", ".join(f"({n}, {quoted([row] if isinstance(row, str) else list(row))})" for n, row in enumerate(rows)) + f") AS t(n, {columns}) WHERE doc_id % {every} <> n % {every})"
    for key, (columns, rows, every) in _OWN.items()
)


def _own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = []
    for columns, rows, every in _OWN.values():
        listed = [(n, row) if isinstance(row, str) else (n, *row) for n, row in enumerate(rows)]
        tables.append(planted(spark, sf_dir, listed, "n int, " + ", ".join(f"{c} string" for c in columns.split(", "))).where(F.col("doc_id") % every != F.col("n") % every).drop("n"))
    return rules.patterns(*tables, by=("doc_id",))


def _p(*words: str, of: str = "p", column: str = "path") -> str:
    """1 where a row of the table holds one of the words, else 0."""
    return f"coalesce(max(CAST({' OR '.join(f'contains({column}, {quoted([w])})' for w in words)} AS INT)), 0)"


def _sum(points: float, *words: str, column: str = "path") -> str:
    return "(" + " + ".join(f"{points} * {_p(w, column=column)}" for w in words) + ")"


def _c(*words: str, column: str = "name", distinct: str = "name") -> str:
    return f"count(DISTINCT CASE WHEN {' OR '.join(f'contains({column}, {quoted([w])})' for w in words)} THEN {distinct} END)"


# the points of each pattern that paths, imports, functions and decorators bring, and the most
_m = lambda points, *words: _sum(points, *words, column="module")
_mi = lambda *words: _p(*words, column="module")
_POINTS = {
    "k02_mvc": ("MVC", f"{_sum(1, 'models', 'views', 'controllers')} + 3 * least({_p('models.py')}, {_p('views.py')}, {_p('urls.py')}) + 3 * least({_p('app/models')}, {_p('app/views')})", _mi("django.db", "flask_sqlalchemy"), "0", "0", 6),
    "k03_layered": ("Layered Architecture", _sum(1.5, "services", "repositories", "handlers", "usecases"), "2 * count(DISTINCT CASE WHEN contains(file_path, 'service') AND contains(module, 'repo') THEN file_path END)", f"CASE WHEN {_c('service', 'usecase', 'handler')} > 0 AND {_c('repo', 'dao')} > 0 THEN 2 ELSE 0 END", "0", 7),
    "k04_rest_api": ("REST API", _sum(1, "routes", "endpoints", "api", "routers"), f"2 * {_mi('flask', 'fastapi', 'django.rest', 'express', 'spring', 'gin', 'echo')}", "0", "least(count(*) FILTER (regexp_matches(decorator, 'route|get|post|put|delete|patch')) / 5.0, 2.0)", 6),
    "k05_event_driven": ("Event-driven", _sum(1.5, "events", "handlers", "listeners", "subscribers", "publishers"), _m(2, "celery", "kafka", "rabbitmq", "redis", "pika", "kombu", "confluent"), f"least({_c('on_', 'handle_', 'emit', 'publish', 'subscribe', 'dispatch')} / 3.0, 2.0)", "0", 6),
    "k06_microservices": ("Microservices", rf"3 * {_p('docker-compose')} + 3 * {_p('kubernetes', 'k8s', 'helm')} + CASE WHEN count(*) FILTER (regexp_matches(path, '/(main\.py|main\.go|server\.js|main\.rs)$')) >= 2 THEN 2 ELSE 0 END", "coalesce(max(CAST(module IN ('requests', 'httpx', 'axios', 'http', 'https') AS INT)), 0)", "0", "0", 7),
    "k07_cli": ("CLI Application", _sum(1.5, "cli", "commands", "cmd"), _m(2.5, "click", "argparse", "typer", "docopt", "cobra", "commander", "clap"), "0", "0", 5),
    "k08_plugin": ("Plugin/Extension", _sum(2, "plugins", "extensions", "addons"), "0", f"least({_c('register', 'plugin', 'extension', 'hook')}, 2)", "0", 4),
    "k09_frontend": ("Frontend Component", rf"{_sum(1.5, 'components', 'pages', 'views', 'widgets')} + least(count(*) FILTER (regexp_matches(path, '\.(jsx|tsx)$')) / 5.0, 2.0)", f"2 * {_mi('react', 'vue', '@angular', 'svelte', 'preact')}", "0", "0", 5),
    "k10_library": ("Library/Utility", f"2 * {_p('__init__.py', 'index.ts', 'index.js')} + {_sum(0.5, 'serializer', 'signer', 'encoding', 'decoding', 'crypto', 'utils', 'helper', 'compat')} + 1.5 * {_p('setup.py', 'pyproject.toml', 'package.json')}", "0", "CASE WHEN count(DISTINCT name) > 20 THEN 1.5 ELSE 0 END", "0", 5),
}
_ARGV = "(SELECT doc_id, 1 AS v FROM (SELECT doc_id FROM i WHERE module = 'sys' INTERSECT SELECT doc_id FROM f WHERE name = 'argv') z)"
for _key, (_name, *_parts, _most) in _POINTS.items():
    _by = [f"(SELECT doc_id, CAST({_points} AS DOUBLE) AS v FROM {_table} GROUP BY doc_id)" for _table, _points in zip("pifd", _parts, strict=True)] + ([_ARGV] if _name == "CLI Application" else [])
    _total = " + ".join(f"coalesce(t{n}.v, 0)" for n in range(len(_by)))
    _joined = " ".join([f"{_by[0]} t0", *(f"LEFT JOIN {x} t{n} USING (doc_id)" for n, x in enumerate(_by[1:], 1))])
    query(_key, f"{_OWN_SQL}, s AS (SELECT doc_id, round(least(({_total}) / {_most}, 1), 6) AS confidence FROM {_joined}) SELECT doc_id, '{_name}' AS pattern, confidence FROM s WHERE confidence >= 0.2")(
        lambda spark, sf_dir, name=_name: _own_patterns(spark, sf_dir).where(F.col("pattern") == name)
    )


_LAYER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(p, '{s}') OR contains(n, '{s}')" for s in signals) + f" THEN '{name}'" for name, signals in config.LAYERS.items()) + " WHEN contains(p, 'test') OR contains(p, 'spec') THEN 'test' WHEN contains(p, '__init__') THEN 'module_init' WHEN starts_with(list_last(string_split(name, '.')), '_') THEN 'utility' ELSE 'unknown' END"


@query("k11_layer", f"{FILES}, x AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'Thing._part' ELSE 'thing' END AS name, lower(path) AS p FROM v_files), y AS (SELECT *, lower(name) AS n FROM x) SELECT file_id, {_LAYER} AS layer FROM y")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("file_id") % 3 == 0, "Thing._part").otherwise("thing")
    return view(spark, sf_dir, "v_files").select("file_id", rules.layer(F.col("path"), name).alias("layer"))


_NAMED = "concat(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'utils.' WHEN 2 THEN 'Store.' ELSE 'a.b.' END, replace(p_name, ' ', '_'))"


@query("k13_node_type", "SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN 'method' ELSE 'function' END AS type FROM part")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.fixtures import table

    return table(spark, sf_dir, "part").select("p_partkey", rules.node_type(F.expr(_NAMED)).alias("type"))


@query("k16_eligible", f"{EDGES}, n AS (SELECT id, id % 50 = 0 AS e, id % 7 = 0 AS h, CAST(id % 9 AS INT) AS d, id % 11 = 0 AS x, complexity FROM v_nodes) SELECT id FROM n WHERE e OR h OR d <= {config.ANALYZE_DEPTH} OR x OR complexity >= {config.MIN_COMPLEXITY} ORDER BY d, id LIMIT {config.LLM_BUDGET}")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    made = view(spark, sf_dir, "v_nodes").select("id", (i % 50 == 0).alias("is_entry"), (i % 7 == 0).alias("is_hub"), (i % 9).alias("depth"), (i % 11 == 0).alias("crosses"), "complexity")
    return rules.eligible(made).select("id")


@query("k18_importance", f"{EDGES}, i AS (SELECT dst AS id, count(*) AS c FROM v_edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS c FROM v_edges GROUP BY 1) SELECT id, CASE WHEN id % 50 = 0 THEN 1000 WHEN id % 20 = 0 THEN 500 ELSE 0 END + 10 * coalesce(i.c, 0) + 5 * coalesce(o.c, 0) + 2 * complexity + 3 AS score FROM v_nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id) ORDER BY score DESC, id DESC LIMIT {config.MAX_DIAGRAM_NODES}")
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = graph.cut(view(spark, sf_dir, "v_edges"))
    into, out = degree.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls_in")), degree.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls_out"))
    made = view(spark, sf_dir, "v_nodes").join(into, "id", "left").join(out, "id", "left").fillna(0, ["calls_in", "calls_out"])
    kind = F.when(F.col("id") % 50 == 0, "entry_point").when(F.col("id") % 20 == 0, "core_utility").otherwise("module")
    return rules.importance(made.select("id", kind.alias("type"), "calls_in", "calls_out", F.col("complexity").alias("functions"), F.lit(1).alias("classes")))


_FLAG_SQL = ", ".join("coalesce(bool_or(" + " OR ".join(f"contains(lower(path), '{w}')" for w in words) + f"), false) AS {flag}" for flag, words in config.PATH_FLAGS.items())


@query("k19_path_flags", f"{FILES} SELECT {_FLAG_SQL} FROM v_files")
def k19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.path_flags(view(spark, sf_dir, "v_files"))


_DESIGN = "CASE " + " ".join(f"WHEN contains(lower(text), '{p.lower()}') THEN '{p}'" for p in config.DESIGN_PATTERNS) + " END"


@query("k20_design_pattern", f"SELECT p_partkey, {_DESIGN.replace('text', 'p_name')} AS pattern FROM part UNION ALL SELECT -1, 'Factory'")
def k20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.fixtures import table

    texts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text")).unionByName(spark.createDataFrame([(-1, "a FACTORY with a proxy")], "p_partkey long, text string"))
    return texts.select("p_partkey", rules.design_pattern(F.col("text")).alias("pattern"))


@query("k21_file_rank", f"{FILES} SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY file_id % 7 <> 0, ({_LANG}) IS NULL, coalesce(({_LANG}) <> 'Python', true), file_id % 5 = 0, size_bytes DESC, path) AS place FROM v_files")
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "v_files").select("repo", "path", "size_bytes", filters.language(F.col("path")).alias("language"), (F.col("file_id") % 7 == 0).alias("is_entry"), (F.col("file_id") % 5 == 0).alias("is_ui"))
    return rules.file_rank(files, "Python").select("repo", "path", F.col("place").cast("long").alias("place"))


#: The language of each fifth of the documents, and what is written under the text.
_TAILS = [("Python", "if __name__ == '__main__': run()"), ("JavaScript", "module.exports = 1; process.argv"), ("TypeScript", "export const a = 1"), ("Go", "func main() {}"), ("Rust", "fn x() {}")]


@query("k22_blocks", "SELECT doc_id, n IN (0, 1, 3) AS main_block, n IN (1, 2) AS exports FROM (SELECT doc_id, doc_id % 5 AS n FROM documents) x")
def k22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of one of five languages, its text and a line that does or doesn't make it an entry or export something."""
    from quarry.plans.fixtures import table

    language, tail = (F.get(F.array(*[F.lit(x[i]) for x in _TAILS]), (F.col("doc_id") % 5).cast("int")) for i in (0, 1))
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", rules.main_block(content, language).alias("main_block"), rules.exports(content, language).alias("exports"))


_BRANCHES = "CASE language " + " ".join(
    f"WHEN '{name}' THEN 1 + len(regexp_extract_all(text, '" + "|".join([r"\b(?:" + "|".join(w for w in words if w.isalpha()) + r")\b", *(w.replace("|", r"\|").replace("?", r"\?") for w in words if not w.isalpha())]) + "'))"
    for name, words in config.COMPLEXITY_KEYWORDS.items()
) + " ELSE 1 END"


@query("x22_complexity", f"{FILES}, d AS (SELECT file_id, regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g') AS text, {_LANG} AS language FROM v_files) SELECT file_id, {_BRANCHES} AS complexity FROM d")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("content", "[^\\x00-\\x7F]", " ")
    return view(spark, sf_dir, "v_files").select("file_id", rules.complexity(plain, filters.language(F.col("path"))).alias("complexity"))


_FILES = [
    ("main.py", "Python", "x", True, False, True, False, True, 1, False), ("src/app.py", "Python", "app = Flask(__name__)", False, False, False, True, True, 0, False), ("src/tool.js", "JavaScript", "process.argv", False, False, False, True, False, 0, False),
    ("lib/util.ts", "TypeScript", "x", False, False, False, True, False, 0, False), ("A/Main.java", "Java", "x", False, True, False, True, False, 1, True), ("a/b.go", "Go", "x", False, False, False, True, False, 0, False),
]
_FILE_COLUMNS = "path string, language string, body string, has_main_block boolean, has_exports boolean, flagged boolean, imported boolean, imports_others boolean, main_functions int, static_main boolean"


def _entries(spark: SparkSession) -> DataFrame:
    return rules.entry_points(spark.createDataFrame(_FILES, _FILE_COLUMNS))


@query("k01_entry_points", each_document("""('d#/main.py', 12, 'high', 'main_block,high_name,parser_flag,imports_only,main_function'), ('d#/app.py', 4, 'medium', 'medium_name,web'), ('d#/tool.js', 3, 'medium', 'cli,no_exports'), ('d#/util.ts', 1, 'low', 'no_exports'),
  ('d#/Main.java', 6, 'high', 'high_name,java_main'), ('x#.go', 5, 'high', 'parser_flag,root_level,web')""", "path", "score", "confidence", "signals").replace("replace(score, '#', CAST(doc_id AS VARCHAR)) AS score", "score"))
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as the end of the files of a small repository; one that scores nothing is left out."""
    from quarry.plans.fixtures import table

    own = [("x#.go", *row[1:2], "gin.New()", False, False, True, *row[6:]) if row[0] == "a/b.go" else (f"d#/{row[0].rsplit('/', 1)[-1]}", *row[1:]) for row in _FILES] + [("d#/b.go", "Go", "x", False, False, False, True, False, 0, False)]
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = planted(spark, sf_dir, own, _FILE_COLUMNS).join(texts, "doc_id").withColumn("body", F.concat_ws("\n", "body", "text"))
    return rules.entry_points(files)


@query("a10_parse_manifest", f"{FILES} SELECT count(*) AS files, count(*) FILTER (WHERE ({_LANG}) IS NOT NULL) AS parsed, count(*) FILTER (WHERE ({_LANG}) IS NULL) AS failed, count(DISTINCT {_EXT}) AS extensions, 'A/Main.java,main.py' AS entry_points, 'CLI Application,Event-driven,Frontend Component,Layered Architecture,Library/Utility,MVC,Microservices,REST API' AS patterns FROM v_files")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = rules.parse_manifest(view(spark, sf_dir, "v_files"), _entries(spark), _patterns(spark))
    return manifest.withColumns({c: F.array_join(c, ",") for c in ("entry_points", "patterns")})

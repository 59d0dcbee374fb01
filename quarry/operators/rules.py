"""Rules over paths, names and texts: k01-k22, j01-j08."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.filters import extension, file_name, language, parts


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def holds(text: Column, words: list[str]) -> Column:
    """any_of() for long texts: a search for each word in turn, many times faster there than a pattern of all."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_of(text: Column, rules: dict[str, list[str]], otherwise: Column) -> Column:
    """The first rule that has a word in the text."""
    out = None
    for name, words in rules.items():
        out = F.when(any_of(text, words), name) if out is None else out.when(any_of(text, words), name)
    return out.otherwise(otherwise)


def layer(path: Column, name: Column) -> Column:
    """The architectural layer of a function: the first layer with a signal in its path or name, else by path and privacy."""
    path, lower = F.lower(F.coalesce(path, F.lit(""))), F.lower(name)
    private = F.element_at(F.split(name, r"\."), -1).startswith("_")
    rest = F.when(any_of(path, ["test", "spec"]), "test").when(path.contains("__init__"), "module_init").when(private, "utility").otherwise("unknown")
    return first_of(F.concat_ws("\n", path, lower), config.LAYERS, rest)


def crosses_layers(a: Column, b: Column) -> Column:
    expected = reduce(lambda x, y: x | y, ((a == x) & (b == y) for x, y in config.EXPECTED_CALLS))
    return (a != b) & ~b.isin(config.OPEN_LAYERS) & ~expected


def node_type(name: Column) -> Column:
    steps = F.split(name, r"\.")
    return F.when(F.size(steps) == 1, "function").when((F.size(steps) == 2) & ~F.get(steps, 0).rlike(r"^\p{Lu}"), "function").otherwise("method")


def query_type(question: Column) -> Column:
    return first_of(question, config.QUERY_TYPES, F.when(question.contains("explain"), "explain").otherwise("general"))


def multi_hop(question: Column, kind: Column, entities: Column) -> Column:
    return kind.isin("explain", "what_breaks") | (question.contains(" and ") & (F.size(entities) > 1)) | (F.size(entities) > 2)


def graph_query(question: Column, kind: Column) -> Column:
    return kind.isin("what_calls", "what_imports") | any_of(question, config.RELATION_WORDS)


def eligible(nodes: DataFrame, budget: int = config.LLM_BUDGET) -> DataFrame:
    """Nodes (id, depth, is_entry, is_hub, crosses, complexity) that are analysed: entries, hubs, shallow, cross-layer or complex ones, the first `budget` by (depth, id)."""
    wanted = nodes.where(F.col("is_entry") | F.col("is_hub") | (F.col("depth") <= config.ANALYZE_DEPTH) | F.col("crosses") | (F.col("complexity") >= config.MIN_COMPLEXITY))
    return wanted.orderBy("depth", "id").limit(budget)


def confidence(answer: Column, found: Column, mean: Column, citations: Column) -> Column:
    """`high`, `medium` or `low`, by rules in order: nothing found, doubt, score, no citation, hedging, many citations."""
    lower = F.lower(answer)
    down = lambda c: F.when(c == "high", "medium").otherwise("low")
    level = F.when(mean >= config.HIGH_CONFIDENCE, "high").when(mean >= config.MEDIUM_CONFIDENCE, "medium").otherwise("low")
    level = F.when(citations == 0, down(level)).otherwise(level)
    level = F.when(any_of(lower, config.HEDGING), down(level)).otherwise(level)
    level = F.when((citations >= 3) & (mean >= config.MEDIUM_CONFIDENCE) & (level == "medium"), "high").otherwise(level)
    return F.when(found == 0, "low").when(any_of(lower, config.UNCERTAIN), "low").otherwise(level)


def importance(nodes: DataFrame, most: int = config.MAX_DIAGRAM_NODES) -> DataFrame:
    """The most important nodes (id, type, calls_in, calls_out, functions, classes) of a diagram; ties: the last name first."""
    kind = F.when(F.col("type") == "entry_point", 1000).when(F.col("type") == "core_utility", 500).otherwise(0)
    score = kind + 10 * F.col("calls_in") + 5 * F.col("calls_out") + 2 * F.col("functions") + 3 * F.col("classes")
    return nodes.select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(most)


def path_flags(files: DataFrame) -> DataFrame:
    """One row: a flag for each architectural signal that a path holds."""
    path = F.lower("path")
    return files.agg(*[F.coalesce(F.bool_or(any_of(path, words)), F.lit(False)).alias(flag) for flag, words in config.PATH_FLAGS.items()])


def design_pattern(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*[F.when(lower.contains(p.lower()), p) for p in config.DESIGN_PATTERNS])


def file_rank(files: DataFrame, primary: str) -> DataFrame:
    """Files (path, language, size_bytes, is_entry, is_ui) with their place: entries, code, the primary language, no user interface, then large ones first."""
    first = lambda test: F.when(test, 0).otherwise(1)
    code = F.col("language").isNotNull()
    order = Window.partitionBy("repo").orderBy(first(F.col("is_entry")), first(code), first(F.coalesce(F.col("language") == primary, F.lit(False))), first(~F.col("is_ui")), F.desc("size_bytes"), "path")
    return files.select("repo", "path", F.row_number().over(order).alias("place"))


def main_block(content: Column, language: Column) -> Column:
    """Whether a source has its language's main block."""
    has = content.contains
    return (
        F.when(language == "Python", has("if __name__") & has("__main__")).when(language.isin("JavaScript", "TypeScript"), has("process.argv") | has("require.main"))
        .when(language == "Java", has("public static void main")).when(language == "Go", has("func main()")).when(language == "Rust", has("fn main()"))
        .when(language.isin("C", "C++"), has("int main(")).otherwise(False)
    )


def exports(content: Column, language: Column) -> Column:
    words = ["module.exports", "export default", "export const", "export function", "export class"]
    return language.isin("JavaScript", "TypeScript") & any_of(content, words)


def complexity(content: Column, language: Column) -> Column:
    """1 + the branching words and operators of the language in the text."""
    out = None
    for name, words in config.COMPLEXITY_KEYWORDS.items():
        plain, signs = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        pattern = "|".join([rf"\b(?:{'|'.join(plain)})\b", *map(re.escape, signs)])
        count = F.regexp_count(content, F.lit(pattern)) + 1
        out = F.when(language == name, count) if out is None else out.when(language == name, count)
    return out.otherwise(F.lit(1)).cast("long")


def entry_points(files: DataFrame) -> DataFrame:
    """path, score, confidence, signals of files (path, language, body, has_main_block, has_exports, flagged, imported, imports_others, main_functions, static_main) with a score."""
    name = file_name(F.col("path"))
    body = F.col("body")
    java = (F.col("language") == "Java") & F.col("static_main")
    rules = [
        (F.col("has_main_block"), 3, "main_block"), (name.isin(config.HIGH_NAMES), 3, "high_name"), (F.col("flagged"), 2, "parser_flag"),
        (~F.col("imported") & F.col("imports_others"), 2, "imports_only"), ((F.col("main_functions") > 0) & java, 3, "java_main"), ((F.col("main_functions") > 0) & ~java, 2, "main_function"),
        (name.isin(config.MEDIUM_NAMES), 2, "medium_name"), (F.size(parts(F.col("path"))) == 1, 1, "root_level"), (holds(body, config.WEB_SIGNALS), 2, "web"),
        (holds(body, config.CLI_SIGNALS), 2, "cli"), (~F.col("has_exports") & F.col("language").isin("JavaScript", "TypeScript"), 1, "no_exports"),
    ]
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(points).alias("points"), F.lit(label).alias("label"))) for test, points, label in rules]), lambda x: x.isNotNull())
    # exploded, so that the condition on the score is not tested below and each text is searched once
    found = files.select("path", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    scored = found.select("path", F.aggregate("hits", F.lit(0), lambda total, x: total + x["points"]).alias("score"), F.array_join(F.col("hits.label"), ",").alias("signals"))
    return scored.withColumn("confidence", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def patterns(paths: DataFrame, imports: DataFrame, functions: DataFrame, decorators: DataFrame, least: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """pattern, confidence of the nine architectural patterns that reach `least`, from paths (path), imports (file_path, module), functions (name) and decorators (decorator); of each repository where all have its key, `by`.

    Each table becomes one row of flags and counts a repository; no text of all paths is made. A repository without paths has no row, and one without imports, functions or decorators counts none."""
    path, module, name = F.lower("path"), F.lower("module"), F.lower("name")
    functions = functions.select(*by, name.alias("name")).distinct()  # a name counts once, whatever its case
    name = F.col("name")
    has = lambda column, *words: F.coalesce(F.bool_or(any_of(column, list(words))), F.lit(False)).cast("int")
    count = lambda column, *words: F.count_if(any_of(column, list(words)))
    # Each detector's words and points.
    words = {
        "p": ["models", "views", "controllers", "services", "repositories", "handlers", "usecases", "routes", "endpoints", "api", "routers", "events", "listeners", "subscribers", "publishers", "cli", "commands", "cmd",
              "plugins", "extensions", "addons", "components", "pages", "widgets", "models.py", "views.py", "urls.py", "app/models", "app/views", "serializers", "docker-compose", "kubernetes", "k8s", "helm", "__init__.py",
              "index.ts", "index.js", "serializer", "signer", "encoding", "decoding", "crypto", "utils", "helper", "compat", "setup.py", "pyproject.toml", "package.json"],
        "i": ["django.db", "flask_sqlalchemy", "flask", "fastapi", "django.rest", "express", "spring", "gin", "echo", "serializer", "celery", "kafka", "rabbitmq", "redis", "pika", "kombu", "confluent", "click", "argparse", "typer", "docopt", "cobra", "commander", "clap", "react", "vue", "@angular", "svelte", "preact"],
    }
    main = F.count_if(F.element_at(F.split("path", "/"), -1).isin("main.py", "main.go", "server.js", "main.rs") & F.col("path").contains("/"))
    p = paths.groupBy(*by).agg(*[has(path, w).alias(f"p:{w}") for w in words["p"]], main.alias("p#main"), F.count_if(F.col("path").rlike(r"\.(jsx|tsx)$")).alias("p#jsx"))
    service = F.lower("file_path").contains("service") & any_of(module, ["repository", "repo"])
    i = imports.groupBy(*by).agg(
        *[has(module, w).alias(f"i:{w}") for w in words["i"]], F.countDistinct(F.when(service, F.col("file_path"))).alias("i#service"),
        F.coalesce(F.bool_or(module.isin("requests", "httpx", "axios", "http", "https")), F.lit(False)).cast("int").alias("i#http"),
        F.coalesce(F.bool_or(module == "sys"), F.lit(False)).cast("int").alias("i#sys"),
    )
    f = functions.groupBy(*by).agg(
        count(name, "service", "usecase", "handler").alias("f#service"), count(name, "repository", "repo", "dao").alias("f#repo"),
        count(name, "on_", "handle_", "emit", "publish", "subscribe", "dispatch").alias("f#event"), count(name, "register", "plugin", "extension", "hook").alias("f#plugin"),
        F.count("*").alias("f#all"), F.coalesce(F.bool_or(name == "argv"), F.lit(False)).cast("int").alias("f#argv"),
    )
    d = decorators.groupBy(*by).agg(count(F.lower("decorator"), "route", "get", "post", "put", "delete", "patch").alias("d#route"))
    row = p
    for part in (i, f, d):
        row = row.join(part, list(by), "left") if by else row.crossJoin(part)
    row = row.fillna(0)
    c = lambda key: F.col(f"`{key}`")
    total = lambda kind, names, points: reduce(lambda a, b: a + b, (c(f"{kind}:{w}") * points for w in names))
    one = lambda kind, names: F.greatest(*[c(f"{kind}:{w}") for w in names])
    every = lambda kind, names: F.least(*[c(f"{kind}:{w}") for w in names])
    scores = {
        "MVC": (total("p", ["models", "views", "controllers"], 1) + every("p", ["models.py", "views.py", "urls.py"]) * 3 + every("p", ["app/models", "app/views"]) * 3 + one("i", ["django.db", "flask_sqlalchemy"]), 6),
        "Layered Architecture": (total("p", ["services", "repositories", "handlers", "usecases"], 1.5) + c("i#service") * 2 + F.when((c("f#service") > 0) & (c("f#repo") > 0), 2).otherwise(0), 7),
        "REST API": (total("p", ["routes", "endpoints", "api", "routers"], 1) + one("i", ["flask", "fastapi", "django.rest", "express", "spring", "gin", "echo"]) * 2 + F.least(c("d#route") / 5, F.lit(2.0)) + F.greatest(c("p:serializers"), c("i:serializer")), 6),
        "Event-driven": (total("p", ["events", "handlers", "listeners", "subscribers", "publishers"], 1.5) + total("i", ["celery", "kafka", "rabbitmq", "redis", "pika", "kombu", "confluent"], 2) + F.least(c("f#event") / 3, F.lit(2.0)), 6),
        "Microservices": (c("p:docker-compose") * 3 + one("p", ["kubernetes", "k8s", "helm"]) * 3 + F.when(c("p#main") >= 2, 2).otherwise(0) + c("i#http"), 7),
        "CLI Application": (total("p", ["cli", "commands", "cmd"], 1.5) + total("i", ["click", "argparse", "typer", "docopt", "cobra", "commander", "clap"], 2.5) + c("i#sys") * c("f#argv"), 5),
        "Plugin/Extension": (total("p", ["plugins", "extensions", "addons"], 2) + F.least(c("f#plugin"), F.lit(2)), 4),
        "Frontend Component": (total("p", ["components", "pages", "views", "widgets"], 1.5) + F.least(c("p#jsx") / 5, F.lit(2.0)) + one("i", ["react", "vue", "@angular", "svelte", "preact"]) * 2, 5),
        "Library/Utility": (one("p", ["__init__.py", "index.ts", "index.js"]) * 2 + total("p", ["serializer", "signer", "encoding", "decoding", "crypto", "utils", "helper", "compat"], 0.5) + one("p", ["setup.py", "pyproject.toml", "package.json"]) * 1.5 + F.when(c("f#all") > 20, 1.5).otherwise(0), 5),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("pattern"), F.round(F.least(score.cast("double") / most, F.lit(1.0)), 6).alias("confidence")) for n, (score, most) in scores.items()])
    return row.select(*by, F.explode(listed).alias("x")).select(*by, "x.*").where(F.col("confidence") >= least)


def parse_manifest(files: DataFrame, entries: DataFrame, found: DataFrame, least: float = 0.4) -> DataFrame:
    """One row: files, parsed, failed, extensions, the entry points of high confidence and the patterns of `least` or more."""
    known = language(F.col("path")).isNotNull()
    counts = files.agg(F.count("*").alias("files"), F.count_if(known).alias("parsed"), F.count_if(~known).alias("failed"), F.countDistinct(extension(F.col("path"))).alias("extensions"))
    listed = lambda rows, column, name: rows.agg(F.array_sort(F.collect_list(column)).alias(name))
    high = listed(entries.where("confidence = 'high'"), "path", "entry_points")
    return counts.crossJoin(high).crossJoin(listed(found.where(F.col("confidence") >= least), "pattern", "patterns"))

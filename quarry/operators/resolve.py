"""Names and imports to what they stand for: j01-j08, j13, a10.

Indexes hold each key once with the number of things it names, so a join never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.filters import file_name
from quarry.operators.shared import cut


#: Characters of a text that tell where in a path it may begin.
HEAD = 3
#: Rows of a key above which it is looked up by broadcast.
OFTEN = 10_000


def spread_join(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows left-joined to known, which has each key (a string) once. Keys of over OFTEN rows, at most a row in so many, meet theirs by broadcast and rows without a key meet none, so no task has all rows of one key."""
    rows, values = cut(rows), [c for c in known.columns if c != key]
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > OFTEN).select(key).join(known, key, "left")
    marked = rows.join(F.broadcast(often.select(key, F.lit(True).alias("_often"), *values)), key, "left")
    alone = F.col("_often").isNull() & F.col(key).isNotNull()
    light = marked.where(alone).select(*rows.columns).join(known, key, "left")
    return marked.where(~alone).select(*rows.columns, *values).unionByName(light.select(*rows.columns, *values))


def name_index(functions: DataFrame) -> DataFrame:
    """key, n, target: functions by name and by qualified name, each counted once; target is the first of them."""
    keys = functions.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("key"), "qualified_name", "file_path").distinct()
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("qualified_name").alias("target"))


def local_imports(imports: DataFrame, functions: DataFrame) -> DataFrame:
    """file_path, key, target: items that local imports (file_path, items, origin) bring and that name exactly one function."""
    items = imports.where("origin = 'local'").select("file_path", F.explode("items").alias("key")).where("key <> '*'").distinct()
    return items.join(name_index(functions).where("n = 1"), "key").select("file_path", "key", "target")


def resolved_calls(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """caller, file_path, callee, target of each call (functions: file_path, name, qualified_name, calls); target is null where it stays open.

    In order: a name imported to the file, the file's own first function of the name, the only one of the name or qualified name
    anywhere, the only one of its last segment. Built-in names are left out."""
    calls = functions.select(F.col("qualified_name").alias("caller"), "file_path", F.explode("calls").alias("callee")).where(~F.col("callee").isin(config.BUILTINS)).distinct()
    index = name_index(functions)
    by_import = local_imports(imports, functions).select("file_path", F.col("key").alias("callee"), F.col("target").alias("t1"))
    own = functions.groupBy("file_path", F.col("name").alias("callee")).agg(F.min("qualified_name").alias("t2"))
    only = index.where("n = 1")
    last = F.element_at(F.split("callee", r"\."), -1)
    out = calls.join(by_import, ["file_path", "callee"], "left").join(own, ["file_path", "callee"], "left")
    out = out.join(only.select(F.col("key").alias("callee"), F.col("target").alias("t3")), "callee", "left").withColumn("last", last)
    out = out.join(only.select(F.col("key").alias("last"), F.col("target").alias("t4")), "last", "left")
    fourth = F.when(F.col("callee").contains("."), F.col("t4"))
    return out.select("caller", "file_path", "callee", F.coalesce("t1", "t2", "t3", fourth).alias("target"))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+?)\.[^.]*$", "$1")


def local_roots(paths: DataFrame) -> DataFrame:
    """root: names that an import in the repository may start with, stems and directories."""
    return paths.select(F.explode(F.array_union(F.array(stem(F.col("path"))), F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))))).alias("root")).distinct()


def import_origin(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (file_path, module, language) with `origin`: local, stdlib or third_party."""
    module, language = F.col("module"), F.col("language")
    root = F.get(F.split(module, r"\.|/|::"), 0)
    known = local_roots(paths).withColumn("known", F.lit(True))
    joined = spread_join(imports.withColumn("root", root), known, "root")
    root, local = F.col("root"), F.coalesce("known", F.lit(False))
    kind = (
        F.when(module.startswith("."), "local")
        .when((language == "Python") & root.isin(config.PYTHON_MODULES), "stdlib")
        .when(language.isin("JavaScript", "TypeScript") & root.isin(config.NODE_MODULES), "stdlib")
        .when(local, "local").when(module.startswith("@"), "third_party")
        .when((language == "Java") & (root == "com"), "local").when((language == "Java") & root.isin("java", "javax", "sun", "org", "io", "net"), "third_party")
        .when((language == "Go") & ~module.contains(".") & ~module.contains("/"), "stdlib")
        .when((language == "Rust") & root.isin("std", "core", "alloc"), "stdlib").when((language == "Rust") & root.isin("crate", "super", "self"), "local")
        .otherwise("third_party")
    )
    return joined.withColumn("origin", kind).drop("root", "known")


def external_dependencies(imports: DataFrame) -> DataFrame:
    """dependency, files: first segments of third-party modules."""
    third = imports.where("origin = 'third_party'")
    return third.groupBy(F.get(F.split("module", r"\.|/"), 0).alias("dependency")).agg(F.countDistinct("file_path").alias("files"))


def import_files(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """file_path, module, target of local imports: leading dots walk up from the file, inner dots of Python modules are directories; the first suffix that is a
    file wins, else the only file of that stem."""
    module = F.regexp_replace(F.col("module"), "^/+", "")
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.regexp_replace(module, r"^\.*/*", "")
    rest = F.when((F.col("language") == "Python") & ~rest.contains("/"), F.replace(rest, F.lit("."), F.lit("/"))).otherwise(rest)
    steps = F.split("file_path", "/")
    folder = F.slice(steps, 1, F.greatest(F.size(steps) - F.greatest(dots, F.lit(1)), F.lit(0)))
    relative = F.array_join(F.filter(F.concat(folder, F.array(rest)), lambda x: x != ""), "/")
    base = F.when(dots > 0, relative).otherwise(F.when(rest.contains("/"), rest).otherwise(F.replace(rest, F.lit("."), F.lit("/"))))
    asked = imports.select("file_path", "module", base.alias("base")).distinct()
    bases = asked.select("base").distinct()
    tries = bases.select("base", F.posexplode(F.transform(F.array(*[F.lit(s) for s in config.IMPORT_SUFFIXES]), lambda s: F.concat("base", s))).alias("pos", "path"))
    direct = tries.join(paths.select("path"), "path").groupBy("base").agg(F.min_by("path", "pos").alias("direct"))
    stems = paths.groupBy(stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("by_stem")).where("n = 1").drop("n")
    found = spread_join(bases.withColumn("stem", F.element_at(F.split("base", "/"), -1)).join(direct, "base", "left"), stems, "stem")
    return spread_join(asked, found.select("base", F.coalesce("direct", "by_stem").alias("target")), "base").select("file_path", "module", "target")


def pattern_tags(files: DataFrame) -> DataFrame:
    """file_id, pattern: architectural patterns with a signal in the path."""
    path = F.lower("path")
    tags = F.array(*[F.when(path.rlike("|".join(_quoted(s) for s in signals)), F.lit(name)) for name, signals in config.PATTERN_SIGNALS.items()])
    return files.select("file_id", F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("pattern"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def used_imports(content: Column, modules: Column) -> Column:
    """Modules whose last segment occurs in the content."""
    return F.filter(modules, lambda m: F.contains(F.lower(content), F.lower(F.element_at(F.split(m, r"\."), -1))))


def enriched(chunks: DataFrame, edges: DataFrame, file_edges: DataFrame, entries: DataFrame, most: int = 20) -> DataFrame:
    """chunks (id, file, chunk_type) with calls (of functions and methods) and called_by, at most so many each in order of id; depends_on and depended_by, the files that theirs imports and
    is imported by (from_file, to_file); is_entry, whether their file or name is an entry point (entry)."""
    def listed(rows: DataFrame, key: str, value: str, on: str, name: str, limit: int | None = None) -> DataFrame:
        pairs = rows.select(F.col(key).alias(on), F.col(value).alias("x")).distinct()
        if limit:
            pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy(on).orderBy("x"))).where(F.col("n") <= limit)
        return pairs.groupBy(on).agg(F.array_sort(F.collect_list("x")).alias(name))

    code = chunks.where(F.col("chunk_type").isin("function", "method")).select("id")
    calls = listed(edges.join(code, edges["src"] == code["id"], "left_semi"), "src", "dst", "id", "calls", most)
    out = chunks.join(calls, "id", "left").join(listed(edges, "dst", "src", "id", "called_by", most), "id", "left")
    out = out.join(listed(file_edges, "from_file", "to_file", "file", "depends_on"), "file", "left").join(listed(file_edges, "to_file", "from_file", "file", "depended_by"), "file", "left")
    known = entries.select(F.col("entry").alias("_entry")).distinct()
    by_file, by_name = known.select(F.col("_entry").alias("file"), F.lit(True).alias("_f")), known.select(F.col("_entry").alias("name"), F.lit(True).alias("_n"))
    out = out.join(by_file, "file", "left").join(by_name, "name", "left").withColumn("is_entry", F.coalesce("_f", "_n", F.lit(False))).drop("_f", "_n")
    kinds = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("calls", "called_by", "depends_on", "depended_by")})


def paths_with(asked: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """parts, path: for each array of texts (parts) the first `most` paths, in order, that contain all of them.

    Parts are found by their longest text as a whole, so a path meets only those whose text it contains. Of a path's substrings, those alone are posted that begin as some text begins (HEAD characters, or all
    of a shorter text) and are as long as one of the texts of that beginning; beginnings are few, whatever the number of texts."""
    longest = F.array_max(F.transform("parts", lambda part: F.struct(F.length(part).alias("n"), part.alias("text"))))["text"]
    keyed = asked.select("parts").distinct().withColumn("text", longest)
    heads = keyed.groupBy(F.substring("text", 1, HEAD).alias("head")).agg(F.collect_set(F.length("text")).alias("lengths"))
    left = F.length("path") - F.col("at") + 1
    starts = F.array(F.when(F.col("at") == 1, ""), *[F.when(left >= n, F.substring("path", F.col("at"), F.lit(n))) for n in range(1, HEAD + 1)])
    spots = paths.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))).alias("at"))
    spots = spots.select("path", "at", F.explode(starts).alias("head")).join(F.broadcast(heads), "head").select("path", "at", F.explode("lengths").alias("n")).where(F.col("n") <= left)
    found = keyed.join(spots.select(F.substring("path", F.col("at"), F.col("n")).alias("text"), "path"), "text")
    # the path goes into the array: Spark 4.1 pushes a lambda that refers to another column below the join
    both = F.arrays_zip("parts", F.array_repeat("path", F.size("parts")))
    found = found.where((F.size("parts") == 1) | F.forall(both, lambda x: F.contains(x["1"], x["parts"])))
    place = F.dense_rank().over(Window.partitionBy("parts").orderBy("path"))  # a text may be in a path more than once
    return found.select("parts", "path", place.alias("place")).where(F.col("place") <= most).drop("place").distinct()


def module_matches(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """file_path, module, target: the first file by path, other than the importing one, that an import may mean where no map is known.

    A file may be meant if its stem is the module, if its path contains the module with slashes for dots, or, for a module that begins with a dot, if it contains the importing
    file's directory and the module without leading dots and slashes."""
    module, folder = F.col("module"), F.regexp_replace("file_path", "/?[^/]*$", "")
    inner = F.regexp_replace(module, r"^[./]+", "")
    asked = imports.select("file_path", "module").distinct().withColumn("ways", F.filter(F.array(F.array(F.replace(module, F.lit("."), F.lit("/"))), F.when(module.startswith(".") & (inner != ""), F.array(inner, folder))), lambda x: x.isNotNull()))
    ways = asked.select("file_path", "module", F.explode("ways").alias("parts"))
    within = ways.join(paths_with(ways.select("parts"), paths, 2), "parts").select("file_path", "module", "path")
    stems = paths.select(stem(F.col("path")).alias("module"), "path").distinct()
    stems = stems.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy("path"))).where("place <= 2").drop("place")
    both = within.unionByName(asked.join(stems, "module").select("file_path", "module", "path")).where("path <> file_path")
    return both.groupBy("file_path", "module").agg(F.min("path").alias("target"))

"""Chunks of code and their texts: x01-x10, x21, x23."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.filters import tokens

#: Chunks that are read before their parts leave the task, and characters of parts that do before that.
ROWS, HELD = 64, 1 << 20


def signature(name: Column, parameters: Column, returns: Column) -> Column:
    """`def name(a: int = 1, *rest) -> str` of parameters (name, type, value, variadic)."""
    one = F.transform(parameters, lambda p: F.concat(F.when(p["variadic"], "*").otherwise(""), p["name"], F.when(p["type"].isNotNull(), F.concat(F.lit(": "), p["type"])).otherwise(""), F.when(p["value"].isNotNull(), F.concat(F.lit(" = "), p["value"])).otherwise("")))
    return F.concat(F.lit("def "), name, F.lit("("), F.array_join(one, ", "), F.lit(")"), F.when(returns.isNotNull(), F.concat(F.lit(" -> "), returns)).otherwise(""))


def parsed_parameters() -> Column:
    """The parameters of signature() from the parser's columns params, types and defaults."""
    def one(p: Column) -> Column:
        kind, value = F.nullif(p["types"], F.lit("")), F.nullif(p["defaults"], F.lit(""))
        return F.struct(F.regexp_replace(p["params"], r"^\*", "").alias("name"), kind.alias("type"), value.alias("value"), p["params"].startswith("*").alias("variadic"))

    return F.transform(F.arrays_zip("params", "types", "defaults"), one)


def function_text(path: Column, language: Column, name: Column, decorators: Column, signed: Column, docstring: Column, body: Column) -> Column:
    """A function's chunk, parts that are missing left out."""
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), language), F.concat(F.lit("Function: "), name), F.when(F.size(decorators) > 0, F.array_join(decorators, ", ")), signed, F.when(docstring != "", docstring), body)


def class_text(path: Column, language: Column, name: Column, bases: Column, docstring: Column, methods: Column, attributes: Column) -> Column:
    last = F.transform(methods, lambda m: F.element_at(F.split(m, r"\."), -1))
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), language), F.concat(F.lit("Class: "), name), F.when(F.size(bases) > 0, F.concat(F.lit("Inherits: "), F.array_join(bases, ", "))), F.when(docstring != "", docstring), F.concat(F.lit("Methods: "), F.array_join(last, ", ")), F.concat(F.lit("Attributes: "), F.array_join(attributes, ", ")))


def file_text(path: Column, language: Column, imports: Column, classes: Column, functions: Column, entry: Column) -> Column:
    listed = lambda head, x: F.concat(F.lit(head), F.coalesce(F.nullif(F.array_join(x, ", "), F.lit("")), F.lit("none")))
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), language), listed("Imports: ", imports), listed("Classes defined: ", classes), listed("Functions defined: ", functions), F.concat(F.lit("Entry point: "), F.when(entry, "yes").otherwise("no")))


def import_contexts(imports: DataFrame, over: int = 3) -> DataFrame:
    """file_path, content of files with more than `over` imports (file_path, module, origin)."""
    named = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("origin") == kind, F.col("module")))), ", ")
    many = imports.groupBy("file_path").agg(F.count("*").alias("n"), named("third_party").alias("third"), named("local").alias("local"), named("stdlib").alias("std")).where(F.col("n") > over)
    text = F.concat_ws("\n", F.concat(F.lit("Import dependencies for: "), "file_path"), F.concat(F.lit("External libraries used: "), "third"), F.concat(F.lit("Local modules imported: "), "local"), F.concat(F.lit("Standard library used: "), "std"))
    return many.select("file_path", text.alias("content"))


def split_lines(content: str, most: int = config.MAX_CHUNK_TOKENS, overlap: int = config.OVERLAP_TOKENS) -> list[str]:
    """Parts of whole lines, each as long as `most` tokens allow (at least one new line), each but the first opened by as many lines of the one before as `overlap` allows.

    A line's tokens are a quarter of its characters, rounded down; what opens a part is rounded as one with its first new line. Both sums never fall from line to line,
    so where a part ends and where its opening starts is found by bisection in their prefix sums."""
    lengths = [len(line) for line in content.splitlines(keepends=True)]
    chars, cost = [0, *accumulate(lengths)], [0, *accumulate(n // 4 for n in lengths)]
    parts, opening, new = [], 0, 0  # the part's first line, and its first that isn't of the part before
    while new < len(lengths):
        used = (chars[new + 1] - chars[opening]) // 4
        end = max(new + 1, bisect_right(cost, most - used + cost[new + 1]) - 1)
        parts.append(content[chars[opening] : chars[end]])
        opening, new = bisect_left(cost, cost[end] - overlap, opening, end), end
    return parts


def truncated(content: Column) -> Column:
    """Other chunks are cut at 800 characters."""
    return F.when(F.length(content) > 800, F.concat(F.substring(content, 1, 800), F.lit("\n... [truncated]"))).otherwise(content)


def splitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of batches (id, name, chunk_type, content), some at a time: what is held is a batch as it came, and ROWS chunks or HELD characters of parts."""
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        ids, part, n, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(text, pa.string())], ["id", "part", "parts", "content"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for key, name, kind, content in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                over = len(content) // 4 > config.MAX_CHUNK_TOKENS
                groups = split_lines(content) if over and kind in ("function", "method") else []
                if len(groups) < 2:
                    groups, heads = [content[:800] + "\n... [truncated]" if over else content], [""]
                else:
                    heads = [f"# Continuation of {name} (part {i + 1}/{len(groups)})\n\n" for i in range(len(groups))]
                for i, text in enumerate(groups):
                    rows.append((key, i, len(groups), heads[i] + text))
                    held += len(text)
                    if held >= HELD:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()
                rows, held = [], 0


def split_chunks(chunks: DataFrame) -> DataFrame:
    """id, part, parts, content of chunks (id, name, chunk_type, content): functions and methods over the limit in overlapping parts under a head, other chunks
    over it, and those of one line, cut; the rest whole."""
    rows = chunks.select(F.col("id").cast("long"), "name", "chunk_type", F.coalesce("content", F.lit("")).alias("content"))
    return rows.mapInArrow(splitted, "id long, part int, parts int, content string")


def keywords(name: Column, parameters: Column, decorators: Column, docstring: Column) -> Column:
    """Search words of a function, in order and once each, at most 20: parts of its name, parameters, decorators, first ten words of its text."""
    good = lambda w: (F.length(w) > 2) & ~F.lower(w).isin(config.CODE_STOP_WORDS)
    words = F.regexp_extract_all(docstring, F.lit("[a-zA-Z][a-zA-Z0-9_]{2,}"), 0)
    listed = F.concat(
        F.filter(F.split(name, r"[._\s]+"), good), F.filter(parameters, good),
        F.filter(F.transform(decorators, lambda d: F.get(F.split(F.regexp_replace(d, "^@+", ""), r"\("), 0)), lambda d: F.length(d) > 2), F.slice(F.filter(words, good), 1, 10),
    )
    return F.slice(F.array_distinct(F.transform(listed, F.lower)), 1, 20)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """qualified_name, chunk_id: the first part of each name's chunks, then the least id."""
    first = Window.partitionBy("qualified_name").orderBy("subchunk_index", "chunk_id")
    return chunks.withColumn("n", F.row_number().over(first)).where("n = 1").select("qualified_name", "chunk_id")


def clean_docstring(raw: Column) -> Column:
    """A docstring without its quotes or comment marks, each line trimmed."""
    bare = F.regexp_replace(F.trim(raw), r"^(\"\"\"|'''|/\*\*?)|(\"\"\"|'''|\*/)$", "")
    return F.trim(F.array_join(F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(\*|//+|#)\s?", "")), "\n"))


def hashes(path: Column, content: Column) -> Column:
    return F.struct(F.substring(F.md5(path), 1, 12).alias("path_hash"), F.substring(F.sha2(content, 256), 1, 16).alias("content_hash"))

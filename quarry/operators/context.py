"""Contexts, answers, conversations and jobs: c01-c15, t05-t09, q01-q07."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.filters import file_name, tokens
from quarry.operators.folds import greedy_fill
from quarry.operators.shared import cut


def prioritised(rows: DataFrame) -> DataFrame:
    """rows with `place`: looked-up entities first, then by score, then by id."""
    order = Window.partitionBy("query").orderBy(F.when(F.col("source") == "entity", 0).otherwise(1), F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(order))


def clipped(answer: Column, most: int = 300) -> Column:
    return F.when(F.length(answer) > most, F.concat(F.substring(answer, 1, most - 3), F.lit("..."))).otherwise(answer)


def history(turns: DataFrame, last: int = 3) -> DataFrame:
    """conv_id, history: the last turns (conv_id, turn, question, answer), oldest first, long answers clipped."""
    ranked = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("n") <= last)
    line = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), clipped(F.col("answer")))
    return ranked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("history"))


def with_history(conversations: DataFrame, last: int = 3) -> DataFrame:
    """conv_id, turn, text, history, previous of each user's turn (conv_id, turn, role, text): the last answered turns before it as history() has them, and the newest one's answer."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(by_turn).alias("answer"), F.lead("role").over(by_turn).alias("_next")).where("role = 'user'")
    answered = F.col("_next") == "assistant"
    line = F.concat(F.lit("Q: "), F.coalesce("text", F.lit("")), F.lit("\nA: "), F.coalesce(clipped(F.col("answer")), F.lit("")))
    pairs = rows.where(answered).select("conv_id", "turn", "answer", line.alias("line"))
    recent = F.concat_ws("\n\n", *[F.lag("line", n).over(by_turn) for n in range(last - 1, 0, -1)], "line")
    pairs = pairs.select("conv_id", "turn", F.struct(recent.alias("history"), F.col("answer").alias("previous")).alias("pair"))
    before = F.last("pair", True).over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "turn", "text").join(pairs, ["conv_id", "turn"], "left").withColumn("x", before).select("conv_id", "turn", "text", "x.history", "x.previous")


def kept_turns(turns: DataFrame, most: int = config.MAX_TURNS) -> DataFrame:
    """The last turns of each conversation, with the number of all its turns."""
    w = Window.partitionBy("conv_id")
    ranked = turns.withColumn("n", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("total", F.count("*").over(w))
    return ranked.where(F.col("n") <= most).drop("n")


def token_budget(history: Column) -> Column:
    return F.lit(config.MAX_CONTEXT_TOKENS) - F.least(tokens(history), F.lit(config.MAX_HISTORY_TOKENS))


def filled(rows: DataFrame, budget: int | str = config.MAX_CONTEXT_TOKENS) -> DataFrame:
    """Chunks (query, place, tokens) that fit each query's budget in order of place, those that don't fit skipped; where none fits, the first."""
    taken = greedy_fill(rows, "query", ["place"], "tokens", budget, at_least_one=True).where("accepted").drop("accepted")
    return rows.join(taken, ["query", "place"])


def without_parts(rows: DataFrame) -> DataFrame:
    """Sub-chunks go where their query has the whole function's chunk."""
    whole = rows.where("not is_subchunk").select("query", F.col("qualified_name").alias("parent_function")).distinct()
    return rows.where("not is_subchunk").unionByName(rows.where("is_subchunk").join(whole, ["query", "parent_function"], "left_anti").select(*rows.columns))


def grouped_by_file(rows: DataFrame) -> DataFrame:
    """rows with `seat`: files in order of their first chunk, chunks in order of lines."""
    first = F.min("place").over(Window.partitionBy("query", "file"))
    return rows.withColumn("_first", first).withColumn("seat", F.row_number().over(Window.partitionBy("query").orderBy("_first", "file", "start_line", "id"))).drop("_first")


def block(chunk_type: Column, name: Column, path: Column, content: Column) -> Column:
    """A chunk as text under a head by its type."""
    head = F.when(chunk_type.isin("function", "method"), F.concat(F.initcap(chunk_type), F.lit(": "), name)).when(chunk_type == "class_summary", F.concat(F.lit("Class: "), name)).otherwise(F.concat(F.lit("File: "), path))
    return F.concat(head, F.lit("\n"), content)


def joined(rows: DataFrame) -> DataFrame:
    """query, context: the chunks' blocks in order of seat."""
    ordered = F.array_sort(F.collect_list(F.struct("seat", "block")))
    return rows.groupBy("query").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), config.SEPARATOR).alias("context"))


def collected(rows: DataFrame) -> DataFrame:
    """query, items, chunks, mean: the chunks (query, seat, id, score, file, start_line, name, chunk_type, text) of each query in order of seat, their number and mean score."""
    item = F.struct("seat", "id", "score", "file", "start_line", "name", "chunk_type", "text")
    return rows.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("chunks"), F.avg("score").alias("mean"))


def context_of(items: Column) -> Column:
    """The blocks of collected() chunks, joined."""
    return F.array_join(F.transform(items, lambda x: block(x["chunk_type"], x["name"], x["file"], x["text"])), config.SEPARATOR)


def cited_sources(answer: Column, items: Column, most: int = 10) -> Column:
    """file, start, end, name of the collected() chunks that an answer refers to, the first by descending score, then id."""
    named = F.filter(items, lambda x: cited(answer, x["name"], x["file"], x["text"]))
    source = lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("start"), (x["start_line"] + F.size(F.split(x["text"], "\n")) - 1).alias("end"), x["name"].alias("name"))
    ranked = F.array_sort(F.transform(named, lambda x: F.struct((-x["score"]).alias("least"), x["id"].alias("id"), source(x).alias("source"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["source"])


def cited(answer: Column, name: Column, path: Column, content: Column) -> Column:
    """Whether an answer refers to a chunk: its name as a whole word, its file's name, or two identifiers of its content."""
    lower = F.lower(answer)
    whole = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.lower(name), F.lit(r"\E(?![A-Za-z0-9_])"))
    by_name = (F.length(name) > 3) & F.rlike(lower, whole)
    words = F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z_][a-zA-Z0-9_]{3,}(?![A-Za-z0-9_])"), 0)
    return F.coalesce(by_name, F.lit(False)) | lower.contains(F.lower(file_name(path))) | (F.size(F.filter(words, lambda w: F.contains(lower, F.lower(w)))) >= 2)


def relevance(chunk_type: Column) -> Column:
    return F.when(chunk_type == "function", "Function implementation").when(chunk_type == "method", "Method implementation").when(chunk_type == "class_summary", "Class definition").when(chunk_type == "file_summary", "Module overview").otherwise("Code reference")


def sourced(answer: Column, sources: Column) -> Column:
    """An answer and the list of its sources (file, start, end, name)."""
    lines = F.transform(sources, lambda s: F.concat(F.lit("• "), s["file"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.lit(" — "), F.coalesce(s["name"], F.lit("(file summary)"))))
    return F.when(F.size(sources) > 0, F.concat(answer, F.lit("\n\n---\nSources:\n"), F.array_join(lines, "\n"))).otherwise(answer)


def no_answer(question: Column) -> Column:
    """What is said where nothing was found, with two suggestions."""
    entity = F.regexp_extract(question, r"\b([A-Z][a-zA-Z0-9]*)\b", 1)
    first = F.when(entity != "", F.concat(F.lit("Where is "), entity, F.lit(" defined?"))).otherwise("What files are in this repository?")
    return F.concat(F.lit("No relevant code was found. Related questions:\n• "), first, F.lit("\n• What are the main classes or functions?"))


def file_budget(files: DataFrame, lines: int = 80, chars: int = 14_000) -> DataFrame:
    """repo, path, excerpt: the first lines of files in order of place until the characters are used up; the last is cut, then no more."""
    short = F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")
    cut = files.select("repo", "path", "place", short.alias("excerpt"))
    before = F.coalesce(F.sum(F.length("excerpt")).over(Window.partitionBy("repo").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_before", before).where(F.col("_before") < chars).withColumn("excerpt", F.expr(f"substring(excerpt, 1, int({chars} - _before))")).drop("_before", "place")


def story_json(raw: Column, required: list[str]) -> Column:
    """Text of a JSON object without its code fence, and whether it has all required fields."""
    bare = F.trim(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    found = F.json_object_keys(bare)
    return F.struct(bare.alias("json"), F.coalesce(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), found)) == 0, F.lit(False)).alias("valid"))


def processed(asked: DataFrame) -> DataFrame:
    """asked (query, text, previous, cited) with resolved (clean, its pronoun standing for the first entity of the previous answer), type, entities (of the text, then
    names cited in the last turns), keywords, multi_hop and graph_query."""
    from quarry.operators import rules

    resolved = resolved_question(clean_question(F.col("text")), F.get(entities(F.coalesce("previous", F.lit(""))), 0))
    out = asked.withColumn("resolved", resolved).withColumn("type", rules.query_type(F.col("resolved")))
    out = out.withColumn("entities", F.array_distinct(F.concat(entities(F.col("text")), F.coalesce("cited", F.array().cast("array<string>")))))
    out = out.withColumn("keywords", keywords(F.col("resolved")))
    return out.withColumn("multi_hop", rules.multi_hop(F.col("resolved"), F.col("type"), F.col("entities"))).withColumn("graph_query", rules.graph_query(F.col("resolved"), F.col("type")))


def prompt(question: Column, context: Column, history: Column) -> Column:
    return F.format_string("Context:\n%s\n\nHistory:\n%s\n\nQuestion: %s", context, F.coalesce(history, F.lit("")), question)


def clean_question(text: Column) -> Column:
    """Trimmed, straight quotes, lower case."""
    return F.lower(F.translate(F.trim(text), "“”‘’", "\"\"''"))


def keywords(question: Column) -> Column:
    """A question's words without stop words and outer punctuation, those of three characters or with _, a capital, a dot or digits alone, once each in order."""
    punctuation = "[" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]+"
    words = F.filter(F.split(question, r"\s+"), lambda w: (w != "") & ~w.isin(config.STOP_WORDS))
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"^{punctuation}|{punctuation}$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & (w.contains("_") | w.rlike("[A-Z]") | w.contains(".") | w.rlike("^[0-9]+$") | (F.length(w) > 2))))


def entities(text: Column) -> Column:
    """Names in a text, once each in order of kind: CamelCase, lower-case names but for stop words, file names, qualified names. Words end at ASCII borders."""
    border = lambda p: F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), 0)
    camel, snake = border("[A-Z][a-z]+(?:[A-Z][a-z]+)+"), border("[a-z_][a-z0-9_]{2,}")
    snake = F.filter(snake, lambda w: w.contains("_") | ~w.isin(config.STOP_WORDS))
    files, qualified = border(r"[A-Za-z0-9_-]+\.(?:py|js|ts|java|go|rs|c|cpp|rb|php)"), border(r"[A-Z][a-zA-Z0-9]*\.[a-z_][a-z0-9_]*")
    return F.array_distinct(F.concat(camel, snake, files, qualified))


def resolved_question(question: Column, entity: Column) -> Column:
    """The first of it, this, that in the question stands for the entity."""
    out = question
    swapped = F.lit(False)
    for word in ("it", "this", "that"):
        has = question.rlike(rf"(?i)\b{word}\b") & ~swapped
        first = F.concat(F.regexp_extract(question, rf"(?is)^(.*?)\b{word}\b", 1), entity, F.regexp_extract(question, rf"(?is)^.*?\b{word}\b(.*)$", 1))
        out, swapped = F.when(has & entity.isNotNull(), first).otherwise(out), swapped | question.rlike(rf"(?i)\b{word}\b")
    return out


def placed(rows: DataFrame, key: str, time: str) -> DataFrame:
    """rows with `place` over all of them, latest first, then by key; rows are ranked inside ranges of time, and only one count for each range goes through one task."""
    dealt = rows.repartitionByRange(F.desc(time), key).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = dealt.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(time), key))
    return dealt.withColumn("_own", own).join(bases, "_range").withColumn("place", F.col("_base") + F.col("_own")).drop("_range", "_own", "_base")


# jobs


def progress(raw: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def latest(events: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key; of several at one time the largest."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("x")).select(key, "x.*")


def duplicates(jobs: DataFrame) -> DataFrame:
    """phase, repo_key, job_id: the first job of each that is queued or running."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("phase", "repo_key").agg(F.min("job_id").alias("job_id"))


def cleaned(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Jobs but for those that ended more than so many hours ago."""
    return jobs.where(~(F.col("status").isin("complete", "failed") & (F.col("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))))


def gate(jobs: DataFrame, phase: str, needs: str) -> DataFrame:
    """repo_key, code: 404 where the needed phase never began, 409 where it isn't complete, 202 where `phase` may start."""
    done = F.coalesce(F.bool_or((F.col("phase") == needs) & (F.col("status") == "complete")), F.lit(False))
    begun = F.coalesce(F.bool_or(F.col("phase") == needs), F.lit(False))
    return jobs.groupBy("repo_key").agg(F.when(~begun, 404).when(~done, 409).otherwise(202).alias("code")).withColumn("phase", F.lit(phase))

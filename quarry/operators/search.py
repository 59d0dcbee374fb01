"""Hybrid retrieval: BM25, cosine neighbours, merging, fusion, ranking (x11-x16, x24, j09-j11, t01-t05).

BM25 asks a stored inverted index (inverted.py). Vectors and, in blocks, stated query vectors are written to the shared folder; a task has a block and one of SLABS shares of the vectors, and holds the k best rows of
each of its queries while that share streams by. So vectors are read once a block, and what is shuffled is at most SLABS times k rows a query, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import inverted
from quarry.operators.shared import SLABS, cut, fresh, grid, in_blocks, opened, read_block

#: Queries of a block, questions of a block for the index (each reads it once), and rows that are scored together.
BLOCK, ASKED, SLICE = 2048, 8192, 1024
#: Bytes of a row group of stored vectors.
GROUP = 1 << 20


class Best:
    """The k best (score, id) of each of n queries; ties: the lesser id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, products: np.ndarray, ids: np.ndarray) -> None:
        """products: (queries, rows); a score is max(0, product), rounded to six digits, which is done only for those that may come among the best."""
        last = self.score[:, -1:]
        query, row = np.nonzero((products >= last - 1e-6) | (last <= 0))
        score, new = np.round(np.maximum(products[query, row], 0.0), 6), ids[row]
        better = (score > last[query, 0]) | ((score == last[query, 0]) & (new < self.id[query, -1]))
        query, score, new = query[better], score[better], new[better]
        if not len(query):
            return
        # only queries that have something new are sorted again
        touched, of = np.unique(query, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(touched)), self.k), of])
        score, new = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), new])
        order = np.lexsort((new, -score, of))
        taken = order[np.searchsorted(of[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched] = score[taken], new[taken]

    def rows(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.isfinite(self.score)
        columns = [pa.array(np.repeat(names, self.k).reshape(kept.shape)[kept], pa.int64()), pa.array(self.id[kept], pa.int64()), pa.array(self.score[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])


def terms(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def lengths(docs: DataFrame) -> DataFrame:
    """id, n: words of each document."""
    return docs.select("id", F.size(terms(F.col("text"))).cast("long").alias("n"))


def idf(docs: DataFrame) -> DataFrame:
    """term, idf of docs (id, text): ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean over all terms."""
    return idf_of(docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), docs)


def idf_of(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """idf() of terms whose documents (df) are counted."""
    total = docs.agg(F.count("*").alias("docs"))
    raw = cut(seen.crossJoin(F.broadcast(total)).select("term", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg((F.avg("raw") * config.BM25_EPSILON).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, questions: DataFrame, k: int, block: int = ASKED, index: inverted.Index | None = None) -> DataFrame:
    """query, id, score, rank: the k docs (id, text) of greatest score for each question (query, text), those of score 0 among them, the least ids first; repeated words of a question
    count repeatedly. A question without words has none. An index of the same docs may be given; else one is made."""
    spark = docs.sparkSession
    asked = questions.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    rows = docs.select(F.col("id").cast("long").alias("id"), terms(F.coalesce("text", F.lit(""))).alias("listed"))
    index = index or inverted.build(rows)
    weights = cut(asked.join(idf_of(inverted.documents_of(spark, index), docs), "term", "left").select("query", "term", (F.col("times") * F.coalesce("idf", F.lit(0.0))).alias("weight")))
    found = cut(inverted.search(spark, index, weights, k, block))
    # every document of a negative score has been found, and no more than k above 0 are needed, so of the rest, of score 0, so many of the least ids are enough
    worst = weights.agg(F.min("weight")).first()[0]
    ids = docs.select(F.col("id").cast("long").alias("id")).distinct()
    least = F.broadcast(ids.orderBy("id").limit(2 * k)) if worst is None or worst >= 0 else ids
    full = found.where("score > 0").groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = weights.select("query").distinct().join(full, "query", "left_anti")
    blank = short.crossJoin(least).join(found.select("query", "id"), ["query", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(found.unionByName(blank), k)


def top(rows: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The first k of each query by descending score, with their rank; ties: the lesser id."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id")))
    return ranked.where(F.col("rank") <= k)


def normalised(rows: DataFrame) -> DataFrame:
    """score over the query's best (1 where that is 0)."""
    best = F.max("score").over(Window.partitionBy("query"))
    return rows.withColumn("score", F.round(F.col("score") / F.when(best == 0, 1.0).otherwise(best), 6))


def _neighbours(place: str, blocks: list[str], k: int):
    def best_of(uri: str, slab: int) -> Iterator[pa.RecordBatch]:
        block, best, at = None, None, 0
        for file in opened(place):
            groups = file.metadata.num_row_groups
            own, at = [g for g in range(groups) if (at + g) % SLABS == slab], at + groups
            for part in file.iter_batches(SLICE, row_groups=own, columns=["id", "v"]) if own else ():
                if best is None:
                    block = read_block(uri)
                    if block is None:
                        return
                    matrix = np.asarray(block["q"].combine_chunks().flatten(), np.float64).reshape(block.num_rows, -1)
                    best = Best(len(matrix), k)
                rows = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                best.add(matrix @ rows.T, np.asarray(part.column(0)))
        if best is not None:
            yield from best.rows(np.asarray(block["query"]))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, slab in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from best_of(blocks[block], slab)

    return neighbours


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: the k rows (id, v) of greatest max(0, cosine) with each stated query (query, q); ties: the lesser id."""
    spark, place = vectors.sparkSession, fresh(vectors.sparkSession, "vectors")
    vectors.where(F.size("v") > 0).select(F.col("id").cast("long").alias("id"), "v").write.option("parquet.block.size", GROUP).parquet(place)
    blocks = in_blocks(queries.select(F.col("query").cast("long"), "q").where(F.size("q") > 0), "query", block)
    return top(grid(spark, len(blocks), SLABS).mapInArrow(_neighbours(place, blocks, k), "query long, id long, score double"), k)


def merged(semantic: DataFrame, keyword: DataFrame, extra: DataFrame) -> DataFrame:
    """query, id, semantic, keyword, source of candidates (query, id, score): semantic ones first; keyword hits add their score; extra ones add new ids only."""
    a = semantic.select("query", "id", F.col("score").alias("semantic"))
    b = keyword.select("query", "id", F.col("score").alias("keyword"))
    both = a.join(b, ["query", "id"], "full")
    source = F.when(F.col("keyword").isNull(), "semantic").when(F.col("semantic").isNull(), "keyword").otherwise("semantic+keyword")
    found = both.select("query", "id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"), source.alias("source"))
    new = extra.join(found.select("query", "id"), ["query", "id"], "left_anti").groupBy("query", "id").agg(F.max("score").alias("semantic"))
    return found.unionByName(new.select("query", "id", "semantic", F.lit(0.0).alias("keyword"), F.lit("extra").alias("source")))


def with_entities(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates and the looked-up entities (query, id) that aren't among them."""
    new = entities.join(found.select("query", "id"), ["query", "id"], "left_anti")
    return found.unionByName(new.select("query", "id", F.lit(1.0).alias("semantic"), F.lit(0.0).alias("keyword"), F.lit("entity").alias("source")))


def fused(rows: DataFrame) -> DataFrame:
    """rows with `score`: the weighted sum, a bonus where both are above 0, at most 1; looked-up entities score 0.95."""
    both = (F.col("semantic") > 0) & (F.col("keyword") > 0)
    total = config.SEMANTIC_WEIGHT * F.col("semantic") + config.KEYWORD_WEIGHT * F.col("keyword") + F.when(both, config.BOTH_BONUS).otherwise(0.0)
    return rows.withColumn("score", F.when(F.col("source") == "entity", 0.95).otherwise(F.round(F.least(total, F.lit(1.0)), 8)))


def reciprocal_ranks(rankings: DataFrame, k: int = 60) -> DataFrame:
    """query, id, score: the sum of 1 / (k + rank) over the rankings (query, id, rank)."""
    return rankings.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def penalised(rows: DataFrame, factor: float = 0.8) -> DataFrame:
    """Scores of entry points lowered for questions of type where_is."""
    return rows.withColumn("score", F.when((F.col("type") == "where_is") & F.col("is_entry"), F.round(F.col("score") * factor, 6)).otherwise(F.col("score")))


def functions_only(rows: DataFrame) -> DataFrame:
    """For questions of type what_calls, functions and methods alone, unless none would be left."""
    code = F.col("chunk_type").isin("function", "method")
    left = F.count_if(code).over(Window.partitionBy("query"))
    return rows.withColumn("_left", left).where((F.col("type") != "what_calls") | (F.col("_left") == 0) | code).drop("_left")


def looked_up(entities: DataFrame, index: DataFrame) -> DataFrame:
    """query, id of entities (query, entities) that are names in the index (name, id)."""
    return entities.select("query", F.explode("entities").alias("name")).join(index, "name").select("query", "id").distinct()


def fuzzy_lookup(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, chunk_id: the chunk of the qualified name, else of the simple name; functions and methods first, then by id."""
    prefer = Window.partitionBy("name").orderBy("step", F.when(F.col("chunk_type").isin("function", "method"), 0).otherwise(1), "chunk_id")
    simple = names.select("name", F.element_at(F.split("name", r"\."), -1).alias("key"))
    exact = names.join(chunks, names["name"] == chunks["qualified_name"]).select(names["name"], "chunk_id", "chunk_type", F.lit(0).alias("step"))
    loose = simple.join(chunks.select("simple_name", "chunk_id", "chunk_type"), F.col("key") == F.col("simple_name")).select("name", "chunk_id", "chunk_type", F.lit(1).alias("step"))
    return exact.unionByName(loose).withColumn("n", F.row_number().over(prefer)).where("n = 1").select("name", "chunk_id")

"""An inverted-file index over vectors (x13, t01): every row under its nearest centre, searched by (file, block of questions) as rows of one plan.

Centres are fitted on a bounded sample (`sample` rows of least hash); every row is assigned and stored as it is in files of one centre's rows, of at most `file_rows` each, so a centre that holds a third of all rows
is many files. Questions are stored in blocks of one centre. A task scores one block against one file at a time and keeps the k best of each question: its memory is a block, a batch and k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import BLOCK, SLICE, Best, top
from quarry.operators.shared import cut, fresh, read_block

#: Bound of the sample that centres are fitted on, rows of a file, rounds of fitting.
SAMPLE, FILE_ROWS, ROUNDS = 20_000, 65_536, 10
#: Questions whose cells leave a task together, each with its vector for every cell.
PROBED = 64
#: Tasks, at most, that (file, block) pairs are dealt to.
TASKS = 2048


@dataclass
class Index:
    """place: folder of (cell, id, v); centres: unit vectors; of each cell, the least cosine of a member with its centre (2 where it has none) and the greatest length of a member."""

    place: str
    centres: np.ndarray
    cosines: np.ndarray
    lengths: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.nan_to_num(np.asarray(column.flatten(), np.float64)).reshape(len(column), width)


def fitted(rows: np.ndarray, centres: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: at most `centres` unit vectors; a centre that loses its rows takes the row that is worst served."""
    rows = _unit(rows)
    distinct = np.unique(rows, axis=0)
    found = distinct[np.random.default_rng(seed).permutation(len(distinct))[:centres]]
    for _ in range(rounds):
        scores = rows @ found.T
        of, best = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, rows)
        empty = np.nonzero(np.bincount(of, minlength=len(found)) == 0)[0]
        sums[empty] = rows[np.argsort(best, kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


def _assign(centres: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = _matrix(part.column(1), centres.shape[1])
                scores = _unit(rows) @ centres.T
                cell = scores.argmax(1)
                cosine, length = scores[np.arange(len(rows)), cell], np.linalg.norm(rows, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), pa.array(cosine), pa.array(length), part.column(1)], names=["id", "cell", "cosine", "length", "v"])

    return assign


def build(vectors: DataFrame, centres: int = 256, sample: int = SAMPLE, file_rows: int = FILE_ROWS) -> Index | None:
    """An index of all rows (id, v) under at most `centres` centres, one for 16 sampled rows; None where none has a vector. Rows without one, or of another length than the sample's first, are not in it.

    A vector's null entries count as 0, as does a vector of length 0, which is in some cell with score 0."""
    spark = vectors.sparkSession
    rows = vectors.where(F.size("v") > 0).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not len(drawn):
        return None
    width = len(drawn["v"][0])
    alike = drawn.filter(pa.compute.equal(pa.compute.list_value_length(drawn["v"]), width))
    found = fitted(_matrix(alike["v"], width), max(1, min(centres, len(alike) // 16)))
    place = fresh(spark, "vectors")
    assigned = rows.where(F.size("v") == width).mapInArrow(_assign(found), "id long, cell int, cosine double, length double, v array<double>")
    # a cell's rows go to one task, or to one for each file of them that the sample lets expect; else every task would write a small file of every cell
    matrix = _matrix(alike["v"], width)
    share = np.bincount((_unit(matrix) @ found.T).argmax(1), minlength=len(found)) / len(matrix)
    parts = F.array(*[F.lit(int(n)) for n in np.maximum(1, np.ceil(share * rows.count() / file_rows))])
    assigned.repartition("cell", F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell")))).write.option("maxRecordsPerFile", file_rows).partitionBy("cell").parquet(place)
    cosines, lengths = np.full(len(found), 2.0), np.zeros(len(found))
    for cell, least, most in spark.read.parquet(place).groupBy("cell").agg(F.min("cosine"), F.max("length")).collect():  # one row a centre
        cosines[cell], lengths[cell] = least, most
    return Index(place, found, cosines, lengths)


def _probe(centres: np.ndarray, cosines: np.ndarray, lengths: np.ndarray, probes: int):
    """Each question's nearest `probes` cells that hold rows; where a floor is known, every other cell that may hold a row of that score."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.nonzero(cosines <= 1.5)[0]
        radius = np.arccos(np.clip(cosines[held], -1, 1))
        for batch in (whole.slice(at, PROBED) for whole in batches for at in range(0, whole.num_rows, PROBED)):
            asked = _matrix(batch.column(1), centres.shape[1])
            scores = _unit(asked) @ centres[held].T
            order = np.argsort(-scores, axis=1, kind="stable")
            chosen = np.zeros(scores.shape, bool)
            np.put_along_axis(chosen, order[:, :probes], True, axis=1)
            floor = np.asarray(batch.column(2).fill_null(np.nan), np.float64)
            known = ~np.isnan(floor)
            if known.any():
                angle = np.maximum(np.arccos(np.clip(scores, -1, 1)) - radius, 0)
                # vectors may be of any length, which scales their scores; scores are rounded to 6 digits
                bound = np.maximum(np.cos(angle), 0) * np.linalg.norm(asked, axis=1, keepdims=True) * lengths[held]
                chosen[known] = (~chosen & (bound + 2e-6 >= floor[:, None]))[known]
            at, cell = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(held[cell], pa.int32()), batch.column(1).take(pa.array(at))], names=["query", "cell", "q"]).append_column("floor", batch.column(2).take(pa.array(at)))

    return probe


def _score(k: int, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        from pyarrow import fs, parquet

        for batch in batches:
            for file, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = read_block(uri)
                asked, best = _matrix(block["q"], width), Best(block.num_rows, k)
                # a row below the floor isn't among the k best; places that no row took keep the floor and no id
                floor = np.asarray(block["floor"].combine_chunks().fill_null(-np.inf), np.float64)
                best.score[:] = floor[:, None]
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path if system.get_file_info(path).type == fs.FileType.File else unquote(path)) as source:
                    for part in parquet.ParquetFile(source).iter_batches(SLICE, columns=["id", "v"]):
                        rows = _matrix(part.column(1), width)
                        best.add(asked @ rows.T, np.asarray(part.column(0)))
                best.score[(best.id == np.iinfo(np.int64).max) & (best.score == floor[:, None])] = -np.inf
                yield from best.rows(np.asarray(block["query"]))

    return score


def _pass(spark: SparkSession, index: Index, asked: DataFrame, k: int, probes: int, block: int) -> DataFrame:
    """query, id, score of the cells that each question (query, q, floor) probes: the k best of each (file, block), written to the shared folder."""
    width = index.centres.shape[1]
    cells = cut(asked.select("query", "q", "floor").mapInArrow(_probe(index.centres, index.cosines, index.lengths, probes), "query long, cell int, q array<double>, floor double"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row a centre
    place = fresh(spark, "questions")
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.concat_ws("_", "cell", F.pmod(F.xxhash64("query"), "blocks")))
    dealt.repartition("part").select("query", "q", "floor", "part").write.partitionBy("part").parquet(place)
    blocks = dealt.select("cell", "part").distinct().select("cell", F.concat(F.lit(f"{place}/part="), "part").alias("block"))
    files = spark.read.parquet(index.place).select("cell", F.col("_metadata.file_path").alias("file")).distinct()
    tasks = cut(files.join(blocks, "cell").select("file", "block"))
    # by number: the pairs are few bytes, which adaptive execution would put into one task
    return cut(tasks.repartition(min(max(tasks.count(), 1), TASKS), "file", "block").mapInArrow(_score(k, width), "query long, id long, score double"))


def nearest(index: Index | None, queries: DataFrame, k: int, probes: int = 32, exact: bool = True, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: the k rows of greatest max(0, cosine) with each question (query, q, of the index's width; for unit vectors the product is the cosine), ties: the lesser id.

    Rows of the `probes` nearest cells, then those of every cell whose members can reach the k-th score too, by the angle between its centre and the question and its members' greatest angle, so that
    no better row is missed; without `exact`, the first alone. Without an index there are no rows."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    asked = queries.where(F.size("q") == index.centres.shape[1]).select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q"))
    found = top(_pass(spark, index, asked.withColumn("floor", F.lit(None).cast("double")), k, probes, block), k)
    if not exact:
        return found
    last = found.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    again = asked.join(last, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    return top(found.drop("rank").unionByName(_pass(spark, index, again, k, probes, block)), k)

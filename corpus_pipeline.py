"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage gets its predecessor's rows with the columns of documents, works on all of them and, but for the last, returns
the rows it keeps, unchanged. Null texts count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, exact_dedup, langid, near_copies, packing
from quarry.llm.common import fresh_dir
from quarry.llm.queries import table, tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; those without a letter, or of no clear language, go."""
    return langid.keep_identified(docs, langid.learned(docs, unclear=True))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) the document of the least id stays."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, in full sequences; a worker keeps fewer words than op5's, as it has served other stages."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=1, kept_words=400_000)


STAGES = [
    ("language ID", identify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Learned models, walks and tokenizers can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents; each stage's output is written as Parquet to the shared folder and read again, so no stage is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        place = fresh_dir(spark, f"stage-{n}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs

"""From documents to packed training sequences, one operator after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, linededup, neardup, packing, queries
from tidemark.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of documents that go are broadcast up to so many; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the corpus labels; the rejected go."""
    model = langid.train(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    return langid.identify(docs, model).filter("not lang_rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their duplicate lines; those of which no line with a word is left go."""
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS))
    some = F.regexp_replace("text", "[\\x00-\\x20]+", "") != ""
    left = cleaned.filter((F.col("n_dropped") == 0) | some)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id."""
    gone = materialize(neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without(docs, decontam.contained(docs, queries.read(spark, sf_dir, "benchmark"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences, with their ids."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("clean_of_benchmark", clean_of_benchmark), ("packing", packed)]
#: Stages train models and pack by arrival, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents.

Language ID drops documents without letters or without a clear language; near-dedup keeps one document
of each group; substring dedup takes repeated passages out of texts; decontamination drops documents
that hold benchmark items; mixing picks documents by target weights.  All but the last stage return the
columns of ``documents`` and no others; the last adds ``copies``.

A row with a null ``doc_id`` is judged by its text like any other, but never stands in for a group of
near duplicates and never is one of it.  A null or empty text, having no language, goes in the first
stage.  Of rows with equal ids near-dedup keeps one.  A null lang or source is a leaf of its own in the
mixture.  A text of any length is judged whole.  Of a tie in the mixture's order as much stays as fits.
An empty table gives none.

Each stage bounds the bytes of the session's Arrow batches, as executors keep the memory of earlier stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B
from hindcast.llm import decontamination, language_id, mixing, near_dedup, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLEAR = 0.3  # least share of a document's words in its main language


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language."""
    B.bound_batches(spark)
    found = language_id.identified(docs.select(*COLUMNS), language_id.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= CLEAR)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    B.bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand in an earlier one; a document of nothing else goes."""
    B.bound_batches(spark)
    out = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    return out.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    B.bound_batches(spark)
    return decontamination.drop_leaks(docs.select(*COLUMNS), B.read(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents picked by target weights, with the number of epochs each is in."""
    B.bound_batches(spark)
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # SQL has no language model, signatures or alignment; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    shared = B.Shared(spark, "pipeline")
    docs = B.read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = shared.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

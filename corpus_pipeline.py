"""Corpus preparation from end to end: each stage is one training-data operator.

``run(spark, sf_dir)`` applies STAGES to the documents table. Every stage works
on all that its predecessor kept; the result of each is written as Parquet to
the shared folder and read again as the next one's documents.

All stages take documents of any further columns, whatever their names, and
return them as they are; null and empty texts, repeated rows, very long texts
and empty tables have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from locusframe.llm.common import named, stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Equal texts share their fate; null and empty texts, which no word tells
    of, stay. Without labels everything stays.
    """
    score = unused(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*map(named, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with one line of each group of similar lines, and n_chars of those that lost any.

    Documents of which no word is left go, so of equal texts the first stays;
    null, empty and blank texts lose nothing and stay as they are.
    """
    removed = unused(docs, "n_removed")
    found = line_dedup.dedup_lines(docs, every=True, removed=removed)
    lost = F.col(removed) > 0
    kept = found.where(~lost | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(lost, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*map(named, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; null and empty texts are like no other."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark; null and empty texts hold none."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global shuffle; a null source is one of its own."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL has neither the trained classifier nor the signatures of the middle stages; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs

"""Queries of the training-data operators, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, html_blocks, language_crf, line_dedup, log_bilinear, merkle, mixing, near_dedup, personal_data, toxicity, warc, whitening
from .common import table


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.predict(docs, language_crf.fit(docs))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages"))


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score_texts(table(spark, sf_dir, "documents"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("rate")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), every=True).select("doc_id", "n_removed", "text")


def op11_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.report(docs, personal_data.fit(docs))


def op12_merkle_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_segments, op2_toxicity_nnpu, op3_distribution_divergence, op4_benchmark_decontamination, op5_language_crf, op6_dart_minhash, op7_html_blocks, op8_log_bilinear, op9_poisson_mixing, op10_fuzzy_lines, op11_semi_markov_pii, op12_merkle_superblocks, op13_chan_whitening]
    return {f.__name__: f for f in found}


def _base32_sql(hexed: str) -> str:
    """Base32 of a SHA-1 in hexadecimal: five digits are four characters."""
    parts = []
    for i in range(8):
        bits = f"('0x' || substr({hexed}, {5 * i + 1}, 5))::BIGINT"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({bits}) >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


WARC_SQL = f"""
WITH found AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, payload_bytes, max(page_id) AS first_id FROM found GROUP BY ALL)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32_sql("f.h")} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM found f JOIN first USING (h, payload_bytes)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_segments": WARC_SQL, "op9_poisson_mixing": mixing.mix_sql(), "op12_merkle_superblocks": merkle.audit_sql()}

"""Queries on statistics between groups and on result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import result_tables as tables
from ..operators import statistics as stats
from ..sources.tables import read, samples
from .common import SAMPLES, rounded

A, B = "BUILDING", "MACHINERY"
STATUSES = ["F", "O", "P"]


def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ks_distance(samples(spark, d), A, B))


def intraclass_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.intraclass_correlation(samples(spark, d)))


def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.welch_t(samples(spark, d), A, B))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").substr(1, 7).alias("grp"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return rounded(stats.spearman(lines))


def holm(spark: SparkSession, d: str) -> DataFrame:
    tests = read(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") / 5000.0).alias("p"))
    return rounded(stats.holm(tests))


def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    shares = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("k"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return rounded(shares.select("event_type", "n", "k", low.alias("low"), high.alias("high")))


def freedman_diaconis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.freedman_diaconis(samples(spark, d)))


def compare_two_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.two_level(samples(spark, d)))


def agreement_ari(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.rand_index(read(spark, d, "part").select((F.col("p_size") / 10).cast("int").alias("a"), F.col("p_brand").alias("b"))))


def key_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return rounded(tables.upsert(orders, new, ["o_orderkey"]), 4)


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicates(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


def wide_view(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.wide(read(spark, d, "orders"), "o_custkey", "o_orderstatus", STATUSES, "o_totalprice"), 2)


def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", tables.cell_text(F.col("text")).alias("cell"))


def params_json(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return tables.fingerprint(read(spark, d, "part"), "p_brand", "p_partkey")


def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Journal compaction: the last row of each key."""
    rows = read(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return rows.select("user_id", "last.event_id")


QUERIES = {f.__name__: f for f in (ks_two_sample, intraclass_correlation, welch_t, spearman, holm, wilson_interval, freedman_diaconis, compare_two_level, agreement_ari, key_upsert, duplicate_rows, wide_view, cell_texts, params_json, fingerprints, latest_by_key)}

_Z = 1.959963984540054
_ICC = """per AS (SELECT grp, animal, count(*) AS n, avg(value) AS m, sum(value * value) AS q FROM samples GROUP BY ALL),
top AS (SELECT grp, count(*) AS k, sum(n) AS total, sum(n * n) AS n2, sum(q - n * m * m) AS within, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS between_ FROM per GROUP BY grp),
ms AS (SELECT grp, (total - n2 / total) / (k - 1) AS n0, between_ / (k - 1) AS b, within / (total - k) AS w FROM top WHERE k >= 2 AND total > k)"""
_RANK = "rank() OVER (PARTITION BY grp ORDER BY {0}) + (count(*) OVER (PARTITION BY grp, {0}) - 1) / 2.0"
ORACLES = {
    "ks_two_sample": f"WITH {SAMPLES}, c AS (SELECT value, count(*) FILTER (WHERE grp = '{A}') AS na, count(*) FILTER (WHERE grp = '{B}') AS nb FROM samples WHERE grp IN ('{A}', '{B}') GROUP BY value), f AS (SELECT sum(na) OVER (ORDER BY value) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY value) / sum(nb) OVER () AS fb FROM c) SELECT round(max(abs(fa - fb)), 6) AS ks FROM f",
    "intraclass_correlation": f"WITH {SAMPLES}, {_ICC} SELECT grp, CASE WHEN w > 0 THEN round(greatest(0, (b - w) / n0) / (greatest(0, (b - w) / n0) + w), 6) END AS icc FROM ms",
    "welch_t": f"WITH {SAMPLES}, one AS (SELECT avg(value) FILTER (grp = '{A}') AS ma, avg(value) FILTER (grp = '{B}') AS mb, var_samp(value) FILTER (grp = '{A}') / count(*) FILTER (grp = '{A}') AS va, var_samp(value) FILTER (grp = '{B}') / count(*) FILTER (grp = '{B}') AS vb, count(*) FILTER (grp = '{A}') AS na, count(*) FILTER (grp = '{B}') AS nb FROM samples) SELECT round((ma - mb) / sqrt(va + vb), 6) AS t, round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 6) AS df FROM one",
    "spearman": f"WITH l AS (SELECT strftime(l_shipdate, '%Y-%m') AS grp, l_quantity AS a, l_discount AS b FROM lineitem), r AS (SELECT grp, {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM l) SELECT grp, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY grp HAVING count(*) >= 4",
    "holm": "WITH s AS (SELECT p_partkey AS name, p_size / 5000.0::DOUBLE AS p, row_number() OVER (ORDER BY p_size / 5000.0::DOUBLE, p_partkey) AS k, count(*) OVER () AS m FROM part) SELECT name, round(p, 6) AS p, round(least(1.0, max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s",
    "wilson_interval": f"WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY 1), p AS (SELECT *, k::DOUBLE / n AS p FROM s) SELECT event_type, n, k, round((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n), 6) AS low, round((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n), 6) AS high FROM p",
    "freedman_diaconis": f"WITH {SAMPLES} SELECT grp, round(2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1 / 3), 6) AS width FROM samples GROUP BY grp",
    "compare_two_level": f"WITH {SAMPLES}, a AS (SELECT grp, animal, avg(value) AS m, count(*) AS axons FROM samples GROUP BY ALL) SELECT grp, count(*) AS animals, sum(axons)::BIGINT AS axons, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(quantile_cont(m, 0.5), 6) AS median FROM a GROUP BY grp",
    "agreement_ari": "WITH l AS (SELECT p_size // 10 AS a, p_brand AS b FROM part), t AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT sum(n * (n - 1) / 2) AS cell, sum(n) AS total FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS rows FROM (SELECT sum(n) AS n FROM t GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS cols FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((cell - rows * cols / (total * (total - 1) / 2)) / ((rows + cols) / 2 - rows * cols / (total * (total - 1) / 2)), 6) AS ari FROM c, r, k",
    "key_upsert": "SELECT o_orderkey, o_orderstatus, round(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, 4) AS o_totalprice FROM orders",
    "duplicate_rows": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS copy FROM orders QUALIFY copy > 1",
    "wide_view": "SELECT o_custkey, " + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS {s}" for s in STATUSES) + " FROM orders GROUP BY o_custkey",
    "cell_texts": "SELECT item_id, trim(regexp_replace(replace(text, ';', ','), '[\\r\\n]+', ' ', 'g')) AS cell FROM benchmark",
    "params_json": "SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "fingerprints": "SELECT p_brand, substr(sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)), 1, 16) AS fingerprint FROM part GROUP BY p_brand",
    "latest_by_key": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}

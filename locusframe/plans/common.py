"""Rounding of results, and the SQL views that mirror the table adaptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PTS = "pts AS (SELECT p_partkey AS id, p_retailprice AS x, p_size * 10.0::DOUBLE AS y FROM part)"
SPARSE = "sup AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey * 4.0::DOUBLE AS y FROM supplier)"
SLAB = "locs AS (SELECT l_returnflag AS grp, l_orderkey * 10 + l_linenumber AS source_index, l_quantity AS x, l_discount * 1000 AS y, l_tax * 1000 AS z FROM lineitem)"
MOVIE = "movie AS (SELECT user_id AS grp, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 60)::BIGINT AS frame, value AS x, event_id FROM events)"
SAMPLES = "samples AS (SELECT o_orderkey AS axon, c_custkey AS animal, c_mktsegment AS grp, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
CLUSTERED = "clus AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey % 41 - 1)::INT AS label, l_returnflag AS grp, l_quantity AS x, l_discount * 1000 AS y, l_tax * 1000 AS z, l_orderkey AS frame, l_extendedprice AS photons, l_tax * 100 AS lp, (l_linenumber - 1)::BIGINT AS step FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))

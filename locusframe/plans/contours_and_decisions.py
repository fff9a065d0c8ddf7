"""Queries on closed contours and on decisions about rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import circular, contours, decisions, regions
from ..sources.tables import read, slab_points
from .common import SLAB, rounded
from .space import CIRCLE, SQUARE
from .time_and_circle import _PEAK, _POSITIONS, _PROFILE, BINS, LENGTH, _positions, _profile

SAMPLES, BIN, REACH, MODES = 100, 0.5, 5.0, 8
FIELDS = ["l_returnflag", "l_linestatus", "l_partkey", "l_suppkey"]
#: Decision makers in their order of precedence.
PRECEDENCE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("bin") * (2 * math.pi / BINS)
    return contours.closed_edges(_profile(spark, d).select("grp", F.col("bin").alias("pos"), ((F.col("n") + 10) * F.cos(turn)).alias("x"), ((F.col("n") + 10) * F.sin(turn)).alias("y")))


def contour_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contours.area_and_length(_edges(spark, d)), 5)


def contour_arc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_edges(spark, d).select("grp", "pos", "arc"), 5)


def contour_samples(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contours.equal_samples(_edges(spark, d), SAMPLES), 5)


def arc_pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contours.arc_pair_correlation(_positions(spark, d), LENGTH, BIN, REACH))


def bragg_peak(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contours.bragg_peak(circular.structure_factor(_positions(spark, d), LENGTH, MODES), LENGTH), 5)


def folded_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contours.folded(circular.aligned(_profile(spark, d), BINS), BINS))


def final_flags(spark: SparkSession, d: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("method"))
    made = read(spark, d, "orders").selectExpr("o_custkey as key", "o_orderpriority as method", "o_orderstatus as flag", "o_orderdate as at", "o_orderkey as id")
    return decisions.final_flags(made.withColumn("rank", F.when(rank > 0, rank).otherwise(len(PRECEDENCE) + 1)))


def inside_split(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return decisions.four_way(slab_points(spark, d), regions.in_circle(x, y, *CIRCLE), regions.in_square(x, y, *SQUARE))


def record_differences(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", *FIELDS)
    first = lambda n: lines.where(F.col("l_linenumber") == n).dropDuplicates(["key", *FIELDS])
    return decisions.record_differences(first(1), first(2), FIELDS)


def central_ring(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return decisions.central_position(counts.selectExpr("grp", "row_number() over (partition by grp order by year) - 1 as pos", "n"))


def monte_carlo_p(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's mean size as the observed value among the sizes of its parts."""
    parts = read(spark, d, "part").selectExpr("p_brand as grp", "cast(p_size as double) as value")
    return rounded(decisions.monte_carlo_p(parts.join(parts.groupBy("grp").agg(F.avg("value").alias("observed")), "grp")))


QUERIES = {f.__name__: f for f in (contour_area, contour_arc, contour_samples, arc_pair_correlation, bragg_peak, folded_profile, final_flags, inside_split, record_differences, central_ring, monte_carlo_p)}

_EDGES = f"""{_PROFILE}, vertices AS (SELECT grp, bin AS pos, (n + 10) * cos(bin * 2 * pi() / {BINS}) AS x, (n + 10) * sin(bin * 2 * pi() / {BINS}) AS y FROM profile),
ahead AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS next_x, coalesce(lead(y) OVER w, first_value(y) OVER w) AS next_y FROM vertices WINDOW w AS (PARTITION BY grp ORDER BY pos)),
sized AS (SELECT *, sqrt(pow(next_x - x, 2) + pow(next_y - y, 2)) AS step FROM ahead),
edges AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc, sum(step) OVER (PARTITION BY grp) / {SAMPLES} AS h FROM sized)"""
_TOP = int(REACH / BIN)
_RANK = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(PRECEDENCE)) + f" ELSE {len(PRECEDENCE) + 1} END"
_TOLERANCE = "1e-12::DOUBLE * greatest(1.0, abs(observed))"
_FIELD_ROWS = " UNION ALL ".join(f"SELECT a.l_orderkey AS key, '{f}' AS field, a.{f}::VARCHAR AS a, b.{f}::VARCHAR AS b FROM one a JOIN two b USING (l_orderkey) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS)
ORACLES = {
    "contour_area": f"WITH {_EDGES} SELECT grp, round(abs(sum(x * next_y - next_x * y)) / 2, 5) AS area, round(sum(step), 5) AS length FROM edges GROUP BY grp",
    "contour_arc": f"WITH {_EDGES} SELECT grp, pos, round(arc, 5) AS arc FROM edges",
    "contour_samples": f"WITH {_EDGES} SELECT grp, k::INT AS k, round(x + (k * h - arc) / step * (next_x - x), 5) AS x, round(y + (k * h - arc) / step * (next_y - y), 5) AS y FROM edges JOIN range(0, {SAMPLES}) AS r(k) ON k >= ceil(arc / h) AND k < ceil((arc + step) / h)",
    "arc_pair_correlation": f"WITH {_POSITIONS}, apart AS (SELECT a.grp, least(abs(a.s - b.s), {LENGTH}::DOUBLE - abs(a.s - b.s)) AS d FROM positions a JOIN positions b ON a.grp = b.grp AND a.s < b.s), counts AS (SELECT grp, least(floor(d / {BIN}::DOUBLE), {_TOP - 1}) AS bin, count(*) AS pairs FROM apart WHERE d <= {REACH} GROUP BY ALL), sizes AS (SELECT grp, count(*) AS k FROM positions GROUP BY grp HAVING count(*) > 1) SELECT s.grp, r.bin::INT AS bin, round(coalesce(pairs, 0) / (k * (k - 1) / 2 * {2 * BIN / LENGTH!r}::DOUBLE), 6) AS g FROM sizes s CROSS JOIN range(0, {_TOP}) AS r(bin) LEFT JOIN counts c ON c.grp = s.grp AND c.bin = r.bin",
    "bragg_peak": f"WITH {_POSITIONS}, power AS (SELECT grp, mode::INT AS mode, round((pow(sum(cos(mode * 2 * pi() / {LENGTH} * s)), 2) + pow(sum(sin(mode * 2 * pi() / {LENGTH} * s)), 2)) / count(*), 9) AS power FROM positions, range(1, {MODES + 1}) AS m(mode) GROUP BY grp, mode) SELECT grp, mode, round(power, 5) AS power, round({LENGTH}::DOUBLE / mode, 5) AS spacing FROM power QUALIFY row_number() OVER (PARTITION BY grp ORDER BY power DESC, mode) = 1",
    "folded_profile": f"WITH {_PROFILE}, {_PEAK}, turned AS (SELECT p.grp, (p.bin - k.peak + {BINS}) % {BINS} AS bin, p.n FROM profile p JOIN peaks k USING (grp)) SELECT grp, least(bin, {BINS} - bin)::INT AS lag, round(avg(n), 6) AS mean FROM turned GROUP BY 1, 2",
    "final_flags": f"SELECT o_custkey AS key, o_orderpriority AS method, o_orderstatus AS flag FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK}, o_orderdate DESC, o_orderkey DESC) = 1",
    "inside_split": f"WITH {SLAB} SELECT grp, sqrt((x - {CIRCLE[0]}) * (x - {CIRCLE[0]}) + (y - {CIRCLE[1]}) * (y - {CIRCLE[1]})) <= {CIRCLE[2]} AS in_a, x > {SQUARE[0]} AND x < {SQUARE[2]} AND y > {SQUARE[1]} AND y < {SQUARE[3]} AS in_b, count(*) AS n FROM locs GROUP BY ALL",
    "record_differences": f"WITH one AS (SELECT DISTINCT l_orderkey, {', '.join(FIELDS)} FROM lineitem WHERE l_linenumber = 1), two AS (SELECT DISTINCT l_orderkey, {', '.join(FIELDS)} FROM lineitem WHERE l_linenumber = 2) {_FIELD_ROWS} UNION ALL SELECT l_orderkey AS key, 'key' AS field, l_orderkey::VARCHAR AS a, NULL AS b FROM one WHERE l_orderkey NOT IN (SELECT l_orderkey FROM two) UNION ALL SELECT l_orderkey, 'key', NULL, l_orderkey::VARCHAR FROM two WHERE l_orderkey NOT IN (SELECT l_orderkey FROM one)",
    "central_ring": "WITH rings AS (SELECT o_custkey AS grp, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL), placed AS (SELECT grp, n, row_number() OVER (PARTITION BY grp ORDER BY year) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM rings) SELECT grp, pos::INT AS central FROM placed WHERE pos IN ((size - 1) // 2, size // 2) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, pos) = 1",
    "monte_carlo_p": f"WITH seen AS (SELECT p_brand AS grp, p_size::DOUBLE AS value, avg(p_size) OVER (PARTITION BY p_brand) AS observed FROM part), tails AS (SELECT grp, count(*) AS n, (1.0::DOUBLE + count(*) FILTER (value >= observed - {_TOLERANCE})) / (count(*) + 1) AS p, (1.0::DOUBLE + count(*) FILTER (value <= observed + {_TOLERANCE})) / (count(*) + 1) AS low FROM seen GROUP BY grp) SELECT grp, n, round(p, 6) AS p, round(least(1.0::DOUBLE, 2 * least(p, low)), 6) AS p_two_sided FROM tails",
}

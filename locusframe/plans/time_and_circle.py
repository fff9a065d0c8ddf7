"""Queries on events over time and on profiles around a circle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import circular, events
from ..sources.tables import movie, read
from .common import MOVIE, rounded

DARK, LAST_FRAME = 60, 43_199
BINS = 31
LENGTH = 31.0


def link_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.link_sessions(movie(spark, d), DARK).select("grp", "frame", "event_id", "session")


def event_collapse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.collapse(events.link_sessions(movie(spark, d), DARK), LAST_FRAME))


def dark_times(spark: SparkSession, d: str) -> DataFrame:
    return events.dark_times(events.collapse(events.link_sessions(movie(spark, d), DARK), LAST_FRAME))


def event_lengths(spark: SparkSession, d: str) -> DataFrame:
    return events.histogram(events.collapse(events.link_sessions(movie(spark, d), DARK), LAST_FRAME), "length", 30.0)


def next_frame_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.next_frame_neighbours(movie(spark, d), 50.0))


def revisit_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.revisit_fraction(events.collapse(events.link_sessions(movie(spark, d), DARK), LAST_FRAME), 200))


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(movie(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean")))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """Localizations of each group by day of the month, every bin present: grp, bin, n."""
    lines = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).cast("string")).alias("grp"), (F.dayofmonth("l_shipdate") - 1).alias("bin"))
    counts = lines.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    grid = lines.select("grp").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    return grid.join(counts, ["grp", "bin"], "left").select("grp", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def density_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


def circular_windows(spark: SparkSession, d: str) -> DataFrame:
    return circular.circular_windows(_profile(spark, d), BINS, 5)


def peak_bins(spark: SparkSession, d: str) -> DataFrame:
    return circular.peak_bin(_profile(spark, d), BINS)


def aligned_profile(spark: SparkSession, d: str) -> DataFrame:
    return circular.aligned(_profile(spark, d), BINS).groupBy("bin").agg(F.sum("n").alias("n"))


def circular_runs(spark: SparkSession, d: str) -> DataFrame:
    mean = _profile(spark, d).selectExpr("grp", "bin", "n > avg(n) over (partition by grp) as filled")
    return circular.circular_runs(mean, BINS)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_brand", (F.col("p_retailprice") % LENGTH).alias("s")).select(F.col("p_brand").alias("grp"), F.round("s", 4).alias("s")).distinct()


def arc_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(circular.arc_gaps(_positions(spark, d), LENGTH))


def gap_regularity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(circular.gap_regularity(circular.arc_gaps(_positions(spark, d), LENGTH)))


def structure_factor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(circular.structure_factor(_positions(spark, d), LENGTH, 8), 5)


def rotation_correlation(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d)
    return rounded(circular.rotation_correlation(p.select("grp", "bin", F.col("n").cast("double").alias("a"), F.col("n").cast("double").alias("b")), BINS), 4)


QUERIES = {f.__name__: f for f in (link_sessions, event_collapse, dark_times, event_lengths, next_frame_neighbours, revisit_fraction, frame_counts, density_profile, circular_windows, peak_bins, aligned_profile, circular_runs, arc_gaps, gap_regularity, structure_factor, rotation_correlation)}

_LINK = f"""{MOVIE}, gapped AS (SELECT *, frame - lag(frame) OVER (PARTITION BY grp ORDER BY frame, event_id) AS gap FROM movie),
linked AS (SELECT grp, frame, x, event_id, sum(CASE WHEN gap IS NULL OR gap > {DARK + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM gapped)"""
_EVENTS = f"""{_LINK}, collapsed AS (SELECT grp, session, min(frame) AS first, max(frame) AS last, count(*) AS n_locs, avg(x) AS x_mean, sum(x) AS x_sum,
max(frame) - min(frame) + 1 AS length, min(frame) > 0 AND max(frame) < {LAST_FRAME} AS complete FROM linked GROUP BY grp, session)"""
_PROFILE = f"""lines AS (SELECT l_returnflag || l_linestatus || (l_suppkey % 7)::VARCHAR AS grp, day(l_shipdate) - 1 AS bin FROM lineitem),
profile AS (SELECT g.grp, b.bin::INT AS bin, count(l.bin) AS n FROM (SELECT DISTINCT grp FROM lines) g CROSS JOIN range(0, {BINS}) AS b(bin) LEFT JOIN lines l ON l.grp = g.grp AND l.bin = b.bin GROUP BY ALL)"""
_POSITIONS = f"positions AS (SELECT DISTINCT p_brand AS grp, round(p_retailprice % {LENGTH}::DOUBLE, 4) AS s FROM part)"
_GAPS = f"{_POSITIONS}, gaps AS (SELECT grp, s, coalesce(lead(s) OVER (PARTITION BY grp ORDER BY s), min(s) OVER (PARTITION BY grp) + {LENGTH}) - s AS gap FROM positions)"
_PEAK = f"""three AS (SELECT p.grp, p.bin, any_value(p.n) AS n, sum(q.n)::BIGINT AS three FROM profile p JOIN profile q ON p.grp = q.grp AND q.bin IN ((p.bin + {BINS - 1}) % {BINS}, p.bin, (p.bin + 1) % {BINS}) GROUP BY p.grp, p.bin),
peaks AS (SELECT grp, bin AS peak FROM three QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, three DESC, bin) = 1)"""
ORACLES = {
    "link_sessions": f"WITH {_LINK} SELECT grp, frame, event_id, session FROM linked",
    "event_collapse": f"WITH {_EVENTS} SELECT grp, session, first, last, n_locs, round(x_mean, 6) AS x_mean, round(x_sum, 6) AS x_sum, length, complete FROM collapsed",
    "dark_times": f"WITH {_EVENTS}, run AS (SELECT grp, session, first, max(last) OVER (PARTITION BY grp ORDER BY first, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM collapsed) SELECT grp, session, CASE WHEN before < first THEN first - before ELSE -1 END AS dark FROM run",
    "event_lengths": f"WITH {_EVENTS} SELECT floor(length / 30.0)::BIGINT AS bin, count(*) AS n FROM collapsed GROUP BY 1",
    "next_frame_neighbours": f"WITH {MOVIE}, pairs AS (SELECT a.event_id, b.event_id AS other, abs(a.x - b.x) AS d FROM movie a JOIN movie b ON a.grp = b.grp AND b.frame = a.frame + 1 WHERE abs(a.x - b.x) < 50.0) SELECT event_id, other, round(d, 6) AS d FROM pairs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, other) = 1",
    "revisit_fraction": f"WITH {_EVENTS}, back AS (SELECT grp, first - lag(last) OVER (PARTITION BY grp ORDER BY first, session) AS since FROM collapsed) SELECT grp, round(avg(CASE WHEN since <= 200 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS revisit, count(*) AS n_events FROM back GROUP BY grp",
    "frame_counts": f"WITH {MOVIE} SELECT frame, count(*) AS n, round(avg(x), 6) AS x_mean FROM movie GROUP BY frame",
    "circular_runs": f"""WITH {_PROFILE}, f AS (SELECT grp, bin, n > avg(n) OVER (PARTITION BY grp) AS filled FROM profile), c AS (SELECT *, coalesce(filled <> lag(filled) OVER (PARTITION BY grp ORDER BY bin), false)::INT AS change FROM f),
r AS (SELECT grp, bin, filled, sum(change) OVER (PARTITION BY grp ORDER BY bin) AS run, sum(change) OVER (PARTITION BY grp) AS runs, first_value(filled) OVER w = last_value(filled) OVER w AS closed FROM c WINDOW w AS (PARTITION BY grp ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT grp, filled, count(*) AS run_length FROM r GROUP BY grp, filled, CASE WHEN closed AND run = runs THEN 0 ELSE run END""",
    "density_profile": f"WITH {_PROFILE} SELECT grp, bin, n FROM profile",
    "circular_windows": f"WITH {_PROFILE} SELECT p.grp, p.bin, sum(q.n)::BIGINT AS n FROM profile p JOIN profile q ON p.grp = q.grp AND (q.bin - p.bin + {BINS}) % {BINS} < 5 GROUP BY p.grp, p.bin",
    "peak_bins": f"WITH {_PROFILE}, {_PEAK} SELECT grp, peak FROM peaks",
    "aligned_profile": f"WITH {_PROFILE}, {_PEAK} SELECT (p.bin - k.peak + {BINS}) % {BINS} AS bin, sum(p.n)::BIGINT AS n FROM profile p JOIN peaks k USING (grp) GROUP BY 1",
    "arc_gaps": f"WITH {_GAPS} SELECT grp, s, round(gap, 6) AS gap FROM gaps",
    "gap_regularity": f"WITH {_GAPS}, dev AS (SELECT *, gap - avg(gap) OVER (PARTITION BY grp) AS dev FROM gaps), nxt AS (SELECT *, coalesce(lead(dev) OVER (PARTITION BY grp ORDER BY s), first_value(dev) OVER (PARTITION BY grp ORDER BY s)) AS next_dev FROM dev) SELECT grp, count(*) AS n, CASE WHEN count(*) > 1 THEN round(stddev_pop(gap) / avg(gap), 6) END AS cv, CASE WHEN count(*) > 2 THEN round(sum(dev * next_dev) / nullif(sum(dev * dev), 0), 6) END AS rho1 FROM nxt GROUP BY grp",
    "structure_factor": f"WITH {_POSITIONS} SELECT grp, mode::INT AS mode, round((pow(sum(cos(mode * 2 * pi() / {LENGTH} * s)), 2) + pow(sum(sin(mode * 2 * pi() / {LENGTH} * s)), 2)) / count(*), 5) AS power FROM positions, range(1, 9) AS m(mode) GROUP BY grp, mode",
    "rotation_correlation": f"WITH {_PROFILE}, z AS (SELECT grp, bin, n - avg(n) OVER (PARTITION BY grp) AS v FROM profile) SELECT a.grp, ((b.bin - a.bin + {BINS}) % {BINS})::INT AS shift, round(sum(a.v * b.v), 4) AS corr FROM z a JOIN z b USING (grp) GROUP BY 1, 2",
}

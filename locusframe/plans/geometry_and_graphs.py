"""Queries on regions with depth, registration, graphs, densities and correlations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, paint
from ..sources.tables import clustered_points, plane_points, slab_points
from .common import CLUSTERED, PTS, SLAB, rounded
from .contours_and_decisions import _EDGES, _edges
from .space import _D, _NEAR, CIRCLE, POLYGON, RADIUS, SQUARE, _edge
from .space import _edges as _SIDES
from .space import _inside
from .time_and_circle import _POSITIONS, _PROFILE, LENGTH, _positions, _profile

CONVEX = [(10.0, 5.0), (40.0, 15.5), (45.0, 70.5), (20.0, 90.5), (5.5, 50.0)]
K, BANDWIDTH = 4, 6.0
RADII = [0.5, 1.0, 2.5]
LOW, HIGH, STEP = 60.0, 200.0, 20.0


def in_convex(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(geometry.in_convex(F.col("x"), F.col("y"), CONVEX)).groupBy("grp").agg(F.count("*").alias("n"))


def region_depths(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    depths = {"circle": geometry.depth_in_circle(x, y, *CIRCLE), "square": geometry.depth_in_square(x, y, *SQUARE), "polygon": geometry.depth_in_polygon(x, y, POLYGON)}
    return rounded(slab_points(spark, d).groupBy("x", "y").agg(F.count("*").alias("n")).select("x", "y", "n", *(c.alias(k) for k, c in depths.items())))


def contour_centres(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.contour_centres(_edges(spark, d)), 5)


def contour_steps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_edges(spark, d).select("grp", "pos", "step"), 5)


def registration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.registration(clustered_points(spark, d).select(F.col("label").alias("grp"), (F.col("x") - 20).alias("dx"), (F.col("y") / 2).alias("dy"))), 5)


def neighbour_degrees(spark: SparkSession, d: str) -> DataFrame:
    return geometry.degree_histogram(geometry.neighbour_graph(plane_points(spark, d), K, RADIUS))


def knn_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.knn_density(plane_points(spark, d), K, RADIUS), 9)


def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.kernel_density(plane_points(spark, d), BANDWIDTH), 9)


def ripley_arc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.ripley_arc(_positions(spark, d), LENGTH, RADII))


def partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.partial_spearman(clustered_points(spark, d).select(F.col("label").alias("grp"), F.col("x").alias("a"), F.col("photons").alias("b"), F.col("y").alias("c"))))


def profile_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.autocorrelation(_profile(spark, d)))


def period_amplitudes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.period_amplitude(geometry.autocorrelation(_profile(spark, d)), LOW, HIGH, STEP))


def registered_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channel B moved by the offset of each group, and the seconds of its frames."""
    points = clustered_points(spark, d)
    moved = points.join(geometry.registration(points.select("grp", (F.col("x") / 10).alias("dx"), (F.col("y") / 10).alias("dy"))), "grp")
    return rounded(moved.groupBy("grp").agg(F.avg(F.col("x") + F.col("dx")).alias("x"), F.avg(F.col("y") + F.col("dy")).alias("y"), F.max(paint.seconds(F.col("frame"), 0.05)).alias("seconds")), 5)


QUERIES = {f.__name__: f for f in (in_convex, region_depths, contour_centres, contour_steps, registration, neighbour_degrees, knn_density, kernel_density, ripley_arc, partial_spearman, profile_autocorrelation, period_amplitudes, registered_channels)}

_CORNERS = list(zip(CONVEX, [*CONVEX[1:], CONVEX[0]], strict=True))
_LEFT = " AND ".join(f"{bx - ax} * (y - {ay}) - {by - ay} * (x - {ax}) >= 0" for (ax, ay), (bx, by) in _CORNERS)
_RANK = "rank() OVER (PARTITION BY label ORDER BY {0}) + (count(*) OVER (PARTITION BY label, {0}) - 1) / 2.0::DOUBLE"
_X0, _Y0, _X1, _Y1 = SQUARE
_AUTO = f"{_PROFILE}, z AS (SELECT grp, bin, n - avg(n) OVER (PARTITION BY grp) AS z FROM profile), w AS (SELECT grp, sum(z * z) AS w FROM z GROUP BY grp HAVING sum(z * z) > 0), auto AS (SELECT a.grp, b.bin - a.bin AS lag, sum(a.z * b.z) / any_value(w) AS r FROM z a JOIN z b ON a.grp = b.grp AND b.bin >= a.bin JOIN w ON w.grp = a.grp GROUP BY ALL)"
ORACLES = {
    "in_convex": f"WITH {SLAB} SELECT grp, count(*) AS n FROM locs WHERE {_LEFT} GROUP BY grp",
    "region_depths": f"""WITH {SLAB}, p AS (SELECT x, y, count(*) AS n FROM locs GROUP BY ALL) SELECT x, y, n, round({CIRCLE[2]} - sqrt((x - {CIRCLE[0]}) * (x - {CIRCLE[0]}) + (y - {CIRCLE[1]}) * (y - {CIRCLE[1]})), 6) AS circle,
round(CASE WHEN x BETWEEN {_X0} AND {_X1} AND y BETWEEN {_Y0} AND {_Y1} THEN least(x - {_X0}, {_X1} - x, y - {_Y0}, {_Y1} - y) ELSE -sqrt(pow(greatest({_X0} - x, 0, x - {_X1}), 2) + pow(greatest({_Y0} - y, 0, y - {_Y1}), 2)) END, 6) AS square,
round(CASE WHEN ({_inside}) % 2 = 1 THEN 1 ELSE -1 END * least({', '.join(_edge(*e) for e in _SIDES)}), 6) AS polygon FROM p""",
    "contour_centres": f"WITH {_EDGES} SELECT grp, round(sum((x + next_x) * (x * next_y - next_x * y)) / (3 * sum(x * next_y - next_x * y)), 5) AS cx, round(sum((y + next_y) * (x * next_y - next_x * y)) / (3 * sum(x * next_y - next_x * y)), 5) AS cy FROM edges GROUP BY grp",
    "contour_steps": f"WITH {_EDGES} SELECT grp, pos, round(step, 5) AS step FROM edges",
    "registration": f"WITH {CLUSTERED}, p AS (SELECT label AS grp, x - 20 AS dx, y / 2 AS dy FROM clus), m AS (SELECT grp, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy FROM p GROUP BY grp) SELECT grp, any_value(n) AS n, round(avg(dx), 5) AS dx, round(avg(dy), 5) AS dy, CASE WHEN any_value(n) >= 3 THEN round(sqrt(avg(pow(dx - (sx - dx) / (n - 1), 2) + pow(dy - (sy - dy) / (n - 1), 2))), 5) END AS error FROM p JOIN m USING (grp) GROUP BY grp",
    "neighbour_degrees": f"WITH {PTS}, {_NEAR}, g AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM near WHERE rank <= {K}), e AS (SELECT a AS id FROM g UNION ALL SELECT b FROM g), c AS (SELECT id, count(*) AS degree FROM e GROUP BY id) SELECT degree, count(*) AS n FROM c GROUP BY degree",
    "knn_density": f"WITH {PTS}, {_NEAR}, f AS (SELECT id, max(d) AS r FROM near WHERE rank <= {K} GROUP BY id) SELECT id, round({K} / ({math.pi!r} * pow(CASE WHEN r > 0 THEN r ELSE (SELECT min(r) FROM f WHERE r > 0) END, 2)), 9) AS density FROM f",
    "kernel_density": f"WITH {PTS} SELECT a.id, round(sum(exp(-0.5 * pow({_D} / {BANDWIDTH}, 2))) / {2 * math.pi * BANDWIDTH * BANDWIDTH!r}, 9) AS density FROM pts a JOIN pts b ON {_D} <= {BANDWIDTH * 3} GROUP BY a.id",
    "ripley_arc": f"WITH {_POSITIONS}, q AS (SELECT grp, s, row_number() OVER (PARTITION BY grp ORDER BY s) AS id, count(*) OVER (PARTITION BY grp) AS n FROM positions), p AS (SELECT a.grp, least(abs(a.s - b.s), {LENGTH} - abs(a.s - b.s)) AS d FROM q a JOIN q b ON a.grp = b.grp AND a.id <> b.id), r AS (SELECT unnest({RADII})::DOUBLE AS r), k AS (SELECT g.grp, r, any_value(n) AS n, {LENGTH} / (any_value(n) * (any_value(n) - 1)) * (SELECT count(*) FROM p WHERE p.grp = g.grp AND d <= r + {1e-9 * LENGTH!r}) AS k FROM q g, r WHERE n > 1 GROUP BY g.grp, r) SELECT grp, r, n, round(k, 6) AS k, round(k - 2 * r, 6) AS h FROM k",
    "partial_spearman": f"WITH {CLUSTERED}, q AS (SELECT label AS grp, {_RANK.format('x')} AS a, {_RANK.format('photons')} AS b, {_RANK.format('y')} AS c FROM clus), o AS (SELECT grp, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM q GROUP BY grp) SELECT grp, n, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho FROM o WHERE n >= 5",
    "profile_autocorrelation": f"WITH {_AUTO} SELECT grp, lag, round(r, 6) AS r FROM auto",
    "period_amplitudes": f"WITH {_AUTO}, v AS (SELECT *, lag(r) OVER (PARTITION BY grp ORDER BY lag) AS b, lead(r) OVER (PARTITION BY grp ORDER BY lag) AS a FROM auto), t AS (SELECT grp, arg_max(lag, (r, -lag)) AS pos, max(r) AS peak FROM v WHERE lag * {STEP} BETWEEN {LOW} AND {HIGH} AND lag > 0 AND r > b AND r > a GROUP BY grp) SELECT grp, round(pos * {STEP}, 6) AS period, round(peak - (min(r) FILTER (WHERE lag < pos) + min(r) FILTER (WHERE lag > pos AND lag <= 2 * pos)) / 2, 6) AS amplitude FROM auto JOIN t USING (grp) GROUP BY grp, pos, peak HAVING count(*) FILTER (WHERE lag > pos AND lag <= 2 * pos) > 0",
    "registered_channels": f"WITH {CLUSTERED}, m AS (SELECT grp, avg(x / 10) AS dx, avg(y / 10) AS dy FROM clus GROUP BY grp) SELECT grp, round(avg(x + dx), 5) AS x, round(avg(y + dy), 5) AS y, round(max(frame * 0.05::DOUBLE), 5) AS seconds FROM clus JOIN m USING (grp) GROUP BY grp",
}

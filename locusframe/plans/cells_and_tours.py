"""Queries on Voronoi cells, closed contours and drift in the plane."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, tessellation, tours
from ..sources.tables import clustered_points, read, sparse_points
from .common import CLUSTERED, rounded

#: Window of the sparse points, places that a tile should hold, and the density and size from which cells are a cluster.
WINDOW, IN_TILE, FACTOR, LEAST = (-10.0, -2.0, 100.0, 98.0), 200, 2.0, 3
#: Segments of the movie, the side of a bin, and the reach in bins.
SEGMENTS, BIN, REACH = 12, 5.0, 4


def _tile(points: DataFrame) -> float:
    """The side of a tile, by the number of points in the window."""
    x0, y0, x1, y1 = WINDOW
    return math.sqrt((x1 - x0) * (y1 - y0) * IN_TILE / max(points.count(), 1))


def voronoi_cells(spark: SparkSession, d: str) -> DataFrame:
    points = sparse_points(spark, d)
    cells = tessellation.voronoi_cells(points, WINDOW, _tile(points))
    return rounded(tessellation.cell_densities(cells, 0))


def voronoi_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = sparse_points(spark, d)
    return tessellation.voronoi_clusters(points, WINDOW, _tile(points), FACTOR, LEAST)


def contour_tours(spark: SparkSession, d: str) -> DataFrame:
    """The shortest closed contour through the lines of each order; rows of one line are a node at their mean."""
    nodes = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("id")).agg(F.avg("l_quantity").alias("x"), F.avg(F.col("l_discount") * 1000).alias("y"))
    return rounded(tours.contour_tours(nodes).select("grp", F.size("path").cast("long").alias("n"), "length"))


def plane_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Lags of segments against all others, and the shifts they tell of."""
    bins = drift.plane_bins(clustered_points(spark, d), SEGMENTS, BIN)
    return rounded(drift.plane_shifts(bins, BIN, BIN * REACH))


def drift_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift.drift_curve(clustered_points(spark, d), SEGMENTS, BIN, BIN * REACH))


QUERIES = {f.__name__: f for f in (voronoi_cells, voronoi_clusters, contour_tours, plane_shifts, drift_curve)}

ORACLES = {
    "plane_shifts": f"""WITH {CLUSTERED}, e AS (SELECT grp, min(frame) AS f0, max(frame) AS f1, min(x) AS x0, min(y) AS y0 FROM clus GROUP BY grp),
b AS (SELECT grp, least(floor((frame - f0) * {float(SEGMENTS)} / (f1 + 1 - f0)), {SEGMENTS - 1})::INT AS segment, floor((x - x0) / {BIN})::BIGINT AS bx, floor((y - y0) / {BIN})::BIGINT AS by, count(*) AS n FROM clus JOIN e USING (grp) GROUP BY ALL),
s AS (SELECT a.grp, a.segment, o.bx - a.bx AS i, o.by - a.by AS j, sum(CASE WHEN o.segment <> a.segment THEN a.n * o.n ELSE 0 END)::BIGINT AS v
    FROM b a JOIN b o ON o.grp = a.grp AND abs(o.bx - a.bx) <= {REACH} AND abs(o.by - a.by) <= {REACH} GROUP BY ALL),
p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, segment ORDER BY v DESC, i * i + j * j, i, j) = 1),
t AS (SELECT grp, segment, p.i, p.j, p.v, coalesce(max(CASE WHEN s.i = p.i - 1 AND s.j = p.j THEN s.v END), 0) AS x1, coalesce(max(CASE WHEN s.i = p.i + 1 AND s.j = p.j THEN s.v END), 0) AS x2,
    coalesce(max(CASE WHEN s.i = p.i AND s.j = p.j - 1 THEN s.v END), 0) AS y1, coalesce(max(CASE WHEN s.i = p.i AND s.j = p.j + 1 THEN s.v END), 0) AS y2 FROM p JOIN s USING (grp, segment) GROUP BY ALL),
z AS (SELECT grp, segment, sum(n)::BIGINT AS n FROM b GROUP BY ALL HAVING sum(n) >= {drift.LEAST_ROWS})
SELECT grp, segment, n, i AS lag_x, j AS lag_y, round(-(i + CASE WHEN x1 + x2 < 2 * v THEN (x1 - x2) / (2.0::DOUBLE * (x1 + x2 - 2 * v)) ELSE 0 END) * {BIN}, 6) AS dx,
    round(-(j + CASE WHEN y1 + y2 < 2 * v THEN (y1 - y2) / (2.0::DOUBLE * (y1 + y2 - 2 * v)) ELSE 0 END) * {BIN}, 6) AS dy FROM t JOIN z USING (grp, segment)""",
    "contour_tours": """WITH RECURSIVE p AS (SELECT l_orderkey AS grp, l_linenumber AS id, avg(l_quantity) AS x, avg(l_discount * 1000) AS y FROM lineitem GROUP BY ALL), s AS (SELECT grp, count(*) AS n, min(id) AS id FROM p GROUP BY grp HAVING count(*) >= 3),
walk AS (SELECT grp, n, p.x AS x0, p.y AS y0, p.x, p.y, [id] AS seen, 0.0::DOUBLE AS length FROM s JOIN p USING (grp, id)
    UNION ALL SELECT w.grp, n, x0, y0, p.x, p.y, list_append(seen, p.id), length + sqrt(pow(p.x - w.x, 2) + pow(p.y - w.y, 2)) FROM walk w JOIN p ON p.grp = w.grp AND NOT list_contains(seen, p.id))
SELECT grp, n, round(min(length + sqrt(pow(x - x0, 2) + pow(y - y0, 2))), 6) AS length FROM walk WHERE len(seen) = n GROUP BY ALL""",
}

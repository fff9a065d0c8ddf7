"""Queries on points in space: regions, neighbours, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, neighbours, regions
from ..sources.tables import plane_points, slab_points
from .common import PTS, SLAB, rounded

CIRCLE = (25.0, 50.0, 20.0)
SQUARE = (10.0, 20.0, 40.0, 80.0)
#: A concave region.
POLYGON = [(5.0, 5.0), (45.5, 5.0), (45.5, 45.5), (25.5, 45.5), (25.5, 85.5), (5.0, 85.5)]
SLAB_AT = (40.0, 20.0)
RADIUS, MIN_POINTS = 12.0, 4
#: Clusters of a density that splits the points.
EPS, DENSE = 8.0, 8


def load_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slab_points(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.stddev_samp("z").alias("z_sd")))


def roi_circle(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(regions.in_circle(F.col("x"), F.col("y"), *CIRCLE)).select("grp", "source_index")


def roi_square(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(regions.in_square(F.col("x"), F.col("y"), *SQUARE)).select("grp", "source_index")


def roi_polygon(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(regions.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("grp", "source_index")


def roi_edge_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slab_points(spark, d).select("source_index", regions.edge_distance(F.col("x"), F.col("y"), POLYGON).alias("edge")))


def slab_filter(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(regions.slab(F.col("z"), *SLAB_AT)).groupBy("grp").agg(F.count("*").alias("n"))


def axial_cut(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).where(regions.axial_cut(F.col("z"), 20.0, 60.0)).groupBy("grp").agg(F.count("*").alias("n"))


def precision_plausible(spark: SparkSession, d: str) -> DataFrame:
    return regions.plausible(slab_points(spark, d), "y", 0.5).groupBy("grp").agg(F.count("*").alias("n"))


def neighbour_count(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_counts(plane_points(spark, d), RADIUS)


def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = plane_points(spark, d)
    return rounded(neighbours.radius_pairs(p, p, RADIUS).where("a < b"))


def knn_3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.nearest(plane_points(spark, d), 3, RADIUS))


def mutual_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.mutual(neighbours.nearest(plane_points(spark, d), 1, RADIUS)))


def k_distance(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(plane_points(spark, d), MIN_POINTS - 1, RADIUS).where(F.col("rank") == MIN_POINTS - 1)
    q = lambda p: F.percentile("d", F.lit(p))
    return rounded(found.agg(q(0.5).alias("median"), q(0.9).alias("eps"), F.max("d").alias("largest")))


def dbscan_core_flags(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_counts(plane_points(spark, d), RADIUS).select("id", (F.col("n") >= MIN_POINTS).alias("core"))


def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return clusters.dbscan(plane_points(spark, d), EPS, DENSE)


def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    return clusters.single_linkage(plane_points(spark, d), RADIUS / 2, 3)


def focal(spark: SparkSession, d: str) -> DataFrame:
    return clusters.focal(plane_points(spark, d), 10.0, 10, 3)


def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    points = plane_points(spark, d)
    return rounded(clusters.centroids(points.join(clusters.dbscan(points, EPS, DENSE), "id")))


def ripley_k(spark: SparkSession, d: str) -> DataFrame:
    """Counts of ordered pairs within each of a few radii, scaled by area and pairs."""
    p = plane_points(spark, d)
    spots = neighbours.places(p)
    # All pairs of the points of two places; those of one place less each point with itself.
    pairs = neighbours.radius_pairs(spots, spots, 20.0, ("n",)).join(spots.select(F.col("id").alias("a"), F.col("n").alias("m")), "a")
    pairs = pairs.withColumn("many", F.col("m") * F.when(F.col("a") == F.col("b"), F.col("n") - 1).otherwise(F.col("n"))).where("many > 0")
    size = p.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    radii = F.explode(F.array(*(F.lit(r) for r in (5.0, 10.0, 20.0))))
    counts = pairs.withColumn("r", radii).where("d <= r").groupBy("r").agg(F.sum("many").alias("pairs"))
    return rounded(counts.join(F.broadcast(size)).select("r", (F.col("area") / (F.col("n") * (F.col("n") - 1)) * F.col("pairs")).alias("k")))


QUERIES = {f.__name__: f for f in (load_points, roi_circle, roi_square, roi_polygon, roi_edge_distance, slab_filter, axial_cut, precision_plausible, neighbour_count, radius_pairs, knn_3, mutual_neighbours, k_distance, dbscan_core_flags, dbscan, single_linkage, focal, cluster_centroids, ripley_k)}

_edges = regions.edges(POLYGON)
_inside = " + ".join(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx - ax}) * (y - {ay}) / ({by - ay}) + {ax} THEN 1 ELSE 0 END" for ax, ay, bx, by in _edges if ay != by)


def _edge(ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = f"least(1.0, greatest(0.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}))"
    return f"sqrt(pow(x - ({ax} + {t} * {dx}), 2) + pow(y - ({ay} + {t} * {dy}), 2))"


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, {_D} AS d FROM pts a JOIN pts b ON a.x BETWEEN b.x - {RADIUS} AND b.x + {RADIUS} AND a.y BETWEEN b.y - {RADIUS} AND b.y + {RADIUS} AND {_D} <= {RADIUS})"
_NEAR = f"near AS (SELECT a.id, b.id AS other, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rank FROM pts a JOIN pts b ON a.id <> b.id)"
_NEAR_EPS = _PAIRS.replace(str(RADIUS), str(EPS))
_DBSCAN = f"""{PTS}, {_NEAR_EPS}, core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {DENSE}), steps AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core) AND a <> b),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT s.b, r.root FROM reach r JOIN steps s ON s.a = r.id), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), labelled AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
border AS (SELECT a AS id, min(label) AS label FROM pairs JOIN labelled ON b = id WHERE a NOT IN (SELECT id FROM core) GROUP BY a), dbscan AS (SELECT p.id, p.x, p.y, l.id IS NOT NULL AS core, coalesce(l.label, b.label, -1)::INT AS label FROM pts p LEFT JOIN labelled l ON l.id = p.id LEFT JOIN border b ON b.id = p.id)"""
_LINKAGE = f"""{PTS}, {_PAIRS.replace(str(RADIUS), str(RADIUS / 2))}, reach(id, root) AS (SELECT id, id FROM pts UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
large AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM roots GROUP BY root HAVING count(*) >= 3)"""
ORACLES = {
    "dbscan": f"WITH RECURSIVE {_DBSCAN} SELECT id, core, label FROM dbscan",
    "cluster_centroids": f"WITH RECURSIVE {_DBSCAN} SELECT label, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(sqrt(var_samp(x) + var_samp(y)), 6) AS spread FROM dbscan WHERE label >= 0 GROUP BY label",
    "single_linkage": f"WITH RECURSIVE {_LINKAGE} SELECT id, coalesce(label, -1)::INT AS label FROM roots LEFT JOIN large USING (root)",
    "load_points": f"WITH {SLAB} SELECT grp, count(*) AS n, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean, round(stddev_samp(z), 6) AS z_sd FROM locs GROUP BY grp",
    "roi_circle": f"WITH {SLAB} SELECT grp, source_index FROM locs WHERE sqrt((x - {CIRCLE[0]}) * (x - {CIRCLE[0]}) + (y - {CIRCLE[1]}) * (y - {CIRCLE[1]})) <= {CIRCLE[2]}",
    "roi_square": f"WITH {SLAB} SELECT grp, source_index FROM locs WHERE x > {SQUARE[0]} AND x < {SQUARE[2]} AND y > {SQUARE[1]} AND y < {SQUARE[3]}",
    "roi_polygon": f"WITH {SLAB} SELECT grp, source_index FROM locs WHERE ({_inside}) % 2 = 1",
    "roi_edge_distance": f"WITH {SLAB} SELECT source_index, round(least({', '.join(_edge(*e) for e in _edges)}), 6) AS edge FROM locs",
    "slab_filter": f"WITH {SLAB} SELECT grp, count(*) AS n FROM locs WHERE z BETWEEN {SLAB_AT[0] - SLAB_AT[1]} AND {SLAB_AT[0] + SLAB_AT[1]} GROUP BY grp",
    "axial_cut": f"WITH {SLAB} SELECT grp, count(*) AS n FROM locs WHERE z > 20.0 AND z < 60.0 GROUP BY grp",
    "precision_plausible": f"WITH {SLAB} SELECT grp, count(*) AS n FROM locs WHERE y > 0 AND y >= 0.5::DOUBLE * (SELECT quantile_cont(y, 0.5) FROM locs WHERE y > 0) GROUP BY grp",
    "neighbour_count": f"WITH {PTS}, {_PAIRS} SELECT a AS id, count(*) AS n FROM pairs GROUP BY a",
    "radius_pairs": f"WITH {PTS}, {_PAIRS} SELECT a, b, round(d, 6) AS d FROM pairs WHERE a < b",
    "knn_3": f"WITH {PTS}, {_NEAR} SELECT id, rank::INT AS rank, other, round(d, 6) AS d FROM near WHERE rank <= 3",
    "mutual_neighbours": f"WITH {PTS}, {_NEAR} SELECT m.id AS a, m.other AS b, round(m.d, 6) AS d FROM near m JOIN near n ON m.rank = 1 AND n.rank = 1 AND m.other = n.id AND n.other = m.id WHERE m.id < m.other",
    "k_distance": f"WITH {PTS}, {_NEAR} SELECT round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS eps, round(max(d), 6) AS largest FROM near WHERE rank = {MIN_POINTS - 1}",
    "dbscan_core_flags": f"WITH {PTS}, {_PAIRS} SELECT a AS id, count(*) >= {MIN_POINTS} AS core FROM pairs GROUP BY a",
    "ripley_k": f"WITH {PTS}, size AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM pts), {_PAIRS.replace(str(RADIUS), '20.0')}, radii AS (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS r) SELECT r, round(any_value(area) / (any_value(n) * (any_value(n) - 1)) * count(*), 6) AS k FROM pairs JOIN radii ON d <= r, size WHERE a <> b GROUP BY r",
}

"""Queries on cluster sizes, labels, events by precision, and summaries of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, neighbours, paint, regions, shapes, summaries
from ..operators import statistics as stats
from ..sources.tables import clustered_points, plane_points, read, samples, slab_points
from .common import CLUSTERED, PTS, SAMPLES, SLAB, rounded
from .results import _ICC
from .space import _NEAR, _PAIRS, CIRCLE, RADIUS, SQUARE

LINK_RADIUS, DARK = 12.0, 30
STEPS = 7
NEXT, REPEAT, GAP = 9.0, 6.0, 40
CONSTANTS, FUSED = [14.0, 26.0], 3.0
TOLERANCE, MOST_CELLS = 20.0, 3
SPREAD = 0.4


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Localizations of an order and group as one event."""
    return clustered_points(spark, d).withColumn("event", F.concat_ws(":", "frame", "grp")).withColumn("lp", F.when(F.col("x") != 13, F.col("lp"))).drop("frame").withColumnRenamed("step", "frame")


def cluster_axes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapes.cluster_axes(clustered_points(spark, d)), 5)


def cluster_areas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapes.cluster_areas(clustered_points(spark, d).where("label < 0 or x + y < 2 * label + 10")))


def axial_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapes.axial_medians(clustered_points(spark, d)))


def neighbour_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapes.neighbour_summary(neighbours.nearest(plane_points(spark, d), 1, RADIUS)))


def counts_within(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapes.counts_within(neighbours.neighbour_counts(plane_points(spark, d), RADIUS)))


def rigid_frame(spark: SparkSession, d: str) -> DataFrame:
    turned = clustered_points(spark, d).select("label", *shapes.rigid("x", "y", "z", (0.0, 0.0, 1.0), 0.5235987755982988, (25.0, 50.0, 0.0)))
    return rounded(turned.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")), 5)


def reference_labels(spark: SparkSession, d: str) -> DataFrame:
    points = clustered_points(spark, d)
    reference = points.where("label >= 0 and step = 0").select("x", "y", "z", "label")
    return labels.labels_at(points.select("id", "x", "y", "z"), reference).groupBy("label").agg(F.count("*").alias("n"))


def localization_states(spark: SparkSession, d: str) -> DataFrame:
    points = clustered_points(spark, d)
    found = labels.states_of(points.select("id", "label"), points.where("x = 50 and y = 0").select("label"))
    return found.groupBy("state").agg(F.count("*").alias("n"))


def shared_events(spark: SparkSession, d: str) -> DataFrame:
    return labels.shared_events(clustered_points(spark, d).select(F.col("frame").alias("event"), "label"))


def label_correspondence(spark: SparkSession, d: str) -> DataFrame:
    points = clustered_points(spark, d).select(F.col("label").alias("a"), F.when(F.col("x") > 45, -1).otherwise(F.floor(F.col("label") / 3 + F.col("x") / 200)).cast("int").alias("b"))
    return labels.correspondence(points)


def matched_decisions(spark: SparkSession, d: str) -> DataFrame:
    points = plane_points(spark, d)
    # Of the clusters at a place the first is the nearest to any decision, of its decisions the last counts.
    one = lambda df, pick: neighbours.placed(df).groupBy("x", "y").agg(pick("id").alias("id"))
    clusters, decisions = one(points.where("id % 5 = 0"), F.min), one(points.where("id % 7 = 0"), F.max)
    pairs = neighbours.radius_pairs(clusters, decisions, RADIUS).select(F.col("a").alias("cluster"), F.col("b").alias("decision"), "d")
    return rounded(labels.matched_decisions(pairs))


def regions_with_all(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return labels.holds_all(clustered_points(spark, d).where("x < 45").select(F.col("frame").alias("grp"), "x", "y"), {"circle": regions.in_circle(x, y, *CIRCLE), "square": regions.in_square(x, y, *SQUARE)})


def distinct_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.distinct_values(plane_points(spark, d).select(F.floor(F.col("y") / 100).alias("grp"), F.col("x").alias("value")), TOLERANCE))


def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.concat_ws(".", F.date_format("o_orderdate", "yy"), F.col("o_custkey") % 9, F.col("o_orderkey") % 4).alias("label"), "o_orderkey")
    return labels.duplicate_labels(rows, "label", "o_orderkey")


def unique_best(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey as key", "l_linenumber as candidate", "l_quantity as score")
    return labels.unique_best(rows)


def nearest_angles(spark: SparkSession, d: str) -> DataFrame:
    turns = clustered_points(spark, d).groupBy("id", F.col("label").alias("grp")).agg(F.min(F.pmod(F.col("photons") / 7, F.lit(360.0))).alias("turn"))
    return rounded(labels.nearest_angle(turns.where("id % 2 = 0"), turns.where("id % 2 = 1")), 5)


def linked_events(spark: SparkSession, d: str) -> DataFrame:
    locs = clustered_points(spark, d).groupBy("id").agg(F.min("label").alias("grp"), F.min("frame").alias("frame"), F.min("x").alias("x"), F.min("y").alias("y"))
    return paint.link(locs, LINK_RADIUS, DARK)


def weighted_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paint.weighted_events(_linked(spark, d), STEPS), 5)


def events_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paint.events_per_cluster(_linked(spark, d)))


def locs_per_cycle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paint.locs_per_cycle(paint.weighted_events(_linked(spark, d), STEPS), 30))


def fusion_table(spark: SparkSession, d: str) -> DataFrame:
    clusters = _linked(spark, d).where("label >= 0").groupBy("label").agg(F.countDistinct("event").alias("n_events"))
    return rounded(paint.fusion_table(clusters, CONSTANTS, FUSED))


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return paint.length_histogram(paint.weighted_events(_linked(spark, d), STEPS).withColumn("length", F.col("length") * 2), "length")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return clustered_points(spark, d).select("id", F.col("label").alias("grp"), F.floor(F.col("frame") / 50).alias("frame"), "x", "y")


def next_frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paint.next_frame(_frames(spark, d), NEXT))


def repeat_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(paint.repeat_fraction(_frames(spark, d), REPEAT, GAP))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).withColumn("other", F.col("value") - 150_000.0)


def mixed_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").selectExpr("p_brand", "p_type", "case when p_size % 2 = 0 then 'a' else '' end as unit", "cast(p_size % 3 as string) as version")
    return summaries.mixed_columns(rows, rows.columns)


def animal_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.by_animal(_rows(spark, d), ["value", "other"]))


def scoped_means(spark: SparkSession, d: str) -> DataFrame:
    scopes = {"main": F.col("axon") % 2 == 0, "no_misfit": F.col("axon") % 3 > 0, "all": F.lit(True)}
    return rounded(summaries.over_scopes(samples(spark, d), scopes))


def reading_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("grp", "animal", F.when(F.col("value") > 200_000, "lattice").when(F.col("value") > 100_000, "weak").otherwise("none").alias("reading"), F.col("value").alias("spacing"))
    return rounded(summaries.readings(rows, ["lattice", "weak", "none"], 30), 5)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").selectExpr(
        "l_orderkey as axon", "cast(l_linenumber as string) as method", "concat('r', l_orderkey % 3) as readout", "case l_orderkey % 3 when 0 then 'value' when 1 then 'p_value' else 'count' end as kind",
        "l_linenumber = 1 as is_reference", "case when l_quantity <> 17 then l_quantity end as value", "case when l_orderkey % 3 = 1 and l_tax <> 0.08 then case when l_discount > 0.07 then 'reject' else 'keep' end end as verdict",
    )


def conclusions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.conclusions(_long(spark, d), SPREAD))


def conclusions_over_axons(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.over_axons(summaries.conclusions(_long(spark, d), SPREAD)))


def null_z_scores(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return rounded(summaries.z_scores(s.groupBy("grp").agg(F.max("value").alias("observed")), s))


def finite_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("grp", F.when(F.col("axon") % 4 == 0, F.lit(float("nan"))).when(F.col("axon") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value") - 150_000.0).alias("value"))
    return rounded(summaries.finite_summary(rows), 5)


def fisher_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.fisher_z(clustered_points(spark, d).select(F.col("label").alias("grp"), F.col("x").alias("a"), F.col("photons").alias("b"))), 5)


def planned_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").selectExpr("p_type as method", "concat('{\"size\":', p_size % 5, '}') as params", "p_partkey as asked", "p_brand = 'Brand#11' as slow")
    return summaries.planned_runs(rows, "PROMO")


def tau_choices(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.tau_choices(read(spark, d, "part").select((F.col("p_retailprice") / 730.3).alias("value"))))


def design_effect(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return rounded(summaries.design_effect(stats.intraclass_correlation(s), s), 5)


def fusion_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slab_points(spark, d).groupBy("grp").agg(F.sum(summaries.fusion_scale(F.col("x"))).alias("scale")))


QUERIES = {f.__name__: f for f in (cluster_axes, cluster_areas, axial_medians, neighbour_summary, counts_within, rigid_frame, reference_labels, localization_states, shared_events, label_correspondence, matched_decisions, regions_with_all, distinct_sizes, duplicate_labels, unique_best, nearest_angles, linked_events, weighted_events, events_per_cluster, locs_per_cycle, fusion_table, length_histogram, next_frame_pairs, repeat_fraction, mixed_columns, animal_means, scoped_means, reading_counts, conclusions, conclusions_over_axons, null_z_scores, finite_summary, fisher_z, planned_runs, tau_choices, design_effect, fusion_scale)}

_W = "CASE WHEN lp > 0 THEN 1 / (lp * lp) ELSE 0::DOUBLE END"
_LINKED = f"{CLUSTERED}, linked AS (SELECT id, label, grp, frame || ':' || grp AS event, x, y, z, photons, CASE WHEN x <> 13 THEN lp END AS lp, step AS frame FROM clus), weighted AS (SELECT *, {_W} AS w FROM linked)"
_EVENTS = f"{_LINKED}, events AS (SELECT event, grp, min(frame) AS first, max(frame) AS last, count(*) AS n_locs, sum(photons) AS photons, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y, sum(z * w) / sum(w) AS z, max(frame) - min(frame) + 1 AS length, 1 / sqrt(sum(w)) AS se, min(frame) > 0 AND max(frame) < {STEPS - 1} AS whole FROM weighted GROUP BY ALL HAVING sum(w) > 0)"
_FRAMES = f"{CLUSTERED}, f AS (SELECT id, label AS grp, frame // 50 AS frame, x, y FROM clus)"
_LONG = """long AS (SELECT l_orderkey AS axon, l_linenumber::VARCHAR AS method, 'r' || (l_orderkey % 3) AS readout, CASE l_orderkey % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'p_value' ELSE 'count' END AS kind, l_linenumber = 1 AS is_reference, CASE WHEN l_quantity <> 17 THEN l_quantity END AS value, CASE WHEN l_orderkey % 3 = 1 AND l_tax <> 0.08 THEN CASE WHEN l_discount > 0.07 THEN 'reject' ELSE 'keep' END END AS verdict FROM lineitem)"""
_CONCLUSIONS = f"""{_LONG}, agg AS (SELECT axon, readout, kind, max(value) FILTER (is_reference) AS rv, max(verdict) FILTER (is_reference) AS rd, count(*) AS n_methods, count(value) AS n_values, min(value) AS lo, max(value) AS hi, min(struct_pack(v := value, m := method)) FILTER (value IS NOT NULL) AS a,
count(verdict) FILTER (NOT is_reference) AS others, count(DISTINCT verdict) FILTER (NOT is_reference) AS kinds, max(verdict) FILTER (NOT is_reference) AS od FROM long GROUP BY ALL), top AS (SELECT l.axon, l.readout, min(method) AS mm FROM long l JOIN agg g USING (axon, readout) WHERE l.value = g.hi GROUP BY ALL),
conclusion AS (SELECT axon, readout, kind, rv AS reference_value, n_methods, n_values, lo AS min_value, a.m AS min_method, hi AS max_value, mm AS max_method, hi - lo AS "range", CASE WHEN rv <> 0 THEN (hi - lo) / abs(rv) END AS relative_range, CASE WHEN kind <> 'p_value' THEN CASE WHEN rv <> 0 THEN (hi - lo) / abs(rv) END > {SPREAD} END AS large_spread,
CASE WHEN kind <> 'p_value' THEN 'spread only' WHEN rd IS NULL OR others = 0 THEN 'undetermined' WHEN kinds > 1 OR od <> rd THEN 'yes' ELSE 'no' END AS depends FROM agg LEFT JOIN top USING (axon, readout))"""
_C, _S = 0.8660254037844387, 0.49999999999999994
_CROSS = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"
_ALONG = "(b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y)"
#: Only the lowest and highest point at each x can be corners; a side is a pair that all others are left of, or between.
_HULLS = f"""{CLUSTERED}, used AS (SELECT label, x, y FROM clus WHERE label >= 0 AND x + y < 2 * label + 10), ends AS (SELECT label, x, min(y) AS lo, max(y) AS hi FROM used GROUP BY ALL), p AS (SELECT DISTINCT label, x, unnest([lo, hi]) AS y FROM ends),
sides AS (SELECT a.label, a.x * b.y - b.x * a.y AS twice FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.label = a.label GROUP BY a.label, a.x, a.y, b.x, b.y HAVING bool_and({_CROSS} > 1e-7 OR (abs({_CROSS}) <= 1e-7 AND {_ALONG} BETWEEN -1e-7 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + 1e-7))),
areas AS (SELECT label, abs(sum(twice)) / 2 AS area FROM sides GROUP BY label)"""
ORACLES = {
    "cluster_areas": f"WITH {_HULLS} SELECT label, count(*) AS n, round(coalesce(any_value(area), 0), 6) AS hull_area, round(sqrt(coalesce(any_value(area), 0) / pi()), 6) AS r_eff FROM used LEFT JOIN areas USING (label) GROUP BY label",
    "cluster_axes": f"""WITH {CLUSTERED}, o AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM clus WHERE label >= 0 GROUP BY label), a AS (SELECT *, sqrt((vx + vy) / 2 + sqrt(pow(vx - vy, 2) / 4 + vxy * vxy)) AS major, sqrt(greatest((vx + vy) / 2 - sqrt(pow(vx - vy, 2) / 4 + vxy * vxy), 0)) AS minor FROM o)
SELECT label, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(sqrt(vx), 5) AS sd_x, round(sqrt(vy), 5) AS sd_y, round(major, 5) AS major, round(minor, 5) AS minor, round(CASE WHEN minor > 0 THEN major / minor END, 5) AS elongation FROM a""",
    "axial_medians": f"WITH {CLUSTERED} SELECT label, count(*) AS n, round(quantile_cont(z, 0.25), 6) AS q1, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.75), 6) AS q3 FROM clus WHERE label >= 0 GROUP BY label",
    "neighbour_summary": f"WITH {PTS}, {_NEAR} SELECT count(*) AS n, round(min(d), 6) AS least, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3 FROM near WHERE rank = 1",
    "counts_within": f"WITH {PTS}, {_PAIRS}, c AS (SELECT a, count(*) AS n FROM pairs GROUP BY a) SELECT count(*) AS n_points, round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean FROM c",
    "rigid_frame": f"WITH {CLUSTERED} SELECT label, round(avg((x - 25) * {_C} - (y - 50) * {_S} + 25), 5) AS x, round(avg((x - 25) * {_S} + (y - 50) * {_C} + 50), 5) AS y, round(avg(z), 5) AS z FROM clus GROUP BY label",
    "reference_labels": f"WITH {CLUSTERED}, r AS (SELECT x, y, z, min(label) AS label FROM clus WHERE label >= 0 AND step = 0 GROUP BY ALL) SELECT coalesce(r.label, -1) AS label, count(*) AS n FROM clus c LEFT JOIN r ON c.x = r.x AND c.y = r.y AND c.z = r.z GROUP BY 1",
    "localization_states": f"WITH {CLUSTERED} SELECT CASE WHEN label < 0 THEN 'noise' WHEN label IN (SELECT label FROM clus WHERE x = 50 AND y = 0) THEN 'discarded' ELSE 'kept' END AS state, count(*) AS n FROM clus GROUP BY 1",
    "shared_events": f"WITH {CLUSTERED}, o AS (SELECT DISTINCT frame, label FROM clus WHERE label >= 0), s AS (SELECT label, count(*) AS n FROM o GROUP BY label), p AS (SELECT x.label AS a, y.label AS b, count(*) AS shared FROM o x JOIN o y ON x.frame = y.frame AND x.label < y.label GROUP BY ALL) SELECT a, b, u.n - shared AS only_a, v.n - shared AS only_b, shared FROM p JOIN s u ON u.label = a JOIN s v ON v.label = b",
    "label_correspondence": f"""WITH {CLUSTERED}, l AS (SELECT label AS a, CASE WHEN x > 45 THEN -1 ELSE floor(label / 3 + x / 200)::INT END AS b FROM clus), t AS (SELECT a, b, count(*) AS n FROM l WHERE a >= 0 OR b >= 0 GROUP BY ALL), ob AS (SELECT b, arg_max(a, (n, -a)) AS a FROM t WHERE b >= 0 GROUP BY b), oa AS (SELECT a, arg_max(b, (n, -b)) AS b FROM t WHERE a >= 0 GROUP BY a),
p AS (SELECT a, count(*) AS n FROM ob WHERE a >= 0 GROUP BY a), h AS (SELECT b, count(*) AS n FROM oa WHERE b >= 0 GROUP BY b) SELECT oa.a, CASE WHEN oa.b < 0 THEN 'missed' WHEN coalesce(p.n, 0) > 1 THEN 'split' WHEN h.n > 1 THEN 'merged' ELSE 'one-to-one' END AS kind, coalesce(p.n, 0) AS n_parts FROM oa LEFT JOIN p ON p.a = oa.a LEFT JOIN h ON h.b = oa.b""",
    "matched_decisions": f"WITH {PTS}, {_PAIRS}, n AS (SELECT b AS decision, arg_min(a, (d, a)) AS cluster, min(d) AS d FROM pairs WHERE a % 5 = 0 AND b % 7 = 0 GROUP BY b) SELECT cluster, max(decision) AS decision, round(arg_max(d, decision), 6) AS d FROM n GROUP BY cluster",
    "regions_with_all": f"""WITH {CLUSTERED}, c AS (SELECT frame AS grp, count(*) AS n, count(*) FILTER (WHERE sqrt((x - {CIRCLE[0]}) * (x - {CIRCLE[0]}) + (y - {CIRCLE[1]}) * (y - {CIRCLE[1]})) <= {CIRCLE[2]}) AS c, count(*) FILTER (WHERE x > {SQUARE[0]} AND x < {SQUARE[2]} AND y > {SQUARE[1]} AND y < {SQUARE[3]}) AS s FROM clus WHERE x < 45 GROUP BY frame)
SELECT grp, 'circle' AS region, c AS inside, c = n AS all_inside FROM c UNION ALL SELECT grp, 'square', s, s = n FROM c""",
    "distinct_sizes": f"""WITH RECURSIVE {PTS}, v AS (SELECT DISTINCT floor(y / 100)::BIGINT AS grp, x AS value FROM pts), walk AS (SELECT grp, min(value) AS value FROM v GROUP BY grp UNION ALL SELECT w.grp, (SELECT min(v.value) FROM v WHERE v.grp = w.grp AND v.value - w.value > {TOLERANCE}) FROM walk w WHERE w.value IS NOT NULL) SELECT grp, round(value, 6) AS value FROM walk WHERE value IS NOT NULL""",
    "duplicate_labels": "SELECT strftime(o_orderdate, '%y') || '.' || (o_custkey % 9) || '.' || (o_orderkey % 4) AS label, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING count(*) > 1",
    "unique_best": "WITH m AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) SELECT l_orderkey AS key, min(l_linenumber) AS candidate FROM m WHERE l_quantity = best GROUP BY 1 HAVING count(*) = 1",
    "nearest_angles": f"WITH {CLUSTERED}, t AS (SELECT id, label AS grp, min(photons / 7 - floor(photons / 7 / 360) * 360) AS turn FROM clus GROUP BY ALL) SELECT a.grp, a.id, round(min(least(abs(a.turn - b.turn), 360 - abs(a.turn - b.turn))), 5) AS offset FROM t a JOIN t b USING (grp) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL",
    "weighted_events": f"WITH {_EVENTS} SELECT event, grp, first, last, n_locs, round(photons, 5) AS photons, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, length, round(se, 5) AS se, whole FROM events",
    "events_per_cluster": f"WITH {_LINKED}, e AS (SELECT label, event, count(*) AS n, max(frame) - min(frame) + 1 AS length FROM linked WHERE label >= 0 GROUP BY ALL) SELECT label, count(*) AS n_events, sum(n)::BIGINT AS n_locs, round(quantile_cont(n, 0.5), 6) AS median_locs, round(quantile_cont(length, 0.5), 6) AS median_length FROM e GROUP BY label",
    "locs_per_cycle": f"WITH {_EVENTS} SELECT grp, count(*) AS n_events, CASE WHEN count(*) >= 30 THEN round(avg(n_locs), 6) END AS mean, CASE WHEN count(*) >= 30 THEN round(stddev_samp(n_locs) / sqrt(count(*)), 6) END AS se FROM events WHERE whole GROUP BY grp",
    "fusion_table": f"WITH {_LINKED}, c AS (SELECT label, count(DISTINCT event) AS n FROM linked WHERE label >= 0 GROUP BY label) SELECT k AS c_label, count(*) AS n_clusters, count(*) FILTER (WHERE n / k > {FUSED}) AS n_fused, round(avg((n / k > {FUSED})::INT), 6) AS fraction FROM c, (SELECT unnest([14.0, 26.0])::DOUBLE AS k) GROUP BY k",
    "length_histogram": f"WITH {_EVENTS}, h AS (SELECT length * 2 AS length, count(*) AS n FROM events GROUP BY 1) SELECT k AS length, coalesce(n, 0) AS n FROM range(1, (SELECT max(length) + 1 FROM h)) r(k) LEFT JOIN h ON h.length = k",
    "next_frame_pairs": f"WITH {_FRAMES}, p AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM f a JOIN f b ON a.grp = b.grp AND b.frame = a.frame + 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM p WHERE d < {NEXT}) SELECT id, round(min(d), 6) AS d1, round(max(d) FILTER (WHERE k = 2), 6) AS d2 FROM r WHERE k <= 2 GROUP BY id",
    "repeat_fraction": f"WITH {_FRAMES}, s AS (SELECT DISTINCT a.id FROM f a JOIN f b ON a.grp = b.grp AND abs(a.frame - b.frame) >= {GAP} AND b.x BETWEEN a.x - {REPEAT} AND a.x + {REPEAT} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {REPEAT}) SELECT grp, count(*) AS n, round(avg((s.id IS NOT NULL)::INT), 6) AS fraction FROM f LEFT JOIN s USING (id) GROUP BY grp",
    "mixed_columns": "WITH r AS (SELECT p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END AS unit, (p_size % 3)::VARCHAR AS version FROM part), u AS (SELECT 'p_brand' AS \"column\", p_brand AS v FROM r UNION ALL SELECT 'p_type', p_type FROM r UNION ALL SELECT 'unit', unit FROM r UNION ALL SELECT 'version', version FROM r) SELECT \"column\", count(DISTINCT v) AS n, min(v) AS first, max(v) AS last FROM u WHERE v <> '' GROUP BY 1 HAVING count(DISTINCT v) > 1",
    "animal_means": f"WITH {SAMPLES}, u AS (SELECT animal, 'value' AS measure, value AS v FROM samples UNION ALL SELECT animal, 'other', value - 150000 FROM samples), s AS (SELECT animal, measure, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM u GROUP BY ALL) SELECT animal, measure, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END, 6) AS t FROM s",
    "scoped_means": f"WITH {SAMPLES}, u AS (SELECT 'main' AS scope, * FROM samples WHERE axon % 2 = 0 UNION ALL SELECT 'no_misfit', * FROM samples WHERE axon % 3 > 0 UNION ALL SELECT 'all', * FROM samples) SELECT scope, grp, count(*) AS n, count(DISTINCT animal) AS animals, round(avg(value), 6) AS mean FROM u GROUP BY ALL",
    "reading_counts": f"WITH {SAMPLES} SELECT grp, count(*) FILTER (WHERE value > 200000) AS lattice, count(*) FILTER (WHERE value > 100000 AND value <= 200000) AS weak, count(*) FILTER (WHERE value <= 100000) AS none, round(quantile_cont(value, 0.5), 5) AS median_spacing, count(DISTINCT animal) FILTER (WHERE value > 200000) >= 30 AS evidence FROM samples GROUP BY grp",
    "conclusions": f"WITH {_CONCLUSIONS} SELECT axon, readout, kind, reference_value, n_methods, n_values, min_value, min_method, max_value, max_method, \"range\", round(relative_range, 6) AS relative_range, large_spread, depends FROM conclusion",
    "conclusions_over_axons": f"WITH {_CONCLUSIONS} SELECT readout, kind, count(*) AS n_axons, count(*) FILTER (WHERE depends = 'yes') AS n_depends, count(*) FILTER (WHERE depends = 'undetermined') AS n_undetermined, count(*) FILTER (WHERE large_spread) AS n_large_spread, round(quantile_cont(relative_range, 0.5), 6) AS median_relative_range FROM conclusion GROUP BY ALL",
    "null_z_scores": f"WITH {SAMPLES} SELECT grp, round((max(value) - avg(value)) / stddev_samp(value), 6) AS z FROM samples GROUP BY grp",
    "finite_summary": f"WITH {SAMPLES} SELECT grp, count(*) AS n, round(quantile_cont(value - 150000, 0.5), 5) AS median, round(avg((value - 150000 > 0)::INT), 5) AS positive FROM samples WHERE axon % 4 > 1 GROUP BY grp",
    "fisher_z": f"WITH {CLUSTERED}, o AS (SELECT label AS grp, count(*) AS n, corr(x, photons) AS r FROM clus GROUP BY label) SELECT grp, n, round(r, 5) AS r, round(atanh(r) * sqrt(n - 3), 5) AS z FROM o WHERE n > 3 AND abs(r) < 1",
    "planned_runs": "WITH o AS (SELECT p_type AS method, '{\"size\":' || (p_size % 5) || '}' AS params, min(p_partkey) AS asked, count(*) AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY method <> 'PROMO', asked)::INT AS place, method, params, n FROM o",
    "tau_choices": "SELECT round_even(p_retailprice / 730.3::DOUBLE, 2) AS tau, count(*) AS n FROM part GROUP BY 1",
    "design_effect": f"WITH {SAMPLES}, {_ICC}, i AS (SELECT grp, CASE WHEN w > 0 THEN greatest(0, (b - w) / n0) / (greatest(0, (b - w) / n0) + w) END AS icc FROM ms), s AS (SELECT grp, avg(n) AS m, sum(n) AS rows FROM per GROUP BY grp) SELECT grp, round(icc, 5) AS icc, round(1 + (m - 1) * icc, 5) AS effect, round(rows / (1 + (m - 1) * icc), 5) AS effective_n FROM i JOIN s USING (grp)",
    "fusion_scale": f"WITH {SLAB} SELECT grp, round(sum(greatest(x - 20, 0)), 6) AS scale FROM locs GROUP BY grp",
}

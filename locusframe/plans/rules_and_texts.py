"""Queries on slices, rules and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import rules, slices
from ..sources.tables import clustered_points, read, slab_points
from .common import CLUSTERED, SLAB, rounded

Z0, THICKNESS, GUARD = 40.0, 22.0, 3.0
SLABS = [(0.0, 35.0, 17.5), (25.0, 60.0, 42.5), (55.0, 75.0, 65.0)]
PARTS = [(0.5, 15.0, 9.0), (0.3, 40.0, 12.0), (0.2, 70.0, 6.0)]
WIDTH, SHARE, LEAST = 10.0, 0.5, 20
BOUNDARY, BAND, WINDOW, MEAN, SD = 40.0, 15.0, (0.0, 80.0), 42.0, 25.0
EXCLUDE, DOUBT = 70.0, 30.0
VIABLE, MARGINAL = 0.03, 0.06
FRAMES = 60_000


def slice_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.slice_report(slab_points(spark, d), Z0, THICKNESS, GUARD))


def slab_index(spark: SparkSession, d: str) -> DataFrame:
    return slab_points(spark, d).groupBy(slices.slab_index(F.col("z"), SLABS).alias("ring")).agg(F.count("*").alias("n"))


def mixture_posterior(spark: SparkSession, d: str) -> DataFrame:
    part, p = slices.posterior(F.col("z"), PARTS)
    found = slab_points(spark, d).select(part.alias("part"), F.round(p, 9).alias("p"))
    return rounded(found.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(F.col("p") < 0.9, 1)).alias("ambiguous"), F.avg("p").alias("mean_p")))


def edge_truncation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.edge_truncation(slab_points(spark, d), WIDTH, SHARE, LEAST))


def boundary_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.boundary_fraction(slab_points(spark, d), BOUNDARY, BAND, WINDOW, MEAN, SD))


def stage_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = clustered_points(spark, d)
    block, turn = slices.step_of_frame(F.col("frame"), 30, 20), slices.step_of_frame(F.col("frame"), 30, 20, True)
    return rows.groupBy(block.alias("block"), turn.alias("turn")).agg(F.count("*").alias("n"))


def arc_bins(spark: SparkSession, d: str) -> DataFrame:
    return clustered_points(spark, d).groupBy(slices.arc_bin(F.col("x") * 7, 100.0, 16, 30.0).alias("bin")).agg(F.count("*").alias("n"))


def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.otsu(clustered_points(spark, d).select("grp", F.col("photons").alias("value")), 64), 4)


def depth_states(spark: SparkSession, d: str) -> DataFrame:
    depth = F.when(F.col("x") > 2, F.col("z") - F.col("x"))
    return slab_points(spark, d).groupBy("grp", rules.depth_state(depth, EXCLUDE, DOUBT).alias("state")).agg(F.count("*").alias("n"))


def lumen_rule(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    remove, doubtful, vetoed = rules.lumen_rule(x > 40, x > 30, x > 20, F.when(x != 7, y - 30), z - 40, F.col("grp") != "R", F.col("grp") != "A", 25.0, 0.0, 20.0)
    return slab_points(spark, d).groupBy("grp", remove.alias("remove"), doubtful.alias("doubtful"), vetoed.alias("vetoed")).agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").selectExpr("l_suppkey as axon", "l_quantity > 10 as peak", "l_linenumber < 5 as valley", "l_returnflag <> 'R' as count", "case when l_quantity <> 20 then l_tax end as leak")


def combination_table(spark: SparkSession, d: str) -> DataFrame:
    return rules.combination_table(_pairs(spark, d), VIABLE, MARGINAL)


def pair_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verdict, reasons = rules.pair_verdict([(c, F.col(c)) for c in ("peak", "valley", "count")], F.col("leak"), VIABLE, MARGINAL)
    return _pairs(spark, d).groupBy(verdict.alias("verdict"), reasons.alias("reasons")).agg(F.count("*").alias("n"))


def axon_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verdict, _ = rules.pair_verdict([(c, F.col(c)) for c in ("peak", "valley", "count")], F.col("leak"), VIABLE, MARGINAL)
    hard = _pairs(spark, d).withColumn("verdict", verdict).where("axon % 3 > 0 or verdict <> 'VIABLE'")
    return rules.best_verdict(hard)


def pool_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").selectExpr(
        "o_orderpriority as scope", "case when o_orderstatus = 'P' then 'failed' else 'ok' end as status", "case when o_orderkey % 2 = 0 then 'no centre' else '' end as failure",
        "o_orderkey % 5 > 0 as assessed", "case when o_orderkey % 7 = 0 then 'open' else '' end as rejected", "case when o_orderkey % 3 = 0 then 'spread' else '' end as gate",
    )
    reason = rules.pool_reason(*(F.col(c) for c in ("status", "failure", "assessed", "rejected", "gate")))
    return rows.groupBy("scope", reason.alias("reason")).agg(F.count("*").alias("n"))


def edge_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = clustered_points(spark, d).where("not (label % 2 = 0 and (x < 10 or y < 30))")
    return rounded(rules.edge_clusters(points, F.least(F.col("x") - 1, F.col("y")), 5.0, 0.6))


def kept_labels(spark: SparkSession, d: str) -> DataFrame:
    points = clustered_points(spark, d)
    return rules.kept_labels(points, points.where("x = 50 and y = 0").select("label"))


def frame_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.frame_analysis(clustered_points(spark, d), FRAMES))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    path = "concat('/data/', case when o_orderkey % 3 = 0 then 'WT' when o_orderkey % 3 = 1 then 'ko' else 'het' end, '/Animal_', o_custkey, '/ROI', o_orderkey % 4, '/', date_format(o_orderdate, 'yyMMdd'), '_', case when o_orderkey % 5 > 0 then concat('axon ', o_orderkey % 6) else 'x' end, '.locs.hdf5')"
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{path} as path")


def identities(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("o_orderkey", *texts.identity(F.col("path")))


def trace_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).select("o_orderkey", *texts.identity(F.col("path")), texts.date_of(F.col("path")).alias("date"))
    return rows.select("o_orderkey", "date", texts.trace_label(F.substring("date", 1, 2), F.col("roi"), F.col("axon")).alias("label"))


def side_files(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("o_orderkey", texts.with_suffix(F.col("path"), ".yaml").alias("side"))


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, " wt").when(F.col("c_custkey") % 4 == 1, "Ko ").when(F.col("c_custkey") % 4 == 2, " Het ")
    return read(spark, d, "customer").groupBy(texts.genotype(raw).alias("genotype")).agg(F.count("*").alias("n"))


def cluster_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", texts.cluster_key(F.col("p_size") % 5, F.col("p_partkey"), F.col("p_retailprice"), -F.col("p_size") / 4.0).alias("key"))


def guide_cells(spark: SparkSession, d: str) -> DataFrame:
    points = F.array(*(F.struct((F.col("p_size") * k / 8).cast("double").alias("x"), (F.col("p_partkey") + 0.25 * k).cast("double").alias("y")) for k in (1, 2, 3)))
    cell = texts.guide_text(points)
    back = texts.guide_points(cell)
    return read(spark, d, "part").select("p_partkey", cell.alias("cell"), F.round(F.aggregate(back, F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sum_x"))


def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct((F.col("p_size") % 7).alias("a"), F.col("p_size").alias("b")), F.struct((F.col("p_size") % 3).alias("a"), (F.col("p_size") % 11).alias("b")))
    key = texts.pair_key(F.col("p_size") % 9, pairs)
    n, back = texts.pair_key_parts(key)
    return read(spark, d, "part").select("p_partkey", key.alias("key"), n.alias("n"), F.element_at(back, 1)["a"].alias("first_a"))


def column_units(spark: SparkSession, d: str) -> DataFrame:
    names = ["x_nm", "area_nm2", "area_nm2_discard", "length_um", "share_empty", "fraction_kept", "occupancy_percent", "turn_deg", "n_locs", "pixel_px", "hull_um2"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return read(spark, d, "part").groupBy(name.alias("name"), texts.unit_of(name).alias("unit")).agg(F.count("*").alias("n"))


def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    cell = texts.bool_cell(flag)
    number = F.when(F.col("p_size") % 5 == 0, "NA").when(F.col("p_size") % 5 == 1, " ").otherwise(F.col("p_size").cast("string"))
    return read(spark, d, "part").groupBy(cell.alias("cell"), texts.parsed_bool(cell).alias("back")).agg(F.count("*").alias("n"), F.sum(F.nanvl(texts.parsed_number(number), F.lit(-1.0))).alias("total"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size") * F.col("p_size") * 5.3 - 100
    return read(spark, d, "part").select("p_partkey", texts.duration(s).alias("words"), texts.time_left(F.col("p_size") / 50.5, F.col("p_retailprice") / 3).alias("left"))


QUERIES = {f.__name__: f for f in (slice_counts, slab_index, mixture_posterior, edge_truncation, boundary_fraction, stage_steps, arc_bins, otsu_threshold, depth_states, lumen_rule, combination_table, pair_verdicts, axon_verdicts, pool_gate, edge_clusters, kept_labels, frame_spread, identities, trace_labels, side_files, genotypes, cluster_keys, guide_cells, pair_keys, column_units, typed_cells, durations)}

_EXPECTED = (slices.normal_mass(max(BOUNDARY - BAND, WINDOW[0]), min(BOUNDARY + BAND, WINDOW[1]), MEAN, SD)) / slices.normal_mass(*WINDOW, MEAN, SD)
_DENSITY = [f"{w} / {s} * exp(-0.5 * pow((z - {m}) / {s}, 2))" for w, m, s in PARTS]
_PAIRS = "pairs AS (SELECT l_suppkey AS axon, l_quantity > 10 AS peak, l_linenumber < 5 AS valley, l_returnflag <> 'R' AS count_ok, CASE WHEN l_quantity <> 20 THEN l_tax END AS leak FROM lineitem)"
_VERDICTS = f"""{_PAIRS}, v AS (SELECT *, CASE WHEN peak AND valley AND count_ok AND leak <= {VIABLE} THEN 'VIABLE' WHEN peak AND valley AND count_ok AND leak <= {MARGINAL} THEN 'MARGINAL' ELSE 'NOT VIABLE' END AS verdict,
concat_ws('; ', CASE WHEN NOT peak THEN 'peak' END, CASE WHEN NOT valley THEN 'valley' END, CASE WHEN NOT count_ok THEN 'count' END, CASE WHEN NOT coalesce(leak <= {MARGINAL}, false) THEN 'leak' END) AS reasons FROM pairs)"""
_ASKED = "asks AS (SELECT * FROM (VALUES ('peak', true), ('peak', false)) a(x, ask_peak), (VALUES (true), (false)) b(ask_valley), (VALUES (true), (false)) c(ask_count), (VALUES (true), (false)) e(ask_leak))"
_SETS = f"{_ASKED}, sets AS (SELECT *, CASE WHEN concat_ws('+', CASE WHEN ask_peak THEN 'peak' END, CASE WHEN ask_valley THEN 'valley' END, CASE WHEN ask_count THEN 'count' END, CASE WHEN ask_leak THEN 'leak' END) = '' THEN 'none' ELSE concat_ws('+', CASE WHEN ask_peak THEN 'peak' END, CASE WHEN ask_valley THEN 'valley' END, CASE WHEN ask_count THEN 'count' END, CASE WHEN ask_leak THEN 'leak' END) END AS criteria FROM asks)"
_PATHS = "paths AS (SELECT o_orderkey, '/data/' || CASE o_orderkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'ko' ELSE 'het' END || '/Animal_' || o_custkey || '/ROI' || (o_orderkey % 4) || '/' || strftime(o_orderdate, '%y%m%d') || '_' || CASE WHEN o_orderkey % 5 > 0 THEN 'axon ' || (o_orderkey % 6) ELSE 'x' END || '.locs.hdf5' AS path FROM orders)"
_S = "(p_size * p_size * 5.3::DOUBLE - 100)"
_LEFT = "(p_retailprice / 3 * (1 - p_size / 50.5::DOUBLE) / (p_size / 50.5::DOUBLE))"
ORACLES = {
    "slice_counts": f"""WITH {SLAB}, s AS (SELECT grp, min(z) AS lo, max(z) AS hi FROM locs GROUP BY grp), g AS (SELECT grp, lo, hi, k::INT AS slice, {Z0} + (k - 0.5) * {THICKNESS} + {GUARD} AS a, {Z0} + (k + 0.5) * {THICKNESS} - {GUARD} AS b FROM s, range(-1, 2) r(k)),
c AS (SELECT g.grp, slice, any_value(lo) AS lo, any_value(hi) AS hi, any_value(a) AS a, any_value(b) AS b, count(l.z) AS n FROM g LEFT JOIN locs l ON l.grp = g.grp AND l.z >= a AND l.z < b GROUP BY ALL)
SELECT grp, slice, n, round(100.0::DOUBLE * n / nullif(max(CASE WHEN slice = 0 THEN n END) OVER (PARTITION BY grp), 0), 6) AS pct_of_central, round(greatest(0.0, least(1.0, (least(b, hi) - greatest(a, lo)) / (b - a))), 6) AS coverage FROM c""",
    "slab_index": f"WITH {SLAB}, r AS (SELECT row_number() OVER () AS source_index, z FROM locs), k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b}, {c})' for i, (a, b, c) in enumerate(SLABS))}) t(k, a, b, c)), h AS (SELECT source_index, arg_min(k, (abs(z - c), k)) AS ring FROM r JOIN k ON z BETWEEN a AND b GROUP BY source_index) SELECT coalesce(ring, -1)::INT AS ring, count(*) AS n FROM r LEFT JOIN h USING (source_index) GROUP BY 1",
    "mixture_posterior": f"WITH {SLAB}, p AS (SELECT [{', '.join(_DENSITY)}] AS p FROM locs), q AS (SELECT (list_position(p, list_max(p)) - 1)::INT AS part, round(list_max(p) / list_sum(p), 9) AS p FROM p) SELECT part, count(*) AS n, count(*) FILTER (WHERE p < 0.9) AS ambiguous, round(avg(p), 6) AS mean_p FROM q GROUP BY part",
    "edge_truncation": f"""WITH {SLAB}, e AS (SELECT grp, min(z) AS lo, max(z) AS hi FROM locs GROUP BY grp), b AS (SELECT grp, max(n) AS most FROM (SELECT l.grp, least(floor((z - lo) / {WIDTH}), greatest(ceil((hi - lo) / {WIDTH}) - 1, 0)) AS bin, count(*) AS n FROM locs l JOIN e USING (grp) GROUP BY ALL) GROUP BY grp),
r AS (SELECT grp, 'bottom' AS side, any_value(lo) AS edge, count(*) FILTER (WHERE z < lo + {WIDTH}) AS n FROM locs JOIN e USING (grp) GROUP BY grp UNION ALL SELECT grp, 'top', any_value(hi), count(*) FILTER (WHERE z > hi - {WIDTH}) FROM locs JOIN e USING (grp) GROUP BY grp)
SELECT grp, side, round(edge, 6) AS edge, n, round(n / most, 6) AS share, n >= {LEAST} AND n / most >= {SHARE} AS cut FROM r JOIN b USING (grp)""",
    "boundary_fraction": f"WITH {SLAB} SELECT grp, round(avg(CASE WHEN abs(z - {BOUNDARY}) <= {BAND} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraction, round({_EXPECTED!r}::DOUBLE, 6) AS expected FROM locs GROUP BY grp",
    "stage_steps": f"WITH {CLUSTERED} SELECT CASE WHEN frame >= 0 AND frame < 600 THEN frame // 20 ELSE -1 END AS block, CASE WHEN frame >= 0 AND frame < 600 THEN frame % 30 ELSE -1 END AS turn, count(*) AS n FROM clus GROUP BY ALL",
    "arc_bins": f"WITH {CLUSTERED}, s AS (SELECT x * 7 - 30 - floor((x * 7 - 30) / 100) * 100 AS s FROM clus) SELECT least(floor(s / 6.25), 15)::INT AS bin, count(*) AS n FROM s GROUP BY 1",
    "otsu_threshold": f"""WITH {CLUSTERED}, e AS (SELECT grp, min(photons) AS lo, max(photons) AS hi FROM clus GROUP BY grp), h AS (SELECT grp, least(floor((photons - lo) / ((hi - lo) / 64)), 63)::INT AS bin, count(*) AS n FROM clus JOIN e USING (grp) GROUP BY ALL),
g AS (SELECT e.grp, lo, hi, k::INT AS bin, coalesce(n, 0)::DOUBLE AS n, lo + (k + 0.5) * (hi - lo) / 64 AS c FROM e CROSS JOIN range(64) r(k) LEFT JOIN h ON h.grp = e.grp AND h.bin = k), w AS (SELECT *, sum(n) OVER o AS w0, sum(n) OVER p AS w, sum(n * c) OVER o AS m0, sum(n * c) OVER p AS m FROM g WINDOW o AS (PARTITION BY grp ORDER BY bin), p AS (PARTITION BY grp)),
b AS (SELECT *, w0 * (w - w0) * pow(m0 / w0 - (m - m0) / (w - w0), 2) AS v FROM w WHERE bin < 63 AND w0 > 0 AND w0 < w), t AS (SELECT *, bin - row_number() OVER (PARTITION BY grp ORDER BY bin) AS i FROM (SELECT *, max(v) OVER (PARTITION BY grp) AS best FROM b) WHERE v >= best * (1 - 1e-9)), f AS (SELECT *, min(i) OVER (PARTITION BY grp) AS i0 FROM t)
SELECT grp, round(any_value(lo) + (min(bin) + max(bin) + 2) / 2.0::DOUBLE * (any_value(hi) - any_value(lo)) / 64, 4) AS threshold FROM f WHERE i = i0 GROUP BY grp""",
    "depth_states": f"WITH {SLAB}, d AS (SELECT grp, CASE WHEN x > 2 THEN z - x END AS depth FROM locs) SELECT grp, CASE WHEN depth IS NULL THEN 'not evaluated' WHEN depth > {EXCLUDE} THEN 'unanchored' WHEN depth > {DOUBT} THEN 'doubtful' ELSE 'anchored' END AS state, count(*) AS n FROM d GROUP BY ALL",
    "lumen_rule": f"""WITH {SLAB}, a AS (SELECT grp, x > 40 AS s, x > 30 AS m, x > 20 AS e, grp <> 'A' AS wf, grp <> 'R' AND grp <> 'A' AS u, coalesce(x <> 7 AND y - 30 > 25 AND z - 40 > 25, false) AND grp <> 'A' AS wf250, coalesce(x <> 7 AND y - 30 > 0 AND z - 40 > 0, false) AND grp <> 'A' AS wf0, z - 40 < -20 AS o FROM locs),
b AS (SELECT *, (wf0 AND m) OR (wf250 AND u) AS t FROM a), c AS (SELECT *, u AND s AND NOT t AND o AS vetoed FROM b), r AS (SELECT *, (s OR t) AND NOT vetoed AS remove FROM c) SELECT grp, remove, (wf0 OR wf250 OR e OR vetoed) AND NOT remove AS doubtful, vetoed, count(*) AS n FROM r GROUP BY ALL""",
    "combination_table": f"""WITH {_PAIRS}, {_SETS}, e AS (SELECT criteria, axon, (NOT ask_peak OR peak) AND (NOT ask_valley OR valley) AND (NOT ask_count OR count_ok) AS f, ask_leak, leak FROM pairs, sets), g AS (SELECT *, f AND (NOT ask_leak OR coalesce(leak <= {VIABLE}, false)) AS good, f AND (NOT ask_leak OR coalesce(leak <= {MARGINAL}, false)) AS fair FROM e)
SELECT criteria, count(*) FILTER (WHERE good) AS viable, count(*) FILTER (WHERE fair) AS viable_or_marginal, count(DISTINCT axon) FILTER (WHERE good) AS axons FROM g GROUP BY criteria""",
    "pair_verdicts": f"WITH {_VERDICTS} SELECT verdict, reasons, count(*) AS n FROM v GROUP BY ALL",
    "axon_verdicts": f"WITH {_VERDICTS} SELECT axon, CASE min(CASE verdict WHEN 'VIABLE' THEN 0 WHEN 'MARGINAL' THEN 1 ELSE 2 END) WHEN 0 THEN 'VIABLE' WHEN 1 THEN 'MARGINAL' ELSE 'NOT VIABLE' END AS verdict FROM v WHERE axon % 3 > 0 OR verdict <> 'VIABLE' GROUP BY axon",
    "pool_gate": """SELECT o_orderpriority AS scope, CASE WHEN o_orderstatus = 'P' THEN 'analysis failed' || CASE WHEN o_orderkey % 2 = 0 THEN ': no centre' ELSE '' END WHEN o_orderkey % 5 = 0 THEN 'contour not assessed by the quality gate' WHEN o_orderkey % 7 = 0 THEN 'contour rejected: open' WHEN o_orderkey % 3 = 0 THEN 'contour not reliable: spread' END AS reason, count(*) AS n FROM orders GROUP BY 1, 2""",
    "edge_clusters": f"WITH {CLUSTERED}, n AS (SELECT label, min(abs(least(x - 1, y))) AS nearest FROM clus WHERE label >= 0 AND NOT (label % 2 = 0 AND (x < 10 OR y < 30)) GROUP BY label) SELECT label, round(nearest, 6) AS nearest, nearest <= 5 AND (SELECT avg((nearest <= 5)::INT) FROM n) <= 0.6 AS touches FROM n",
    "kept_labels": f"WITH {CLUSTERED} SELECT DISTINCT label FROM clus WHERE label >= 0 AND label NOT IN (SELECT label FROM clus WHERE x = 50 AND y = 0)",
    "frame_spread": f"WITH {CLUSTERED}, w AS (SELECT label, least(floor(frame / {FRAMES / 20}), 19) AS k, count(*) AS n, sum(frame) AS f FROM clus WHERE label >= 0 GROUP BY ALL), c AS (SELECT label, sum(f) / sum(n) / {FRAMES} AS m, max(n) / sum(n) AS s FROM w GROUP BY label) SELECT label, round(m, 6) AS mean_fraction, round(s, 6) AS window_share, m BETWEEN 0.2 AND 0.8 AND s <= 0.8 AS passed FROM c",
    "identities": f"WITH {_PATHS} SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'KO' ELSE '' END AS genotype, nullif(regexp_extract(path, '(?i)animal[_ -]?(\\d+)', 1), '') AS animal, nullif(regexp_extract(path, '(?i)roi[_ -]?(\\d+)', 1), '') AS roi, nullif(regexp_extract(path, '(?i)axon[_ -]?(\\d+)', 1), '') AS axon FROM paths",
    "trace_labels": f"WITH {_PATHS} SELECT o_orderkey, strftime(o_orderdate, '%y.%m.%d') AS date, strftime(o_orderdate, '%y') || '.' || (o_orderkey % 4) || '.' || CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 6)::VARCHAR ELSE 'NA' END AS label FROM orders",
    "side_files": f"WITH {_PATHS} SELECT o_orderkey, left(path, length(path) - 5) || '.yaml' AS side FROM paths",
    "genotypes": "SELECT CASE c_custkey % 4 WHEN 0 THEN 'WT' WHEN 1 THEN 'KO' WHEN 2 THEN 'Het' ELSE '' END AS genotype, count(*) AS n FROM customer GROUP BY 1",
    "cluster_keys": "SELECT p_partkey, 'r' || (p_size % 5) || '_l' || p_partkey || '_x' || round_even(p_retailprice, 0)::BIGINT || '_y' || round_even(-p_size / 4.0::DOUBLE, 0)::BIGINT AS key FROM part",
    "guide_cells": "SELECT p_partkey, " + " || ';' || ".join(f"printf('%.1f', p_size * {k} / 8::DOUBLE) || ',' || printf('%.1f', p_partkey + {0.25 * k}::DOUBLE)" for k in (1, 2, 3)) + " AS cell, round(" + " + ".join(f"printf('%.1f', p_size * {k} / 8::DOUBLE)::DOUBLE" for k in (1, 2, 3)) + ", 6) AS sum_x FROM part",
    "pair_keys": "WITH p AS (SELECT p_partkey, p_size, list_sort([{'a': p_size % 7, 'b': p_size}, {'a': p_size % 3, 'b': p_size % 11}]) AS l FROM part) SELECT p_partkey, (p_size % 9) || '|' || l[1].a || '-' || l[1].b || ',' || l[2].a || '-' || l[2].b AS key, (p_size % 9)::INT AS n, l[1].a::INT AS first_a FROM p",
    "column_units": "WITH n AS (SELECT ['x_nm', 'area_nm2', 'area_nm2_discard', 'length_um', 'share_empty', 'fraction_kept', 'occupancy_percent', 'turn_deg', 'n_locs', 'pixel_px', 'hull_um2'] AS l, ['nm', 'nm^2', 'nm^2', 'um', 'fraction (0-1)', 'fraction (0-1)', '%', 'degrees', '', 'pixels', 'um^2'] AS u) SELECT l[p_partkey % 11 + 1] AS name, u[p_partkey % 11 + 1] AS unit, count(*) AS n FROM part, n GROUP BY 1, 2",
    "typed_cells": "SELECT CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'NA' END AS cell, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS back, count(*) AS n, sum(CASE WHEN p_size % 5 < 2 THEN -1 ELSE p_size END::DOUBLE) AS total FROM part GROUP BY 1, 2",
    "durations": f"""SELECT p_partkey, CASE WHEN greatest({_S}, 0) < 90 THEN round_even(greatest({_S}, 0), 0)::BIGINT || ' s' WHEN {_S} < 5400 THEN round_even({_S} / 60, 0)::BIGINT || ' min' ELSE printf('%.1f', {_S} / 3600) || ' h' END AS words,
CASE WHEN p_size / 50.5::DOUBLE >= 0.02 AND p_size / 50.5::DOUBLE < 1 AND p_retailprice / 3 >= 10 THEN CASE WHEN {_LEFT} < 90 THEN 'about ' || greatest(round_even({_LEFT} / 5, 0)::BIGINT * 5, 5) || ' s left' WHEN {_LEFT} < 5400 THEN 'about ' || round_even({_LEFT} / 60, 0)::BIGINT || ' min left' ELSE 'about ' || printf('%.1f', {_LEFT} / 3600) || ' h left' END ELSE '' END AS left FROM part""",
}

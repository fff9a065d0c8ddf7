import math
import random

import numpy as np
from pyspark.sql import functions as F

from locusframe.functions import texts
from locusframe.operators import decisions, labels, neighbours, paint, result_tables, shapes, slices, statistics


def _locs(n, seed):
    rng = random.Random(seed)
    return [(i, i % 2, rng.randrange(60), rng.gauss(rng.choice([0, 8]), 1.5), rng.gauss(0, 1.5)) for i in range(n)]


def _chains(locs, radius, dark):
    order = sorted(locs, key=lambda r: (r[2], r[0]))
    event = {}
    for i, first in enumerate(order):
        if first[0] in event:
            continue
        event[first[0]], last = first[0], first
        while True:
            ahead = [r for r in order if r[0] not in event and r[1] == last[1] and last[2] < r[2] <= last[2] + dark + 1 and (r[3] - last[3]) ** 2 + (r[4] - last[4]) ** 2 <= radius**2]
            if not ahead:
                break
            last = ahead[0]
            event[last[0]] = first[0]
    return event


def test_linking_against_the_plain_rule(spark):
    locs = _locs(160, 4)
    df = spark.createDataFrame([*locs, (999, 0, 3, None, 1.0)], "id long, grp int, frame long, x double, y double")
    assert {r.id: r.event for r in paint.link(df, 1.2, 2).collect()} == _chains(locs, 1.2, 2)


def test_events_weigh_by_precision(spark):
    rows = [(1, "a", 2, 0.0, 0.0, 0.0, 1.0, 5.0), (1, "a", 3, 3.0, 0.0, 0.0, 2.0, 6.0), (1, "a", 4, 100.0, 0.0, 0.0, 0.0, 7.0), (2, "a", 1, 1.0, 1.0, 1.0, None, 8.0), (3, "a", 0, 1.0, 1.0, 1.0, 1.0, 8.0)]
    df = spark.createDataFrame(rows, "event long, grp string, frame long, x double, y double, z double, lp double, photons double")
    got = {r.event: r for r in paint.weighted_events(df, 10).collect()}
    assert set(got) == {1, 3} and math.isclose(got[1].x, 0.75 / 1.25) and (got[1].n_locs, got[1].length, got[1].photons, got[1].whole) == (3, 3, 18.0, True) and not got[3].whole


def test_hulls_against_all_edges(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(4) for _ in range(3 + 20 * k)] + [(9, 1.0, 1.0), (9, 2.0, 2.0), (9, 3.0, 3.0), (8, 1.0, 1.0), (-1, 0.0, 0.0)]
    got = {r.label: r for r in shapes.cluster_areas(spark.createDataFrame(rows, "label int, x double, y double").repartition(3)).collect()}
    for k in range(4):
        pts = [r[1:] for r in rows if r[0] == k]
        edges = [(a, b) for a in pts for b in pts if a != b and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for p in pts)]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in edges) / 2
        assert math.isclose(got[k].hull_area, area, rel_tol=1e-9) and math.isclose(got[k].r_eff, math.sqrt(area / math.pi)) and got[k].n == len(pts)
    assert got[9].hull_area == 0 and got[8].hull_area == 0 and -1 not in got


def test_axis_turn_and_back(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    axis = (1.0, 2.0, -1.0)
    there = df.select(*shapes.rigid("x", "y", "z", axis, 0.7, (1.0, 1.0, 1.0)))
    assert np.allclose(there.select(*shapes.rigid("x", "y", "z", axis, -0.7, (1.0, 1.0, 1.0))).first(), (1.0, 2.0, 3.0))


def test_nearest_reaches_far_points_and_leaves_out_those_without_a_place(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1e12, 0.0), (4, None, 0.0)], "id long, x double, y double")
    got = {r.id: r.other for r in neighbours.nearest(pts, 1, 0.5).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_null_keys_and_one_sided_records(spark):
    old, new = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int"), spark.createDataFrame([(None, 9)], "k int, v int")
    assert sorted(map(tuple, result_tables.upsert(old, new, ["k"]).collect()), key=str) == [(2, 2), (None, 9)]
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "key int, f string"), spark.createDataFrame([(2, None), (3, "y")], "key int, f string")
    assert sorted(map(tuple, decisions.record_differences(a, b, ["f"]).collect())) == [(1, "key", "1", None), (3, "key", None, "3")]


def test_running_sums_over_ranges(spark):
    rows = statistics.in_ranges(spark.range(100).withColumn("v", F.col("id") % 7).repartition(5), "id")
    got = {r.id: (r.s, r.s_all) for r in statistics.running(rows, "id", {"s": "v"}).collect()}
    assert all(got[i] == (sum(k % 7 for k in range(i + 1)), sum(k % 7 for k in range(100))) for i in range(100))


def test_slices_and_ties_of_slabs(spark):
    df = spark.createDataFrame([(z,) for z in (9.9, 10.0, 20.0, 39.9, 40.0)], "z double")
    assert [r[0] for r in df.select(slices.slice_of(F.col("z"), 25.0, 10.0)).collect()] == [slices.OUTSIDE, -1, 0, 1, slices.OUTSIDE]
    assert [r[0] for r in df.select(slices.slab_index(F.col("z"), [(0.0, 20.0, 10.0), (10.0, 30.0, 20.0)])).collect()] == [0, 0, 1, -1, -1]


def test_texts(spark):
    r = spark.range(1).select(texts.duration(F.lit(5399.0)), texts.duration(F.lit(7200.0)), texts.time_left(F.lit(0.5), F.lit(100.0)), texts.date_of(F.lit("/240230/241301_a.csv")), texts.date_of(F.lit("/x/20240229_a.csv")), texts.unit_of(F.lit("area_um2_discard"))).first()
    assert tuple(r) == ("90 min", "2.0 h", "about 2 min left", None, "24.02.29", "um^2")


def test_angles_meet_over_the_origin(spark):
    a, b = spark.createDataFrame([("g", 1, 359.0), ("g", 2, 90.0), ("h", 3, 5.0)], "grp string, id long, turn double"), spark.createDataFrame([("g", 2.0), ("g", 200.0)], "grp string, turn double")
    assert sorted(map(tuple, labels.nearest_angle(a, b).collect())) == [("g", 1, 3.0), ("g", 2, 88.0)]


def test_values_that_are_no_numbers_do_not_count(spark):
    rng = random.Random(8)
    rows = [(g, rng.gauss(10 * (i % 2), 2)) for g in (1, 2) for i in range(300)]
    odd = [(1, float("nan")), (1, float("inf")), (2, float("-inf")), (2, None), (3, float("nan"))]
    clean, mixed = (spark.createDataFrame(x, "grp int, value double") for x in (rows, rows + odd))
    assert sorted(slices.otsu(mixed).collect()) == sorted(slices.otsu(clean).collect()) and slices.otsu(clean).count() == 2
    cut = lambda df: sorted(slices.edge_truncation(df.withColumnRenamed("value", "z"), 1.5, 0.3, 5).collect())
    assert cut(mixed) == cut(clean) and len(cut(clean)) == 4

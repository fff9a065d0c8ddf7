"""Queries on tables whose many rows share few places; pairs of rows would take hours."""

import math
import threading
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe import catalog
from locusframe.operators import clusters, hierarchy, labels, matching, neighbours, paint, persistence

COPIES, STEP = 30_000, 5.0


@contextmanager
def within(spark, seconds=60):
    """Jobs that go on for longer are ended, and with them the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def asked(spark, folder, name):
    with within(spark):
        return catalog.queries()[name](spark, str(folder)).collect()


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Parts at four places of a line, 30,000 at each, and five parts by themselves."""
    made = tmp_path_factory.mktemp("parts")
    i = np.arange(4 * COPIES)
    many = pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + STEP * (i % 4), "p_size": 1})
    few = pd.DataFrame({"p_partkey": len(i) + np.arange(5), "p_retailprice": 2000.0, "p_size": np.arange(1, 6)})
    pd.concat([many, few]).astype({"p_size": "int32"}).to_parquet(made / "part.parquet")
    return made


def test_nearest_angles_of_one_group(spark, tmp_path):
    """Angles of 200,000 rows of one label in turn: even ids a quarter of a step before odd ones."""
    n = 100_000
    i = np.arange(n)
    step = 360 / n
    rows = pd.DataFrame({"l_orderkey": np.r_[i, i], "l_linenumber": np.r_[np.zeros(n), np.ones(n)].astype("int32"), "l_extendedprice": 7 * np.r_[i * step, (i + 0.25) * step], "l_partkey": 5})
    rows.assign(l_quantity=1.0, l_discount=0.0, l_tax=0.0, l_returnflag="A").to_parquet(tmp_path / "lineitem.parquet")
    got = asked(spark, tmp_path, "nearest_angles")
    assert len(got) == n and {r.grp for r in got} == {4} and {r.offset for r in got} == {round(0.25 * step, 5)}


def test_angles_over_the_ends_of_ranges(spark):
    rng = np.random.default_rng(5)
    a = [(g, int(i), float(t)) for g in "uv" for i, t in enumerate(rng.integers(0, 360, 60))]
    b = [("u", float(t)) for t in rng.integers(0, 360, 25)] + [("v", 359.0)]
    want = {(g, i): min(min(abs(t - s), 360 - abs(t - s)) for h, s in b if h == g) for g, i, t in a}
    got = labels.nearest_angle(spark.createDataFrame(a, "grp string, id long, turn double"), spark.createDataFrame(b, "grp string, turn double"))
    assert {(r.grp, r.id): r.offset for r in got.collect()} == want


def test_neighbour_count_of_copies(spark, parts):
    got = {r.id: r.n for r in asked(spark, parts, "neighbour_count")}
    assert len(got) == 4 * COPIES + 5
    assert {(i % 4, n) for i, n in got.items() if i < 4 * COPIES} == {(0, 3 * COPIES), (1, 4 * COPIES), (2, 4 * COPIES), (3, 3 * COPIES)}
    assert [got[4 * COPIES + k] for k in range(5)] == [2, 3, 3, 3, 2]


def test_counts_within_of_copies(spark, parts):
    (got,) = asked(spark, parts, "counts_within")
    n = 4 * COPIES + 5
    assert got.n_points == n and got.mean == round((14 * COPIES * COPIES + 13) / n, 6) and got["median"] == 3 * COPIES


def test_core_flags_of_copies(spark, parts):
    got = {r.id: r.core for r in asked(spark, parts, "dbscan_core_flags")}
    assert len(got) == 4 * COPIES + 5 and all(core == (i < 4 * COPIES) for i, core in got.items())


def test_knn_3_of_copies(spark, parts):
    got = {}
    for r in asked(spark, parts, "knn_3"):
        got.setdefault(r.id, {})[r["rank"]] = (r.other, r.d)
    for i in range(4 * COPIES):
        first = [j for j in range(i % 4, 17, 4) if j != i][:3]
        assert got[i] == {k + 1: (j, 0.0) for k, j in enumerate(first)}
    end = 4 * COPIES
    assert got[end] == {1: (end + 1, 10.0), 2: (end + 2, 20.0), 3: (end + 3, 30.0)} and got[end + 2] == {1: (end + 1, 10.0), 2: (end + 3, 10.0), 3: (end, 20.0)}


def test_nearest_of_points_that_share_places_in_part(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 7, (120, 2)))]
    want = {(i, k + 1): (j, d) for i, a, b in pts for k, (d, j) in enumerate(sorted((math.dist((a, b), (x, y)), j) for j, x, y in pts if j != i)[:5])}
    found = neighbours.nearest(spark.createDataFrame(pts, "id long, x double, y double"), 5, 0.3).collect()
    assert {(r.id, r["rank"]): (r.other, r.d) for r in found} == want and len(found) == len(want)


def test_k_distance_of_copies(spark, parts):
    (got,) = asked(spark, parts, "k_distance")
    assert (got["median"], got.eps, got.largest) == (0.0, 0.0, 30.0)


def test_knn_density_of_copies(spark, parts):
    got = {r.id: r.density for r in asked(spark, parts, "knn_density")}
    end = 4 * COPIES
    # No distance at all counts as the least there is, 20 from the middle one of the five.
    assert {got[i] for i in range(end)} == {got[end + 2]} == {round(4 / (math.pi * 400), 9)} and got[end] == round(4 / (math.pi * 1600), 9)


def test_mutual_neighbours_of_copies(spark, parts):
    end = 4 * COPIES
    got = sorted((r.a, r.b, r.d) for r in asked(spark, parts, "mutual_neighbours"))
    assert got == [(i, i + 4, 0.0) for i in range(4)] + [(end, end + 1, 10.0)]


def test_neighbour_summary_of_copies(spark, parts):
    (got,) = asked(spark, parts, "neighbour_summary")
    assert tuple(got[c] for c in ("n", "least", "q1", "median", "q3")) == (4 * COPIES + 5, 0.0, 0.0, 0.0, 0.0)


def test_neighbour_degrees_of_copies(spark, parts):
    """All of a place are linked to its first four, and these to the fifth."""
    got = {r.degree: r.n for r in asked(spark, parts, "neighbour_degrees")}
    assert got == {COPIES - 1: 16, 4: 4 * (COPIES - 4) + 5}


def test_kernel_density_of_copies(spark, parts):
    got = {r.id: r.density for r in asked(spark, parts, "kernel_density")}
    kernel = lambda d: math.exp(-0.5 * (d / 6) ** 2) / (2 * math.pi * 36)
    want = [COPIES * sum(kernel(STEP * (p - q)) for q in range(4)) for p in range(4)]
    assert len(got) == 4 * COPIES + 5 and all(abs(got[i] - want[i % 4]) < 1e-8 for i in range(4 * COPIES))


def test_dbscan_of_copies(spark, parts):
    got = {r.id: (r.core, r.label) for r in asked(spark, parts, "dbscan")}
    assert len(got) == 4 * COPIES + 5 and all(v == ((True, 0) if i < 4 * COPIES else (False, -1)) for i, v in got.items())


def test_borders_and_points_without_a_place(spark):
    """A border of two clusters joins the lower one; copies make a place core."""
    pts = [(i, 0.0, 0.0) for i in (10, 11, 12)] + [(i, 3.0, 0.0) for i in (5, 6, 7)] + [(1, 1.5, 0.0), (2, None, 0.0), (3, float("nan"), 0.0)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: (r.core, r.label) for r in clusters.dbscan(points.where("id <> 1"), 1.6, 3).collect()}
    assert got == {10: (True, 1), 11: (True, 1), 12: (True, 1), 5: (True, 0), 6: (True, 0), 7: (True, 0), 2: (False, -1), 3: (False, -1)}
    got = {r.id: (r.core, r.label) for r in clusters.dbscan(points.where("id not in (6, 12)"), 1.6, 5).collect()}
    assert got[1] == (True, 0) and {got[i] for i in (5, 7, 10, 11)} == {(False, 0)}
    assert {r.id: r.label for r in clusters.single_linkage(points, 1.4, 3).collect()} == {1: -1, 2: -1, 3: -1, 5: 0, 6: 0, 7: 0, 10: 1, 11: 1, 12: 1}


def test_cluster_centroids_of_copies(spark, parts):
    (got,) = asked(spark, parts, "cluster_centroids")
    n = 4 * COPIES
    assert (got.label, got.n, got.cx, got.cy) == (0, n, 907.5, 10.0) and abs(got.spread - math.sqrt(31.25 * n / (n - 1))) < 1e-5


def test_single_linkage_of_copies(spark, parts):
    got = {r.id: r.label for r in asked(spark, parts, "single_linkage")}
    assert len(got) == 4 * COPIES + 5 and all(label == (0 if i < 4 * COPIES else -1) for i, label in got.items())


def test_ripley_k_of_copies(spark, parts):
    n, area, square = 4 * COPIES + 5, 1100.0 * 40, COPIES * COPIES
    own = 4 * COPIES * (COPIES - 1)
    pairs = {5.0: own + 6 * square, 10.0: own + 10 * square + 8, 20.0: own + 12 * square + 14}
    got = {r.r: r.k for r in asked(spark, parts, "ripley_k")}
    assert got.keys() == pairs.keys() and all(math.isclose(got[r], area / (n * (n - 1)) * pairs[r], rel_tol=1e-9) for r in pairs)


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """200,000 line items of one label at two places, and three that are by themselves."""
    made = tmp_path_factory.mktemp("lines")
    i = np.arange(200_000)
    many = pd.DataFrame({"l_orderkey": i, "l_quantity": 10.0 + 2 * (i % 2), "l_partkey": 5})
    few = pd.DataFrame({"l_orderkey": 300_000 + 50 * np.arange(3), "l_quantity": 30.0 + 10 * np.arange(3), "l_partkey": 6})
    rows = pd.concat([many, few]).assign(l_linenumber=1, l_suppkey=1, l_discount=0.0, l_tax=0.0, l_extendedprice=lambda t: 7.0 * (t.l_orderkey % 40_000) / 200, l_returnflag="A")
    rows.astype({"l_linenumber": "int32"}).to_parquet(made / "lineitem.parquet")
    return made


def test_repeat_fraction_of_copies(spark, lines):
    got = {r.grp: (r.n, r.fraction) for r in asked(spark, lines, "repeat_fraction")}
    assert got == {4: (200_000, 1.0), 5: (3, 0.0)}


def test_repeats_need_the_gap_and_rows_of_one_id_count_together(spark):
    rows = [(1, "a", 0, 0.0, 0.0), (2, "a", 9, 1.0, 0.0), (3, "a", 10, 2.0, 0.0), (4, "a", 50, 9.0, 0.0), (4, "b", 0, 0.0, 0.0), (1, "b", 3, 0.0, 0.0), (5, None, 0, 0.0, 0.0), (6, "b", 900, None, 0.0)]
    locs = spark.createDataFrame(rows, "id long, grp string, frame long, x double, y double")
    assert {r.grp: (r.n, r.fraction) for r in paint.repeat_fraction(locs, 2.0, 10).collect()} == {"a": (4, 0.5), "b": (3, 1 / 3), None: (1, 0.0)}


def test_matched_decisions_of_copies(spark, parts):
    end = 4 * COPIES
    at = lambda i: ((900 + STEP * (i % 4), 10.0) if i < end else (2000.0, 10.0 * (i - end + 1)))
    first, last = {}, {}
    for i in range(end + 5):
        if i % 5 == 0:
            first.setdefault(at(i), i)
        if i % 7 == 0:
            last[at(i)] = i
    near = {}
    for place, i in last.items():
        d, cluster = min((math.dist(place, p), c) for p, c in first.items())
        if d <= 12:
            near[cluster] = max(near.get(cluster, (-1, 0)), (i, d))
    assert {r.cluster: (r.decision, r.d) for r in asked(spark, parts, "matched_decisions")} == near and len(near) >= 4


@pytest.fixture(scope="module")
def suppliers(tmp_path_factory):
    """Suppliers at sixteen places, two groups of eight, 3,000 at each, and one by itself."""
    made = tmp_path_factory.mktemp("suppliers")
    i = np.arange(16 * 3000)
    many = pd.DataFrame({"s_suppkey": i, "s_acctbal": 100.0 * (i % 4) + 5000.0 * (i % 16 // 8), "s_nationkey": i % 8 // 4})
    one = pd.DataFrame({"s_suppkey": [len(i)], "s_acctbal": [20000.0], "s_nationkey": [0]})
    pd.concat([many, one]).astype({"s_nationkey": "int32"}).to_parquet(made / "supplier.parquet")
    return made


def test_spanning_tree_of_copies(spark, suppliers):
    got = sorted((r.w, r.a, r.b) for r in asked(spark, suppliers, "spanning_tree"))
    assert len(got) == 16 * 3000
    assert got[: 16 * 2999] == sorted((0.0, i % 16, i) for i in range(16, 16 * 3000))
    # Along a row 1, from row to row 4, from group to group 47; the far one has a core distance to its second neighbour, a copy of the nearest.
    assert [(w, a, b) for w, a, b in got[16 * 2999 :]] == [(1.0, r + k, r + k + 1) for r in (0, 4, 8, 12) for k in range(3)] + [(4.0, 0, 4), (4.0, 8, 12), (47.0, 3, 8), (147.0, 11, 48000)]


@pytest.mark.parametrize("few", [10_000, 3])
def test_tree_of_copies_against_all_pairs(spark, few, monkeypatch):
    """In one task and in rounds, with places of one, two and more points."""
    monkeypatch.setattr(hierarchy, "FEW", few)
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 5, (30, 2)))]
    cores = {i: sorted(math.dist((a, b), (x, y)) for j, x, y in pts if j != i)[1] for i, a, b in pts}
    above = {i: i for i, *_ in pts}

    def top(x):
        return x if above[x] == x else top(above[x])

    want = []
    for w, i, j in sorted((max(cores[i], cores[j], math.dist((a, b), (x, y))), i, j) for i, a, b in pts for j, x, y in pts if i < j):
        if top(i) != top(j):
            above[top(i)] = top(j)
            want.append((i, j, round(w, 9)))
    found = hierarchy.spanning_tree(hierarchy.core_distances(spark.createDataFrame(pts, "id long, x double, y double"), 2, 1.0)).collect()
    assert sorted((r.a, r.b, round(r.w, 9)) for r in found) == sorted(want) and len({p[1:] for p in pts}) < 24


def test_hdbscan_of_copies(spark, suppliers):
    got = {r.id: (r.label, r.leaves) for r in asked(spark, suppliers, "hdbscan")}
    # Each place is as dense as can be and a cluster of its own; the one by itself is noise.
    assert len(got) == 16 * 3000 + 1 and got[48000][0] == -1
    assert all(got[i] == (i % 16, 1e9) for i in range(48000))


def test_density_basins_of_copies(spark, suppliers):
    """The middle places of a group are equally dense, and the first of them is its peak."""
    got = {r.id: r.peak for r in asked(spark, suppliers, "density_basins")}
    assert len(got) == 48001 and got[48000] == 48000 and all(got[i] == (1 if i % 16 < 8 else 9) for i in range(48000))


def test_persistence_diagram_of_copies(spark, suppliers):
    got = {r.peak: (r.birth, r.death, r.prominence) for r in asked(spark, suppliers, "persistence_diagram")}
    spots = [(x, y) for x in range(4) for y in (0.0, 4.0)]
    top = 3000 * sum(math.exp(-0.5 * (math.dist((1, 0), s) / 9) ** 2) for s in spots) / (2 * math.pi * 81)
    least = 1 / (2 * math.pi * 81)
    assert got.keys() == {1, 9, 48000} and all(v[1] is None for v in got.values())
    assert all(math.isclose(got[p][0], top, abs_tol=1e-8) and math.isclose(got[p][2], top - least, abs_tol=1e-8) for p in (1, 9)) and got[48000][2] == 0.0


def test_tomato_of_copies(spark, suppliers):
    """A group is a cluster by its points, and one point by itself is none."""
    got = {r.id: r.label for r in asked(spark, suppliers, "tomato")}
    assert len(got) == 48001 and got[48000] == -1 and all(got[i] == i % 16 // 8 for i in range(48000))


def test_clusters_by_places_are_those_by_points(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 9, (90, 2)))]
    near = lambda p, q: p != q and math.dist(p[1:], q[1:]) <= 1.5
    f = {p[0]: round(sum(math.exp(-math.dist(p[1:], q[1:]) ** 2) for q in pts), 6) for p in pts}
    first = {}
    for p in pts:
        first.setdefault(p[1:], p[0])
    spots = [p for p in pts if first[p[1:]] == p[0]]
    sides = []
    for some in (pts, spots):
        rows = [(p[0], f[p[0]], sum(q[1:] == p[1:] for q in pts)) for p in some]
        nodes = spark.createDataFrame(rows, "id long, f double, n long")
        graph = spark.createDataFrame([(p[0], q[0]) for p in some for q in some if near(p, q)], "a long, b long")
        found = {r.id: r.label for r in persistence.tomato(nodes if some is spots else nodes.drop("n"), graph, 0.8, 3).collect()}
        sides.append({p[0]: found[p[0] if some is pts else first[p[1:]]] for p in pts})
    assert sides[0] == sides[1] and max(sides[0].values()) >= 2


def test_contours_of_many_orders(spark, tmp_path):
    """Rectangles and triangles of 200,000 orders, and a larger one of ten nodes on a line and back."""
    i = np.arange(200_000)
    corner = lambda n, x, y: pd.DataFrame({"l_orderkey": i, "l_linenumber": n, "l_quantity": x, "l_discount": y})
    rows = pd.concat([corner(1, 0.0, 0.0), corner(2, 30.0, 0.04), corner(3, 30.0, 0.0), corner(4, 0.0, 0.04).iloc[::2], pd.DataFrame({"l_orderkey": 300_000, "l_linenumber": np.arange(10), "l_quantity": np.arange(10.0), "l_discount": 0.0})])
    rows.astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.grp: (r.n, r.length) for r in asked(spark, tmp_path, "contour_tours")}
    assert len(got) == 200_001 and got[300_000] == (10, 18.0)
    assert {got[k] for k in range(0, 200_000, 2)} == {(4, 140.0)} and {got[k] for k in range(1, 200_000, 2)} == {(3, 120.0)}


def test_matched_rings_of_copies(spark, tmp_path):
    """Each ring of a group has as many points as the other, half a step away; the nearest of all pairs is taken for each."""
    i = np.arange(120_000)
    pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + 0.5 * (i // 5 % 2) + 1.0 * (i % 30 // 10), "p_size": 1}).astype({"p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    got = asked(spark, tmp_path, "matched_rings")
    assert len(got) == 60_000 and len({r.a for r in got}) == len({r.b for r in got}) == 60_000 and {r.d for r in got} == {0.5}
    assert all(r.grp == r.a % 5 == r.b % 5 and r.a // 5 % 2 == 0 and r.b // 5 % 2 == 1 for r in got)


def test_transport_is_the_assignment_of_every_copy():
    rng = np.random.default_rng(6)
    for _ in range(300):
        na, nb = rng.integers(1, 5, 2)
        many_a, many_b = ({k: int(v) for k, v in enumerate(rng.integers(1, 5, m))} for m in (na, nb))
        links = [(a, b, float(rng.choice([rng.random() * 9, 1.0, 2.0, 0.0]))) for a in range(na) for b in range(nb) if rng.random() < 0.7]
        cost = {(a, b): d for a, b, d in links}
        flow = matching.transported(links, many_a, many_b)
        ones = matching.assigned([(10 * a + i, 10 * b + j, d) for a, b, d in links for i in range(many_a[a]) for j in range(many_b[b])])
        assert sum(flow.values()) == len(ones) and math.isclose(sum(n * cost[e] for e, n in flow.items()), sum(cost[a // 10, b // 10] for a, b in ones.items()), abs_tol=1e-9)
        for side, many in ((0, many_a), (1, many_b)):
            assert all(sum(n for e, n in flow.items() if e[side] == k) <= most for k, most in many.items())


def test_matched_counts_of_copies(spark, tmp_path):
    """Three of four points are of the first ring, so that a third of them is paired."""
    i = np.arange(40_000)
    i = i[(i // 5 % 2 == 0) | (i % 30 >= 20)]
    pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + 0.5 * (i // 5 % 2), "p_size": 1}).astype({"p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    for r in asked(spark, tmp_path, "matched_counts"):
        n_a, n_b = (sum((i % 5 == r.grp) & (i // 5 % 2 == side)) for side in (0, 1))
        assert (r.n_a, r.n_b, r.n_pairs, r.total, r.share) == (n_a, n_b, min(n_a, n_b), 0.5 * min(n_a, n_b), 1.0) and n_a > 2 * n_b


def test_linked_events_of_many_short_chains(spark, tmp_path):
    """60,000 pairs of localizations, far from each other in time, are events of two."""
    i = np.arange(60_000)
    rows = pd.DataFrame({"l_orderkey": np.r_[100 * i, 100 * i + 3], "l_quantity": np.r_[i % 50, i % 50] + 0.5, "l_linenumber": 1})
    rows.assign(l_partkey=5, l_discount=0.0, l_tax=0.0, l_extendedprice=1.0, l_returnflag="A").astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.id: r.event for r in asked(spark, tmp_path, "linked_events")}
    assert got == {10 * (100 * int(k) + s) + 1: 1000 * int(k) + 1 for k in i for s in (0, 3)}


def test_candidate_links_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    locs = [(i, "ab"[i % 2], int(f), float(x), float(y)) for i, (f, x, y) in enumerate(rng.integers(-40, 40, (400, 3)))]
    want = {(i, j) for i, g, f, x, y in locs for j, h, k, u, v in locs if g == h and f < k <= f + 6 and (x - u) ** 2 + (y - v) ** 2 <= 25}
    found = [tuple(r) for r in paint.candidate_links(spark.createDataFrame(locs, "id long, grp string, frame long, x double, y double"), 5.0, 5).collect()]
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("most", [20_000, 12])
def test_segments_are_chained_as_components_are(spark, most, monkeypatch):
    """Whole segments in a task, and long ones by their components."""
    monkeypatch.setattr(paint, "AT_ONCE", most)
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3], int(f), float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 900, 300), rng.integers(0, 9, 300), rng.integers(0, 9, 300)))]
    locs = spark.createDataFrame([*rows, (900, None, 5, 0.0, 0.0)], "id long, grp string, frame long, x double, y double")
    want = {r.id: r.event for r in paint._chained(locs, 4.0, 5).collect()}
    got = [tuple(r) for r in paint.link(locs, 4.0, 5).collect()]
    assert dict(got) == want and len(got) == len(want) == 301 and len(set(want.values())) < 280

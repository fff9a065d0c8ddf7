import random

from locusframe.operators import clusters, neighbours
from locusframe.operators.circular import circular_runs


def _points(n, seed):
    rng = random.Random(seed)
    return [(i, rng.gauss(rng.choice([0, 30, 60]), 4), rng.gauss(0, 6)) for i in range(n)]


def test_dbscan_against_brute_force(spark):
    pts, eps, least = _points(150, 1), 2.5, 4
    near = {i: [j for j, x, y in pts if ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= eps] for i, a, b in pts}
    core = {i for i in near if len(near[i]) >= least}
    label, n = {}, 0
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = n
                    todo += [j for j in near[k] if j in core]
            n += 1
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in near}
    got = {r.id: r.label for r in clusters.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), eps, least).collect()}
    assert got == want


def test_nearest_finds_far_points_and_breaks_ties_by_id(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 900.0, 0.0)], "id long, x double, y double")
    got = {(r.id, r.rank): r.other for r in neighbours.nearest(pts, 2, 1.0).collect()}
    assert got[(1, 1)] == 2 and got[(1, 2)] == 3 and got[(4, 1)] == 2


def test_circular_runs_wrap_and_whole_circles(spark):
    rows = [("a", i, v) for i, v in enumerate([True, False, False, True, True])] + [("b", i, True) for i in range(5)]
    got = sorted((r.grp, r.filled, r.run_length) for r in circular_runs(spark.createDataFrame(rows, "grp string, bin int, filled boolean"), 5).collect())
    assert got == [("a", False, 2), ("a", True, 3), ("b", True, 5)]


def test_focal_keeps_edge_connected_dense_cells(spark):
    pts = [(i, 5.0 + 10 * (i % 3), 5.0) for i in range(30)] + [(100, 500.0, 500.0)]
    got = {r.id: r.label for r in clusters.focal(spark.createDataFrame(pts, "id long, x double, y double"), 10.0, 5, 2).collect()}
    assert {got[i] for i in range(30)} == {0} and got[100] == -1

import itertools
import math
import random

import numpy as np
import pytest

from locusframe.operators import tessellation, tours
from locusframe.plans import cells_and_tours
from locusframe.sources.tables import sparse_points

from conftest import DATA

POINTS = "id long, x double, y double"
WINDOW = (0.0, 0.0, 40.0, 30.0)


def plain_cell(i, places):
    """The window cut by the half-planes of all other places."""
    corners, sides = np.array([(0, 0), (40, 0), (40, 30), (0, 30)], float), np.full(4, -1)
    for j, q in enumerate(places):
        if j != i:
            normal = q - places[i]
            corners, sides = tessellation.clipped(corners, sides, normal, normal @ (q + places[i]) / 2, j)
    x, y = corners.T
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2, {j for j in sides if j >= 0}


def test_cells_against_all_half_planes(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 8) if i % 3 else rng.uniform(0, 40), rng.uniform(0, 30)) for i in range(120)]
    rows = [*pts, (500, *pts[4][1:]), (501, None, 1.0), (502, 99.0, 1.0)]
    places = np.array([p[1:] for p in pts])
    for tile in (5.0, 50.0):
        got = {(r.x, r.y): r for r in tessellation.voronoi_cells(spark.createDataFrame(rows, POINTS), WINDOW, tile).collect()}
        assert len(got) == 120 and math.isclose(sum(r.area for r in got.values()), 1200.0, rel_tol=1e-9) and got[pts[4][1:]].n == 2
        for i, p in enumerate(places):
            area, near = plain_cell(i, places)
            r = got[tuple(p)]
            assert math.isclose(r.area, area, rel_tol=1e-9) and {tuple(places[j]) for j in near} == set(zip(r.near_x, r.near_y))


def test_dense_cells_are_clusters(spark):
    rng = random.Random(3)
    pts = [(i, rng.gauss(10, 0.6), rng.gauss(10, 0.6)) for i in range(60)] + [(60 + i, rng.gauss(30, 0.6), rng.gauss(20, 0.6)) for i in range(60)] + [(200 + i, rng.uniform(0, 40), rng.uniform(0, 30)) for i in range(40)]
    df = spark.createDataFrame(pts, POINTS)
    got = {r.id: r.label for r in tessellation.voronoi_clusters(df, WINDOW, 10.0, 4.0, 10).collect()}
    assert sum(got[i] == 0 for i in range(60)) > 45 and sum(got[60 + i] == 1 for i in range(60)) > 45 and sum(got[200 + i] < 0 for i in range(40)) > 30 and set(got.values()) == {-1, 0, 1}
    cells = tessellation.voronoi_cells(df, WINDOW, 10.0)
    plain = {(r.x, r.y): r for r in cells.collect()}
    for r in tessellation.cell_densities(cells, 1).collect():
        own = plain[r.x, r.y]
        near = [plain[p] for p in zip(own.near_x, own.near_y)]
        assert math.isclose(r.density, (own.n + sum(q.n for q in near)) / (own.area + sum(q.area for q in near)), rel_tol=1e-9)


def length(pts, path):
    return sum(math.dist(pts[a], pts[b]) for a, b in zip(path, [*path[1:], path[0]]))


def nearest_tour(pts, start):
    left, path = set(pts) - {start}, [start]
    while left:
        path.append(min(left, key=lambda j: math.dist(pts[path[-1]], pts[j])))
        left.discard(path[-1])
    return path


def test_tours_against_enumeration_and_nearest_neighbours(spark):
    rng = random.Random(4)
    small = {g: {i: (rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(8)} for g in range(3)}
    ring = {i: ((30 + 12 * math.sin(3 * t)) * math.cos(t) + rng.gauss(0, 1), (30 + 12 * math.sin(3 * t)) * math.sin(t) + rng.gauss(0, 1)) for i, t in enumerate(rng.sample([2 * math.pi * k / 40 for k in range(40)], 40))}
    cloud = {i: (rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(30)}
    groups = {**small, 10: ring, 11: cloud, 12: {0: (0.0, 0.0), 1: (1.0, 1.0)}}
    rows = [(g, i, *p) for g, pts in groups.items() for i, p in pts.items()] + [(10, 99, None, 0.0)]
    nodes = spark.createDataFrame(rows, "grp long, id long, x double, y double")
    found = tours.contour_tours(nodes)
    got = {r.grp: r for r in found.collect()}
    assert set(got) == {0, 1, 2, 10, 11}
    for g, pts in small.items():
        want = min(length(pts, [0, *p]) for p in itertools.permutations(range(1, 8)))
        assert math.isclose(got[g].length, want, abs_tol=1e-8) and math.isclose(length(pts, got[g].path), want, abs_tol=1e-8)
    for g, pts in ((10, ring), (11, cloud)):
        assert sorted(got[g].path) == sorted(pts) and got[g].path[0] == 0 and got[g].path[1] < got[g].path[-1]
        assert got[g].length <= min(length(pts, nearest_tour(pts, s)) for s in pts) + 1e-9
        assert math.isclose(got[g].length, length(pts, got[g].path), abs_tol=1e-8)
        few = tours.contour_tours(nodes.where(f"grp = {g}"), 3).first().length
        assert few >= got[g].length - 1e-9
    steps = tours.tour_steps(found, nodes).where("grp = 10").orderBy("pos").collect()
    assert [r.id for r in steps] == got[10].path and math.isclose(sum(r.step for r in steps), got[10].length, abs_tol=1e-8)


def test_improvement_leaves_no_crossing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = rng.uniform(0, 1, (14, 2))
        d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
        tour = tours.improved(d, rng.permutation(14))
        assert sorted(tour) == list(range(14))
        for i, j in itertools.combinations(range(14), 2):
            a, b, c, e = tour[i], tour[(i + 1) % 14], tour[j], tour[(j + 1) % 14]
            assert d[a, b] + d[c, e] <= d[a, c] + d[b, e] + 1e-6


def test_queries_cover_the_window_and_all_points(spark):
    cells = cells_and_tours.voronoi_cells(spark, DATA).collect()
    points = sparse_points(spark, DATA)
    x0, y0, x1, y1 = cells_and_tours.WINDOW
    assert sum(r.n for r in cells) == points.count() and math.isclose(sum(r.area for r in cells), (x1 - x0) * (y1 - y0), abs_tol=1e-3)
    labels = cells_and_tours.voronoi_clusters(spark, DATA).collect()
    assert len(labels) == points.count() and {r.label for r in labels} >= {-1}

import random

import pytest

from locusframe.operators import hierarchy


def blobs(n, seed, centres=((0, 0), (30, 5), (60, -10), (34, 14))):
    rng = random.Random(seed)
    pts = [(i, rng.gauss(cx, 2.5), rng.gauss(cy, 2.5)) for i, (cx, cy) in enumerate(rng.choices(centres, k=n - n // 6))]
    return pts + [(len(pts) + i, rng.uniform(-20, 90), rng.uniform(-40, 40)) for i in range(n // 6)]


def weight_table(pts, k):
    d = {(i, j): ((x - a) ** 2 + (y - b) ** 2) ** 0.5 for i, x, y in pts for j, a, b in pts if i != j}
    core = {i: sorted(d[i, j] for j, *_ in pts if j != i)[min(k, len(pts) - 1) - 1] for i, *_ in pts}
    return core, {(i, j): max(core[i], core[j], v) for (i, j), v in d.items() if i < j}


def plain_tree(pts, k):
    core, w = weight_table(pts, k)
    above = {i: i for i, *_ in pts}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    out = []
    for (i, j), v in sorted(w.items(), key=lambda e: (e[1], e[0])):
        if top(i) != top(j):
            above[top(i)] = top(j)
            out.append((i, j, v))
    return out


def plain_labels(pts, least, k):
    """Top-down: cut the heaviest edge, follow the parts that are large enough, choose by stability."""
    tree = plain_tree(pts, k)

    def sides(nodes, edges):
        i, j, w = max(edges, key=lambda e: (e[2], e[0], e[1]))
        rest = [e for e in edges if e != (i, j, w)]
        near = {x: [] for x in nodes}
        for a, b, _ in rest:
            near[a].append(b)
            near[b].append(a)
        part, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()]:
                if y not in part:
                    part.add(y)
                    todo.append(y)
        other = set(nodes) - part
        return w, [(p, [e for e in rest if e[0] in p]) for p in (part, other)]

    def go(nodes, edges, birth):
        start = set(nodes)
        total, size, below = 0.0, len(nodes), []
        while edges:
            w, parts = sides(nodes, edges)
            density = 1 / max(w, hierarchy.NEAREST)
            large = [p for p in parts if len(p[0]) >= least]
            if len(large) == 2:
                total += len(nodes) * density
                below = [go(*p, density) for p in large]
                break
            if not large:
                total += len(nodes) * density
                break
            total += (len(nodes) - len(large[0][0])) * density
            nodes, edges = large[0]
        own, under = total - size * birth, sum(b[0] for b in below)
        chosen = [start] if own >= under else [c for b in below for c in b[1]]
        return max(own, under), chosen, [c for b in below for c in b[1]]

    nodes = {i for i, *_ in pts}
    chosen = go(nodes, tree, 0.0)[2] if len(nodes) >= least else []
    label = {i: -1 for i in nodes}
    for k, c in enumerate(sorted(chosen, key=min)):
        for i in c:
            label[i] = k
    return label


SCHEMA = "id long, x double, y double"


def test_tree_against_all_pairs(spark):
    for pts, k in ((blobs(90, 1), 4), ([(i, float(i % 5), 0.0) for i in range(12)], 2)):
        cores = hierarchy.core_distances(spark.createDataFrame(pts, SCHEMA), k, 1.0)
        assert all(abs(r.core - weight_table(pts, k)[0][r.id]) < 1e-12 for r in cores.collect())
        got = sorted((r.a, r.b, r.w) for r in hierarchy.spanning_tree(cores).collect())
        want = sorted(plain_tree(pts, k))
        assert [e[:2] for e in got] == [e[:2] for e in want] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))


@pytest.mark.parametrize("limit", [500_000, 25])
def test_labels_against_a_plain_version(spark, limit, monkeypatch):
    """Once in one range of weights, and once in many."""
    monkeypatch.setattr(hierarchy, "EDGES", limit)
    pts = blobs(300 if limit > 100 else 90, 7)
    got = {r.id: r.label for r in hierarchy.hdbscan(spark.createDataFrame(pts, SCHEMA), 8, 4, 2.0).collect()}
    want = plain_labels(pts, 8, 4)
    assert got == want and max(want.values()) >= 2 and min(want.values()) == -1


def test_few_equal_and_missing_points(spark):
    pts = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0)]
    assert {r.label for r in hierarchy.hdbscan(spark.createDataFrame(pts, SCHEMA), 3).collect()} == {-1}
    assert hierarchy.hdbscan(spark.createDataFrame([], SCHEMA), 3).collect() == []
    pts = [(i, 0.0 if i < 5 else 50.0, 0.0) for i in range(10)]
    assert {r.id: r.label for r in hierarchy.hdbscan(spark.createDataFrame(pts, SCHEMA), 3).collect()} == {i: int(i >= 5) for i in range(10)}

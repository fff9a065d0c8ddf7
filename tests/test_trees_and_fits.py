"""Persistence, matchings, mixtures, precisions and reassigned marks against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import matching, mixtures, nulls, persistence, precision

NODES, LINKS = "id long, f double", "a long, b long"


def algorithm_1(f, near, tau):
    """Points by falling density: root of each, and death and birth of the peaks."""
    order = sorted(f, key=lambda i: (-f[i], i))
    place = {i: k for k, i in enumerate(order)}
    above, death, peaks = {}, {}, []

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in order:
        higher = sorted((j for j in near[i] if place[j] < place[i]), key=lambda j: place[j])
        if not higher:
            above[i] = i
            peaks.append(i)
            continue
        above[i] = find(higher[0])
        for j in sorted(higher):
            a, b = find(i), find(j)
            if a != b:
                low, high = (a, b) if place[a] > place[b] else (b, a)
                if f[low] - f[i] < tau:
                    above[low] = high
                    death[low] = f[i]
    return {i: find(i) for i in f}, {p: (f[p], death.get(p)) for p in peaks}


def landscape(n, seed):
    rng = random.Random(seed)
    pts = {i: (rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(n)}
    near = {i: [j for j in pts if j != i and math.dist(pts[i], pts[j]) < 1.6] for i in pts}
    f = {i: round(sum(math.exp(-math.dist(pts[i], p) ** 2) for p in pts.values()), 6) for i in pts}
    return f, near


def test_persistence_against_algorithm_1(spark):
    f, near = landscape(160, 5)
    nodes = spark.createDataFrame(list(f.items()), NODES).cache()
    graph = spark.createDataFrame([(i, j) for i in near for j in near[i]], LINKS).cache()
    want_root, want = algorithm_1(f, near, math.inf)
    found = persistence.basins(nodes, graph)
    diagram = persistence.persistence(nodes, graph, found)
    assert {r.peak: (r.birth, r.death) for r in diagram.collect()} == want and len(want) > 8
    sizes = sorted(b - d for b, d in want.values() if d is not None)
    tau = (sizes[len(sizes) // 2] + sizes[len(sizes) // 2 - 1]) / 2
    root, _ = algorithm_1(f, near, tau)
    got = {r.id: r.label for r in persistence.tomato(nodes, graph, tau, 3).collect()}
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    label = {}
    for k, g in enumerate(sorted((g for g in groups.values() if len(g) >= 3), key=min)):
        label |= dict.fromkeys(g, k)
    assert got == {i: label.get(i, -1) for i in f} and max(got.values()) >= 2


def plain_gap(values, least=2.0):
    p = sorted((v for v in values if v > 0), reverse=True)
    if not p:
        return 0.0
    ratios = [a / b for a, b in itertools.pairwise(p)]
    if not ratios or max(ratios) < least:
        return p[-1] / 2
    g = ratios.index(max(ratios))
    return math.sqrt(p[g] * p[g + 1])


def test_widest_gap(spark):
    for values in ([], [3.0], [5.0, 4.0, 0.5, 0.4, 0.0, -1.0], [1.0, 1.2, 1.3], [8.0, 8.0, 2.0, 1.9]):
        got = persistence.widest_gap(spark.createDataFrame([(v,) for v in values], "v double"), "v")
        assert math.isclose(got, plain_gap(values), abs_tol=1e-12)


def enumerated(links):
    """(number of pairs, least total distance) over all matchings."""
    by_a = {}
    for a, b, d in links:
        by_a.setdefault(a, []).append((b, d))

    def go(rest, used):
        if not rest:
            return (0, 0.0)
        a, *rest = rest
        best = go(rest, used)
        for b, d in by_a[a]:
            if b not in used:
                n, t = go(rest, used | {b})
                best = min(best, (n - 1, t + d), key=lambda x: (x[0], x[1]))
        return best

    return go(list(by_a), frozenset())


def test_assignment_against_enumeration():
    rng = random.Random(2)
    for _ in range(400):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        links = [(a, b, rng.choice([rng.random() * 9, 1.0, 0.0])) for a in range(n) for b in range(m) if rng.random() < 0.5]
        got = matching.assigned(links)
        cost = {(a, b): d for a, b, d in links}
        assert len(set(got.values())) == len(got)
        want = enumerated(links)
        assert -len(got) == want[0] and math.isclose(sum(cost[a, b] for a, b in got.items()), want[1], abs_tol=1e-9)


def test_matching_takes_the_pairs_that_greedy_misses(spark):
    schema = "grp string, id long, x double, y double"
    left = [("g", 1, 0.0, 0.0), ("g", 2, 55.0, 0.0), ("g", 3, 110.0, 0.0), ("h", 1, 0.0, 0.0), ("h", 9, 500.0, 0.0), ("h", 8, None, 0.0), (None, 4, 0.0, 0.0)]
    right = [("g", 1, -55.0, 0.0), ("g", 2, 0.0, 0.0), ("g", 3, 55.0, 0.0), ("h", 5, 3.0, 4.0), ("k", 1, 0.0, 0.0)]
    left, right = (spark.createDataFrame(x, schema) for x in (left, right))
    pairs = matching.match(left, right, 60.0)
    assert sorted((r.grp, r.a, r.b, r.d) for r in pairs.collect()) == [("g", 1, 1, 55.0), ("g", 2, 2, 55.0), ("g", 3, 3, 55.0), ("h", 1, 5, 5.0)]
    assert {r.id for r in matching.unmatched(left.where("grp is not null"), pairs, "a").collect()} == {8, 9}
    summary = {r.grp: (r.n_a, r.n_b, r.n_pairs, r.total, r.share) for r in matching.match_summary(left.where("grp is not null"), right, pairs).collect()}
    assert summary == {"g": (3, 3, 3, 165.0, 1.0), "h": (3, 1, 1, 5.0, 1.0), "k": (0, 1, 0, 0.0, None)}


def plain_em(z, k, rounds):
    q = [(2 * j + 1) / (2 * k) for j in range(k)]
    m, s, w = np.quantile(z, q), np.full(k, math.sqrt(z.var() + mixtures.FLOOR)), np.full(k, 1 / k)
    logs = lambda: np.log(w) - np.log(s) - 0.5 * ((z[:, None] - m) / s) ** 2 - 0.5 * math.log(2 * math.pi)
    seen = []
    for _ in range(rounds):
        p = logs()
        total = np.logaddexp.reduce(p, axis=1)
        seen.append(total.sum())
        r = np.exp(p - total[:, None])
        w, m = r.mean(axis=0), (r * z[:, None]).sum(axis=0) / r.sum(axis=0)
        s = np.sqrt((r * (z[:, None] - m) ** 2).sum(axis=0) / r.sum(axis=0) + mixtures.FLOOR)
    return w, m, s, np.logaddexp.reduce(logs(), axis=1).sum(), seen


def test_mixtures_against_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    data = {"one": rng.normal(100, 12, 300), "two": np.concatenate([rng.normal(0, 15, 250), rng.normal(190, 20, 150)]), "few": np.array([5.0, 7.0])}
    rows = [(g, float(v)) for g, z in data.items() for v in z] + [("one", None), (None, 1.0), ("two", float("nan")), ("two", float("inf"))]
    values = spark.createDataFrame(rows, "grp string, z double")
    fits = mixtures.fit(values, [1, 2, 3], 1e-7, 25)
    got = {(r.grp, r.k): r for r in fits.collect()}
    assert set(got) == {(g, k) for g in ("one", "two") for k in (1, 2, 3)} | {("few", 1), ("few", 2)}
    for (g, k), r in got.items():
        w, m, s, loglik, seen = plain_em(data[g], k, r.rounds)
        assert all(b >= a - 1e-7 for a, b in itertools.pairwise(seen)) and (r.converged or r.rounds == 25)
        if g != "few":
            assert np.allclose([r[f"{c}{j}"] for j in range(k) for c in "wms"], [x for j in range(k) for x in (w[j], m[j], s[j])], rtol=1e-6)
            assert math.isclose(r.loglik, loglik, rel_tol=1e-9) and math.isclose(r.bic, -2 * loglik + (3 * k - 1) * math.log(len(data[g])), rel_tol=1e-9)
    best = mixtures.best_by_bic(fits.where("grp = 'two'"))
    parts = mixtures.parts_of(best)
    step = mixtures.periods(parts).first()
    assert abs(step.mean_step - 190) < 8 and step.n_parts == 2 and step.se_step is None
    peak = mixtures.main_peaks(best, values, parts).first()
    assert abs(peak.by_density) < 5 and abs(peak.by_weight) < 5
    low = mixtures.valleys(best, parts).first()
    assert 40 < low.z < 140 and low.depth < 0.2


@pytest.mark.parametrize(("nearby", "share"), [(False, 1.0), (True, 0.8)])
def test_precision_is_recovered(nearby, share):
    rng = np.random.default_rng(6)
    s, reach = 6.0, 120.0
    d = np.hypot(rng.normal(0, s * math.sqrt(2), 40_000), rng.normal(0, s * math.sqrt(2), 40_000))
    if nearby:
        other = rng.normal(60, 20, 12_000)
        d = np.concatenate([d[:32_000], other[(other > 0)][:8_000]])
    n = np.histogram(d[d < reach], bins=precision.BINS, range=(0, reach))[0].astype(float)
    found = precision.fitted(n, reach)
    assert abs(found["precision"] / s - 1) < 0.02 and found["nearby"] == nearby and abs(found["share"] - share) < 0.03 and found["peak"]
    assert found["low"] < found["precision"] < found["high"] and found["high"] - found["low"] < 0.3


def test_precision_of_groups(spark):
    rng = np.random.default_rng(8)
    rows, key = [], 0
    for grp, s in (("a", 5.0), ("b", 9.0)):
        for m in range(150):
            x, y = rng.uniform(0, 20_000, 2)
            for frame in range(4):
                rows.append((key, grp, frame, float(x + rng.normal(0, s)), float(y + rng.normal(0, s))))
                key += 1
    rows += [(key + i, "c", 2 * i, 0.0, 0.0) for i in range(5)] + [(key + 9, "d", 0, 0.0, 0.0), (key + 10, "d", 1, 1.0, 0.0)]
    got = {r.grp: r for r in precision.movie_precision(spark.createDataFrame(rows, "id long, grp string, frame long, x double, y double"), 120.0).collect()}
    assert set(got) == {"a", "b", "d"} and abs(got["a"].precision - 5) < 0.4 and abs(got["b"].precision - 9) < 0.7
    assert got["d"].n_pairs == 1 and got["d"].precision is None


def test_replicates_deal_every_mark_once(spark):
    rows = spark.createDataFrame([("g", i, float(i * i)) for i in range(9)] + [("h", i, 1.0) for i in range(3)], "grp string, key long, v double")
    got = nulls.permuted(rows, "v", 4, 1).collect()
    for grp, values in (("g", [float(i * i) for i in range(9)]), ("h", [1.0] * 3)):
        for rep in range(1, 5):
            mine = sorted((r.key, r.moved) for r in got if r.grp == grp and r.replicate == rep)
            assert [k for k, _ in mine] == list(range(len(values))) and sorted(v for _, v in mine) == values
    orders = {tuple(r.moved for r in sorted((r for r in got if r.grp == "g" and r.replicate == rep), key=lambda r: r.key)) for rep in range(1, 5)}
    assert len(orders) == 4


def test_p_is_uniform_without_an_effect_and_small_with_one(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.random(), rng.random()) for g in range(120) for i in range(8)]
    rows += [(1000, i, float(i), i + rng.random()) for i in range(12)] + [(1001, i, 1.0, float(i)) for i in range(8)] + [(1002, 1, 1.0, 2.0), (1003, 1, None, 2.0)]
    got = {r.grp: r for r in nulls.mark_permutation(spark.createDataFrame(rows, "grp long, key long, a double, b double"), 19, 3).collect()}
    p = np.array([got[g].p for g in range(120)])
    assert abs(p.mean() - 0.525) < 0.09 and (p <= 0.05).mean() < 0.13 and got[1000].p == 0.05 and got[1000].rho > 0.95
    assert got[1001].rho is None and got[1002].p is None and 1003 not in got


def test_envelopes_and_ranks_of_curves(spark):
    rng = random.Random(9)
    rows = [("g", r, at, rng.random() + (5.0 if r == 0 and at == 3 else 0.0)) for r in range(20) for at in range(6)]
    rows += [("h", r, at, float(r)) for r in range(5) for at in range(2)]
    curves = spark.createDataFrame(rows, "grp string, replicate int, at int, value double")
    outside = {(r.grp, r["at"]): r.outside for r in nulls.envelope(curves, 19).collect()}
    assert outside["g", 3] and outside["h", 0]
    assert {r.grp: round(r.rank_p, 6) for r in nulls.global_rank(curves).collect()}["h"] == 0.4
    place = {}
    for g, r, at, v in rows:
        place.setdefault((g, at), []).append(v)
    depth = {}
    for g, r, at, v in rows:
        c = place[g, at]
        depth[g, r] = min(depth.get((g, r), 99), sum(x <= v for x in c if x < v) + 1, sum(x > v for x in c) + 1)
    want = {g: np.mean([d <= depth[g, 0] for (k, r), d in depth.items() if k == g]) for g in "gh"}
    assert {r.grp: r.rank_p for r in nulls.global_rank(curves).collect()} == want

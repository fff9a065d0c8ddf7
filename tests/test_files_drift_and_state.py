"""Region and metadata files, residual drift, and streams with state of their own."""

import json
import math
import random

import pytest

from locusframe.operators import drift
from locusframe.sources import regions
from locusframe.streaming import state


def files(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.yaml").write_text(text)
    return str(folder)


def test_regions_of_a_folder(spark, tmp_path):
    path = files(
        tmp_path,
        poly=json.dumps({"Shape": "Polygon", "Vertices": [[[0, 0], [10, 0], [10, 10], [5, 5], [0, 10], [0, 0]], [[50, 50], [60, 50], [60, 60]]]}),
        circle=json.dumps({"Centers": [[20, 20], [40, 20]], "Diameter": 6}),
        square=json.dumps({"Shape": "Square", "Centers": [[-10, -10]], "Side Length (nm)": 400}),
        rect=json.dumps({"Shape": "Rectangle", "Center-Axis-Points": [[[0, 30], [4, 33]]], "Width": 5}),
        bad="{", other=json.dumps({"Frames": 3}), empty=json.dumps({"Shape": "Polygon", "Vertices": []}),
    )
    found = regions.read_regions(spark, path, 100.0)
    rows = {(r.file.rsplit("/", 1)[1], r.region): r for r in found.collect()}
    assert {f for (f, i), r in rows.items() if r.error} == {"bad.yaml", "other.yaml", "empty.yaml"} and len(rows) == 9
    assert rows["circle.yaml", 1].radius == 3 and rows["square.yaml", 0].xs == [-12, -8, -8, -12] and not rows["poly.yaml", 1].closed
    rect = list(zip(rows["rect.yaml", 0].xs, rows["rect.yaml", 0].ys))
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(rect, rect[1:] + rect[:1]))) / 2
    assert math.isclose(area, 25.0) and math.isclose(sum(p[0] for p in rect) / 4, 2) and math.isclose(sum(p[1] for p in rect) / 4, 31.5)
    pts = [(1, 5.0, 2.0), (2, 5.0, 8.0), (3, 22.9, 20.0), (4, 23.0, 20.0), (5, -9.0, -9.0), (6, 2.0, 31.5), (7, 55.0, 52.0), (8, None, 1.0), (9, 5.0, -0.5)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    inside = lambda t: sorted((r.id, r.file.rsplit("/", 1)[1], r.region) for r in regions.inside_regions(points, found, 7.0, t).collect())
    assert inside(0.0) == [(1, "poly.yaml", 0), (3, "circle.yaml", 0), (5, "square.yaml", 0), (6, "rect.yaml", 0)]
    assert set(inside(1.0)) - set(inside(0.0)) == {(4, "circle.yaml", 0), (9, "poly.yaml", 0)}
    assert {r.error is None for r in regions.read_regions(spark, path).where("file like '%square%'").collect()} == {False}


def test_metadata_of_a_folder(spark, tmp_path):
    pytest.importorskip("yaml")
    path = files(tmp_path, a="Generated by: Localize\nPixelsize: 130\nBox Size: 7\n---\nGenerated by: Filter\nBox Size: 0\nPixelsize: null\n", b="Pixelsize: 108.5\nbroken: [\n", c="- just\n- a list\n")
    rows = regions.read_metadata(spark, path).cache()
    assert {r.file[-6:]: r.pixel_nm for r in regions.pixel_sizes(rows).collect()} == {"a.yaml": 130.0, "b.yaml": 108.5}
    new = {r.file[-6:]: (r["Generated by"], r["Box Size"]) for r in regions.newest(rows, "Generated by", "Box Size").collect()}
    assert new["a.yaml"] == ('"Filter"', "0") and rows.where("error is not null").count() == 1


def test_planted_drift_is_found(spark):
    rng = random.Random(3)
    places = [rng.uniform(0, 900) for _ in range(40)]
    rows = []
    for frame in range(6000):
        moved = 60 * math.sin(frame / 1500)
        rows += [("drift", frame, rng.choice(places) + moved + rng.gauss(0, 4)), ("still", frame, rng.choice(places) + rng.gauss(0, 4)), ("flat", frame, 5.0)]
    rows += [("short", i, float(i)) for i in range(30)] + [(None, 1, 1.0), ("still", 3, float("nan"))]
    values = spark.createDataFrame(rows, "grp string, frame long, v double")
    shifts = {(r.grp, r.segment): r for r in drift.segment_shifts(drift.segment_profiles(values, 20, 5.0), 5.0, 200.0).collect()}
    base = shifts["drift", 0].fine
    for k in range(20):
        mid = 6000 / 20 * (k + 0.5)
        want = 60 * (math.sin(mid / 1500) - math.sin(150 / 1500))
        assert abs(shifts["drift", k].fine - base - want) < 12
    assert all(abs(shifts["still", k].fine) <= 5 for k in range(20))
    got = {r.grp: r for r in drift.drift_check(values, 20, 5.0, 200.0, 99, 1).collect()}
    assert got["drift"].coherent and got["drift"].acf > 0.6 and got["drift"].p < 0.02 and not got["still"].coherent
    assert (got["flat"].range, got["flat"].acf, got["flat"].p, got["flat"].coherent) == (0.0, 0.0, 1.0, False) and "short" not in got


def test_planted_drift_in_the_plane(spark):
    rng = random.Random(11)
    places = [(rng.uniform(0, 600), rng.uniform(0, 600)) for _ in range(60)]
    move = lambda k: (6.0 * k, 24 * math.sin(k / 3))
    rows = []
    for frame in range(8000):
        (x, y), (a, b) = rng.choice(places), move(frame // 800)
        rows.append(("drift", frame, x + a + rng.gauss(0, 3), y + b + rng.gauss(0, 3)))
        x, y = rng.choice(places)
        rows.append(("still", frame, x + rng.gauss(0, 3), y + rng.gauss(0, 3)))
    rows += [(None, 1, 1.0, 1.0), ("still", 5, float("nan"), 1.0), ("still", 5, 1.0, float("inf")), ("still", None, 1.0, 1.0), ("short", 1, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "grp string, frame long, x double, y double")
    got = {(r.grp, r.segment): r for r in drift.drift_curve(points, 10, 5.0, 60.0).collect()}
    assert len(got) == 20 and all(r.n == 800 for r in got.values())
    first = got["drift", 0]
    for k in range(10):
        a, b = move(k)
        assert abs(got["drift", k].dx - first.dx - a) < 2.5 and abs(got["drift", k].dy - first.dy - b) < 2.5
        assert abs(got["still", k].dx) < 2.5 and abs(got["still", k].dy) < 2.5
    assert drift.drift_curve(points.limit(0), 10, 5.0, 60.0).count() == 0


def test_lags_in_the_plane_against_all(spark):
    rng = random.Random(2)
    rows = [("g", s, rng.randrange(9), rng.randrange(-4, 5), rng.randrange(1, 60)) for s in range(4) for _ in range(12)]
    bins = spark.createDataFrame(rows, "grp string, segment int, bx long, by long, n long").groupBy("grp", "segment", "bx", "by").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    counts = {(r.segment, r.bx, r.by): r.n for r in bins.collect()}
    got = {r.segment: (r.lag_x, r.lag_y) for r in drift.plane_shifts(bins, 2.0, 6.0).collect()}
    for s in range(4):
        score = {(i, j): sum(n * m for (t, x, y), n in counts.items() if t == s for (u, a, b), m in counts.items() if u != s and (a - x, b - y) == (i, j)) for i in range(-3, 4) for j in range(-3, 4)}
        assert got[s] == min(score, key=lambda k: (-score[k], k[0] ** 2 + k[1] ** 2, k))


def test_shifts_against_all_lags(spark):
    rng = random.Random(5)
    rows = [("g", rng.randrange(400), rng.choice([20.0, 50.0, 51.0, 120.0]) + rng.gauss(0, 9)) for _ in range(900)]
    lo, f0, f1 = min(r[2] for r in rows), min(r[1] for r in rows), max(r[1] for r in rows)
    place = lambda r: (min(int((r[1] - f0) * 5.0 / (f1 + 1 - f0)), 4), math.floor((r[2] - lo) / 5.0))
    counts = [{}, {}, {}, {}, {}]
    whole = {}
    for r in rows:
        s, b = place(r)
        counts[s][b] = counts[s].get(b, 0) + 1
        whole[b] = whole.get(b, 0) + 1
    want = {}
    for s in range(5):
        score = {lag: sum(n * whole.get(b + lag, 0) for b, n in counts[s].items()) for lag in range(-10, 11)}
        want[s] = -5.0 * max(score, key=lambda k: (score[k], -k))
    got = drift.segment_shifts(drift.segment_profiles(spark.createDataFrame(rows, "grp string, frame long, v double"), 5, 5.0), 5.0, 50.0).collect()
    assert {r.segment: r.shift for r in got} == want


EVENTS = [("s", 0, 5), ("s", 3, 20), ("s", 10, 12), ("s", 31, 40), ("t", 2, 3), ("s", 45, 50), ("t", 9, 10), ("s", 4, 6)]


def plain_dark(events):
    out, last = {}, {}
    for site, a, b in sorted(events):
        out[site, a] = a - last[site] if site in last and a > last[site] else None
        last[site] = max(last.get(site, b), b)
    return out


def test_dark_times_of_a_stream_that_stops_and_starts_again(spark, tmp_path):
    """Events come out of order, in several files; the query is stopped between them and begun again."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "site string, started timestamp, ended timestamp"

    def add(rows, name):
        df = spark.createDataFrame(rows, "site string, a long, b long").selectExpr("site", "timestamp_seconds(1700000000 + a) as started", "timestamp_seconds(1700000000 + b) as ended")
        df.coalesce(1).write.mode("append").parquet(source)

    def go():
        q = state.write_once(state.dark_times(spark.readStream.schema(schema).parquet(source), "60 seconds"), sink, checkpoint)
        q.processAllAvailable()
        q.stop()

    add(EVENTS[:3], "a")
    go()
    add(EVENTS[3:], "b")
    go()
    add([("s", 500, 501)], "c")
    go()
    add([("z", 2000, 2001)], "d")
    go()
    rows = [(r.site, int(r.started.timestamp()) - 1700000000, r.seconds) for r in spark.read.parquet(sink).collect() if r.site in "st"]
    want = plain_dark([*EVENTS, ("s", 500, 501)])
    assert len(rows) == len(want) and {(s, a): v for s, a, v in rows} == want


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for k in range(2):  # the second run has lost its checkpoint, as after a failure before the commit
        q = state.write_once(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / f"cp{k}"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(sink).count() == 5

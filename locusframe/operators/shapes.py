"""Sizes of clusters: convex hulls, spreads, axes, distances between neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of an (n, 2) array, counter-clockwise from the least; the ends of a line; a single point.

    Between two corners the point farthest outside their chord is a corner as
    well, and splits what is outside in two.
    """
    points = points[np.isfinite(points).all(axis=1)]
    if len(points) < 2:
        return points
    least, most = (points[np.lexsort((k * points[:, 1], k * points[:, 0]))[0]] for k in (1, -1))
    if (least == most).all():
        return least[None]
    corners, chords = [], [(most, least, points), (least, most, points)]
    while chords:
        a, b, near = chords.pop()
        way, rel = b - a, near - a
        side = way[0] * rel[:, 1] - way[1] * rel[:, 0]
        outside = side < 0
        if not outside.any():
            corners.append(a)
            continue
        near, side, along = near[outside], side[outside], (rel @ way)[outside]
        far = near[np.lexsort((along, side))[0]]
        chords += [(far, b, near), (a, far, near)]
    return np.array(corners)


def polygon_area(corners: np.ndarray) -> float:
    """Area of a polygon as the triangles that its sides make with the first corner."""
    rel = corners[1:] - corners[0]
    return abs(sum(float(p[0] * q[1] - p[1] * q[0]) for p, q in zip(rel[:-1], rel[1:], strict=True))) / 2


def hull_corners(points: DataFrame) -> DataFrame:
    """(label, x, y) of the corners of the hull of each cluster of ``points(label, x, y)``; noise is left out.

    Each batch sends only the corners of its own hulls, and a hull of corners
    is the hull of all points, so a task gets few rows even of a cluster that
    holds most of the table.
    """

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        found = [(k, convex_hull(g[["x", "y"]].to_numpy())) for k, g in frame.groupby("label", sort=True)]
        return pd.DataFrame([(k, float(x), float(y)) for k, hull in found for x, y in hull], columns=["label", "x", "y"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield corners(batch)

    kind = points.schema["label"].dataType.simpleString()
    schema = f"label {kind}, x double, y double"
    some = points.where("label >= 0 and x is not null and y is not null and not isnan(x) and not isnan(y)").select("label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return some.mapInPandas(partial, schema).groupBy("label").applyInPandas(corners, schema)


def cluster_areas(points: DataFrame) -> DataFrame:
    """(label, n, hull_area, r_eff) of each cluster: area of the convex hull, 0 for fewer than three points or a line, and the radius of a disc of that area."""

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": frame["label"].iloc[:1], "hull_area": [polygon_area(convex_hull(frame[["x", "y"]].to_numpy()))]})

    kind = points.schema["label"].dataType.simpleString()
    areas = hull_corners(points).groupBy("label").applyInPandas(area, f"label {kind}, hull_area double")
    sizes = points.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(areas, "label", "left").select("label", "n", F.coalesce("hull_area", F.lit(0.0)).alias("hull_area"), F.sqrt(F.coalesce("hull_area", F.lit(0.0)) / F.lit(np.pi)).alias("r_eff"))


def cluster_axes(points: DataFrame) -> DataFrame:
    """(label, n, cx, cy, sd_x, sd_y, major, minor, elongation) from the sample covariance of each cluster."""
    one = points.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    middle, half = (F.col("vx") + F.col("vy")) / 2, F.sqrt((F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")) / 4 + F.col("vxy") * F.col("vxy"))
    axes = one.select("label", "n", "cx", "cy", F.sqrt("vx").alias("sd_x"), F.sqrt("vy").alias("sd_y"), F.sqrt(middle + half).alias("major"), F.sqrt(F.greatest(middle - half, F.lit(0.0))).alias("minor"))
    return axes.withColumn("elongation", F.when(F.col("minor") > 0, F.col("major") / F.col("minor")))


def axial_medians(points: DataFrame) -> DataFrame:
    """(label, n, q1, median, q3) of z of each cluster."""
    q = lambda p: F.percentile("z", F.lit(p))
    return points.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def neighbour_summary(nearest: DataFrame) -> DataFrame:
    """(n, least, q1, median, q3) of first-neighbour distances."""
    q = lambda p: F.percentile("d", F.lit(p))
    return nearest.where("rank = 1").agg(F.count("*").alias("n"), F.min("d").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def counts_within(counts: DataFrame) -> DataFrame:
    """(n, median, mean) of neighbour counts, each point included."""
    return counts.agg(F.count("*").alias("n_points"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"))


def rigid(x: str, y: str, z: str, axis: tuple[float, float, float], angle: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list:
    """x, y, z turned by an angle about an axis through an origin; the inverse is the negative angle."""
    k = np.array(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    turn = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
    moved = [F.col(c) - float(o) for c, o in zip((x, y, z), origin, strict=True)]
    return [(moved[0] * float(r[0]) + moved[1] * float(r[1]) + moved[2] * float(r[2]) + float(o)).alias(c) for r, c, o in zip(turn, (x, y, z), origin, strict=True)]

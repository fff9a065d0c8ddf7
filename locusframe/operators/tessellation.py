"""Voronoi cells of points in a window, tile by tile, and clusters of cells that are small.

A cell starts as the window and is cut by the half-planes of its neighbours,
nearest first, until the next one is more than twice as far as its farthest
corner. A tile knows the points within a halo; cells that could still be cut by
a point beyond it are done again with a wider one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .clusters import components, numbered

_CELLS = "x double, y double, area double, near_x array<double>, near_y array<double>, settled boolean"


def clipped(corners: np.ndarray, sides: np.ndarray, normal: np.ndarray, offset: float, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a convex polygon where ``normal @ p <= offset``; ``sides[i]`` names the edge after corner i, the new one is ``own``."""
    away = corners @ normal - offset
    inside = away <= 0
    if inside.all():
        return corners, sides
    out, names = [], []
    n = len(corners)
    for i in range(n):
        j = (i + 1) % n
        if inside[i]:
            out.append(corners[i])
            names.append(sides[i])
        if inside[i] != inside[j]:
            t = away[i] / (away[i] - away[j])
            out.append(corners[i] + t * (corners[j] - corners[i]))
            names.append(own if inside[i] else sides[i])
    return np.array(out).reshape(-1, 2), np.array(names, np.int64)


def cell_of(place: np.ndarray, others: np.ndarray, window: np.ndarray, seen: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Corners of the cell of a point, the other point behind each of its edges (-1: the window), and whether no point farther than ``seen`` can cut it."""
    corners, sides = window, np.full(len(window), -1)
    away = np.hypot(*(others - place).T)
    far = np.hypot(*(corners - place).T).max()
    for k in np.argsort(away, kind="stable"):
        if away[k] > 2 * far:
            break
        if away[k] == 0:
            continue
        normal = others[k] - place
        cut, sides = clipped(corners, sides, normal, normal @ (others[k] + place) / 2, int(k))
        if cut is not corners:
            corners = cut
            far = np.hypot(*(corners - place).T).max() if len(corners) else 0.0
    return corners, sides, 2 * far <= seen


def voronoi_cells(points: DataFrame, window: tuple[float, float, float, float], tile: float) -> DataFrame:
    """(x, y, n, area, near_x, near_y), stored: the cell of every place of ``points(id, x, y)`` inside the window (x0, y0, x1, y1), and the places behind its edges.

    Equal points share a cell and ``n`` counts them; points without a place,
    or outside of the window, have none. ``tile`` should hold some hundreds of
    points. The halo of a tile starts at a fourth of it and doubles for cells
    that it does not settle, until it spans the window.
    """
    x0, y0, x1, y1 = window
    frame = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    span = float(np.hypot(x1 - x0, y1 - y0))
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    places = stored(inside.groupBy("x", "y").agg(F.count("*").alias("n")), "places")
    at = lambda c, low: F.floor((F.col(c) - low) / tile)
    open_places, parts, halo = places.select("x", "y"), [], tile / 4
    while True:
        asked = open_places.select("x", "y", at("x", x0).alias("tx"), at("y", y0).alias("ty"))
        reach = lambda c, low, k: F.floor((F.col(c) + k * halo - low) / tile)  # noqa: B023, E731
        spread = places.withColumn("tx", F.explode(F.sequence(reach("x", x0, -1), reach("x", x0, 1)))).withColumn("ty", F.explode(F.sequence(reach("y", y0, -1), reach("y", y0, 1)))).select("tx", "ty", "x", "y")
        rows = spread.join(asked.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi").withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
        whole = halo > span

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            known = part.loc[~part["asks"], ["x", "y"]].to_numpy()
            out = []
            for place in part.loc[part["asks"], ["x", "y"]].to_numpy():
                corners, sides, settled = cell_of(place, known, frame, np.inf if whole else halo)  # noqa: B023
                rel = corners - place
                turned = np.roll(rel, -1, axis=0)
                near = known[np.unique(sides[sides >= 0])]
                out.append((*place, float(abs((rel[:, 0] * turned[:, 1] - rel[:, 1] * turned[:, 0]).sum()) / 2), near[:, 0].tolist(), near[:, 1].tolist(), bool(settled)))
            return pd.DataFrame(out, columns=[c.split()[0] for c in _CELLS.split(", ")])

        found = stored(rows.groupBy("tx", "ty").applyInPandas(cut, _CELLS), "cells")
        parts.append(found)
        open_places = found.where("not settled").select("x", "y")
        if whole or not open_places.limit(1).count():
            break
        halo *= 2
    cells = parts[0].where("settled")
    for part in parts[1:]:
        cells = cells.unionByName(part.where("settled"))
    out = stored(cells.drop("settled").join(places, ["x", "y"]).select("x", "y", "n", "area", "near_x", "near_y"), "voronoi-cells")
    discard(places, *parts)
    return out


def cell_densities(cells: DataFrame, rank: int = 0) -> DataFrame:
    """(x, y, n, area, density): points for the area of a cell, or with ``rank`` 1 of the cell and those around it; null for cells without an area."""
    if rank == 0:
        return cells.select("x", "y", "n", "area", F.try_divide(F.col("n"), F.col("area")).alias("density"))
    around = cells.select("x", "y", F.explode(F.arrays_zip(F.col("near_x").alias("px"), F.col("near_y").alias("py"))).alias("p")).select("x", "y", "p.*")
    sums = around.join(cells.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("n").alias("pn"), F.col("area").alias("pa")), ["px", "py"]).groupBy("x", "y").agg(F.sum("pn").alias("pn"), F.sum("pa").alias("pa"))
    own = cells.join(sums, ["x", "y"], "left").fillna(0, ["pn"]).fillna(0.0, ["pa"])
    return own.select("x", "y", "n", "area", F.try_divide(F.col("n") + F.col("pn"), F.col("area") + F.col("pa")).alias("density"))


def voronoi_clusters(points: DataFrame, window: tuple[float, float, float, float], tile: float, factor: float, least: int, rank: int = 0) -> DataFrame:
    """(id, label): points in cells at least ``factor`` times as dense as the window, joined across edges; groups of fewer than ``least`` points are noise, -1.

    Labels are numbered by the smallest id.
    """
    cells = voronoi_cells(points, window, tile)
    area = (window[2] - window[0]) * (window[3] - window[1])
    total = cells.agg(F.sum("n").alias("all"))
    dense = cell_densities(cells, rank).join(F.broadcast(total)).where(F.col("density") >= factor * F.col("all") / area)
    firsts = points.groupBy("x", "y").agg(F.min("id").alias("root"))
    chosen = stored(dense.select("x", "y").join(firsts, ["x", "y"]), "dense-cells")
    links = cells.select("x", "y", F.explode(F.arrays_zip(F.col("near_x").alias("px"), F.col("near_y").alias("py"))).alias("p")).select("x", "y", "p.*").join(chosen.withColumnRenamed("root", "a"), ["x", "y"]).join(chosen.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("root").alias("b")), ["px", "py"]).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    comps = components(chosen.select(F.col("root").alias("id")), both).select("id", F.col("root").alias("comp"))
    members = stored(points.select("id", "x", "y").join(chosen, ["x", "y"]).select("id", F.col("root").alias("cell")).join(comps.withColumnRenamed("id", "cell"), "cell").select("id", "comp"), "cell-members")
    large = members.groupBy("comp").agg(F.count("*").alias("n"), F.min("id").alias("root")).where(F.col("n") >= least)
    labels = large.join(numbered(large), "root").select("comp", "label")
    return points.select("id").join(members, "id", "left").join(labels, "comp", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))

"""Region and slab filters, distances to region edges, precision filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def in_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    """Inside or on a circle."""
    return distance(x - cx, y - cy) <= r


def in_square(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Strictly inside a rectangle."""
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def edges(vertices: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(vertices, [*vertices[1:], vertices[0]], strict=True)]


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule, concave polygons allowed; one codegen expression for each edge."""
    crossings = F.lit(0)
    for ax, ay, bx, by in edges(vertices):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def edge_distance(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Distance to the nearest edge of a polygon."""
    parts = []
    for ax, ay, bx, by in edges(vertices):
        dx, dy = bx - ax, by - ay
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        parts.append(distance(x - (ax + t * dx), y - (ay + t * dy)))
    return F.least(*parts)


def slab(z: Column, peak: float, half_width: float) -> Column:
    """An axial slab, bounds included."""
    return z.between(peak - half_width, peak + half_width)


def axial_cut(z: Column, low: float | None, high: float | None) -> Column:
    """Strictly between two bounds; without both nothing is cut."""
    return F.lit(True) if low is None or high is None else (z > low) & (z < high)


def plausible(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """Rows whose value is finite, positive and at least a share of the table's exact median."""
    good = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) > 0) & (F.col(column) < float("inf")))
    median = good.agg(F.percentile(column, F.lit(0.5)).alias("__median"))
    return good.join(F.broadcast(median)).where(F.col(column) >= share * F.col("__median")).drop("__median")

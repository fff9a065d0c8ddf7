"""Neighbours of points in the plane by a grid of cells.

A point meets those of its own and the eight adjacent cells by an equi-join on
the cell, so no two tasks see more than their cells, and no cross join is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .regions import distance


def _cell(c: str, radius: float):
    return F.floor(F.col(c) / F.lit(radius))


def placed(points: DataFrame) -> DataFrame:
    """Points that have a place: no coordinate is null or NaN."""
    return points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def places(points: DataFrame) -> DataFrame:
    """(id, x, y, n), stored: the distinct places of points, each named by its smallest id, and how many points it has.

    What is asked about pairs of points is asked about pairs of places, so
    points that share places are never paired with each other.
    """
    return stored(placed(points).groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "x", "y", "n"), "places")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d) of all points within ``radius`` of each other; both sides have id, x, y. Columns to ``keep`` are those of the right side."""
    near = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    one = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"))
    one = one.select("a", "ax", "ay", F.explode(near).alias("cell")).select("a", "ax", "ay", "cell.cx", "cell.cy")
    two = right.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"), *keep)
    d = distance(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return one.join(two, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).select("a", "b", "d", *keep)


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    """(id, n) with the point itself among its neighbours."""
    spots = places(points)
    found = radius_pairs(spots, spots, radius, ("n",)).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    return points.select("id", "x", "y").join(spots.select("id", "x", "y").join(found, "id").select("x", "y", "n"), ["x", "y"]).select("id", "n")


def nearest(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, rank, other, d) of the k nearest other points; ties go to the smaller id.

    Places are looked for instead of points: the k + 1 nearest ids of a place,
    its own among them, hold the k nearest others of each point there. A place
    with so many points needs no search. Starts with a small radius; only
    places that do not find enough in it are asked again with four times the
    radius, up to one that reaches every point, so dense regions stay cheap
    and far points are not lost. Points without a place, null or NaN, have no
    neighbours and no rows. The first ids of each place are picked within each
    task before they are shuffled.
    """
    own = placed(points).select("id", "x", "y")
    first = own.selectExpr("id", "x", "y", "row_number() over (partition by x, y order by id) as k").where(F.col("k") <= k + 1)
    heads = stored(first.selectExpr("min(id) over (partition by x, y) as place", "x", "y", "id"), "place-heads")
    n, *ends = heads.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    want = min(k + 1, n)
    spots = stored(heads.groupBy("place").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.count("*").alias("n")).withColumnRenamed("place", "id"), "places")
    wide, high = (ends[1] - ends[0], ends[3] - ends[2]) if n else (0.0, 0.0)
    reach = (wide**2 + high**2) ** 0.5 * (1 + 1e-9)
    found = heads.join(spots.where(F.col("n") >= want).select(F.col("id").alias("place")), "place", "left_semi").select("place", "id", F.lit(0.0).alias("d"))
    open_spots = stored(spots.where(F.col("n") < want), "open-places")
    left = open_spots.count()
    if left and wide * high > 0:
        # A disc of this radius holds some times as many places as are wanted, where they lie evenly.
        radius = min(radius, (4 * want * wide * high / spots.count()) ** 0.5)
    while left:
        pairs = radius_pairs(open_spots, spots, radius)
        ranked = pairs.selectExpr("a", "b", "d", "row_number() over (partition by a order by d, b) as k").where(F.col("k") <= want)
        ids = ranked.join(heads.select(F.col("place").alias("b"), "id"), "b").selectExpr("a as place", "id", "d", "row_number() over (partition by a order by d, id) as k").where(F.col("k") <= want)
        part = stored(ids.selectExpr("place", "id", "d", "count(*) over (partition by place) as n"), "neighbours")
        whole = part.where(F.col("n") >= want)
        found = found.unionByName(whole.select("place", "id", "d"))
        if radius > reach:
            break
        old, open_spots = open_spots, stored(open_spots.join(whole.select(F.col("place").alias("id")).distinct(), "id", "left_anti"), "open-places")
        discard(old)
        left = open_spots.count()
        radius = min(radius * 4, max(reach * (1 + 1e-6), radius * 1.001))
    lists = found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("d", F.col("id").alias("other")))).alias("near"))
    at = lists.join(spots.select(F.col("id").alias("place"), "x", "y"), "place").select("x", "y", "near")
    others = F.slice(F.filter("near", lambda o: o["other"] != F.col("id")), 1, k)
    return own.join(at, ["x", "y"]).select("id", F.posexplode(others).alias("pos", "o")).select("id", (F.col("pos") + 1).alias("rank"), "o.other", "o.d")


def mutual(nearest_one: DataFrame) -> DataFrame:
    """(a, b, d) of points that are each other's nearest neighbour, a < b."""
    x = nearest_one.where("rank = 1").select(F.col("id").alias("a"), F.col("other").alias("b"), "d")
    y = x.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return x.join(y, ["a", "b"]).where("a < b")

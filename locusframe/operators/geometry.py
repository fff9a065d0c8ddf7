"""Contours, regions and graphs of points: centres, signed distances, registration, densities, correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest, places, radius_pairs
from .regions import distance, edge_distance, edges, in_polygon


def in_convex(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside or on a convex polygon given counter-clockwise: to the left of every edge."""
    out = F.lit(True)
    for ax, ay, bx, by in edges(corners):
        out = out & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return out


def depth_in_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    """Distance to the edge of a circle, positive inside."""
    return F.lit(r) - distance(x - cx, y - cy)


def depth_in_square(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Distance to the edge of a rectangle, positive inside."""
    outside = distance(F.greatest(x0 - x, F.lit(0.0), x - x1), F.greatest(y0 - y, F.lit(0.0), y - y1))
    inside = F.least(x - x0, x1 - x, y - y0, y1 - y)
    return F.when(inside >= 0, inside).otherwise(-outside)


def depth_in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Distance to the edge of a polygon, positive inside."""
    d = edge_distance(x, y, corners)
    return F.when(in_polygon(x, y, corners), d).otherwise(-d)


def is_rectangle(corners: list[tuple[float, float]], tolerance: float = 1e-9) -> bool:
    """Whether a polygon is a rectangle with sides along the axes."""
    xs, ys = ({round(c[i] / tolerance) for c in corners} for i in (0, 1))
    return len(corners) == 4 and len(xs) == 2 and len(ys) == 2 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True))


def cyclic_distance(a: Column, b: Column, length: float) -> Column:
    """Shorter way between two positions around a closed contour."""
    d = F.pmod(F.abs(a - b), F.lit(length))
    return F.least(d, F.lit(length) - d)


def contour_centres(contour: DataFrame) -> DataFrame:
    """(grp, cx, cy): area centroid of each closed contour ``contour(grp, x, y, next_x, next_y)``; none without an area.

    Triangles are taken about the mean of the corners, so far contours lose no digits.
    """
    mean = contour.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n >= 3")
    own = contour.join(mean, "grp").selectExpr("grp", "mx", "my", "x - mx as x", "y - my as y", "next_x - mx as u", "next_y - my as v").withColumn("cross", F.col("x") * F.col("v") - F.col("u") * F.col("y"))
    sums = own.groupBy("grp", "mx", "my").agg(F.sum("cross").alias("twice"), F.sum((F.col("x") + F.col("u")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("v")) * F.col("cross")).alias("sy"))
    return sums.where("abs(twice) > 1e-9").select("grp", (F.col("mx") + F.col("sx") / (3 * F.col("twice"))).alias("cx"), (F.col("my") + F.col("sy") / (3 * F.col("twice"))).alias("cy"))


def registration(pairs: DataFrame) -> DataFrame:
    """(grp, n, dx, dy, error) of ``pairs(grp, dx, dy)``: mean offset, and the root mean square of what each pair misses the mean of the others by, from three pairs on.

    A pair's miss is its deviation from the mean of all, times n / (n - 1).
    """
    one = pairs.groupBy("grp").agg(F.count("*").alias("n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.var_pop("dx").alias("vx"), F.var_pop("dy").alias("vy"))
    factor = F.col("n") / (F.col("n") - 1)
    return one.select("grp", "n", F.col("mx").alias("dx"), F.col("my").alias("dy"), F.when(F.col("n") >= 3, factor * F.sqrt(F.col("vx") + F.col("vy"))).alias("error"))


def neighbour_graph(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(a, b) with a < b: each point linked with its k nearest, once for both directions."""
    near = nearest(points, k, radius)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def degree_histogram(graph: DataFrame) -> DataFrame:
    """(degree, n) of the linked points of a graph ``graph(a, b)``."""
    ends = graph.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ends.groupBy("degree").agg(F.count("*").alias("n"))


def knn_density(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, density) in points of the area: k over the disc that reaches the k-th other point; distances of 0 count as the smallest that is not."""
    far = nearest(points, k, radius).groupBy("id").agg(F.max("rank").alias("k"), F.max("d").alias("r"))
    least = far.agg(F.min(F.when(F.col("r") > 0, F.col("r"))).alias("least"))
    r = F.when(F.col("r") > 0, F.col("r")).otherwise(F.coalesce("least", F.lit(1.0)))
    return far.join(F.broadcast(least)).select("id", (F.col("k") / (F.lit(math.pi) * r * r)).alias("density"))


def place_densities(spots: DataFrame, bandwidth: float, cutoff: float = 3.0) -> DataFrame:
    """(id, density) at ``spots(id, x, y, n)``: Gaussian kernels of all points within ``cutoff`` bandwidths, those of the place included."""
    norm = 1 / (2 * math.pi * bandwidth * bandwidth)
    kernel = F.exp(-0.5 * F.col("d") * F.col("d") / (bandwidth * bandwidth))
    return radius_pairs(spots, spots, bandwidth * cutoff, ("n",)).groupBy(F.col("a").alias("id")).agg((norm * F.sum(F.col("n") * kernel)).alias("density"))


def kernel_density(points: DataFrame, bandwidth: float, cutoff: float = 3.0) -> DataFrame:
    """(id, density): Gaussian kernels of all points within ``cutoff`` bandwidths, the point itself included."""
    spots = places(points)
    found = place_densities(spots, bandwidth, cutoff)
    return points.select("id", "x", "y").join(spots.select("id", "x", "y").join(found, "id").select("x", "y", "density"), ["x", "y"]).select("id", "density")


def ripley_arc(positions: DataFrame, length: float, radii: list[float]) -> DataFrame:
    """(grp, r, n, k, h): length over n (n - 1) times the ordered pairs within r around a closed contour, and that less 2 r.

    Positions meet only those of adjacent cells as wide as the largest radius.
    """
    span = max(radii)
    cells = max(1, int(length / span))
    placed = positions.selectExpr("grp", "s", "row_number() over (partition by grp order by s) as id", f"least(cast(floor(s / {length / cells}D) as int), {cells - 1}) as cell")
    near = F.array_distinct(F.array(*(F.pmod(F.col("cell") + i, F.lit(cells)) for i in (-1, 0, 1))))
    other = placed.select("grp", F.col("s").alias("s2"), F.col("id").alias("id2"), F.explode(near).alias("cell"))
    pairs = placed.join(other, ["grp", "cell"]).where("id < id2").withColumn("d", cyclic_distance(F.col("s"), F.col("s2"), length)).where(F.col("d") <= span + 1e-9 * length)
    within = pairs.groupBy("grp").agg(*(F.count(F.when(F.col("d") <= r + 1e-9 * length, 1)).alias(f"r{i}") for i, r in enumerate(radii)))
    sizes = positions.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").join(within, "grp", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("r"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("pairs")) for i, r in enumerate(radii))))
    long = sizes.select("grp", "n", rows.alias("p")).select("grp", "n", "p.*")
    k = length / (F.col("n") * (F.col("n") - 1)) * 2 * F.col("pairs")
    return long.select("grp", "r", "n", k.alias("k"), (k - 2 * F.col("r")).alias("h"))


def partial_spearman(rows: DataFrame) -> DataFrame:
    """(grp, n, rho) of ``rows(grp, a, b, c)``: rank correlation of a and b with that of c taken out, for groups of five or more."""
    rank = lambda c: F.expr(f"rank() over (partition by grp order by {c}) + (count(*) over (partition by grp, {c}) - 1) / 2.0D").alias(f"r{c}")
    ranked = rows.select("grp", rank("a"), rank("b"), rank("c"))
    one = ranked.groupBy("grp").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("ab"), F.corr("ra", "rc").alias("ac"), F.corr("rb", "rc").alias("bc")).where("n >= 5")
    rest = (1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc"))
    return one.select("grp", "n", F.when(rest > 0, (F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt(rest)).alias("rho"))


def autocorrelation(profile: DataFrame) -> DataFrame:
    """(grp, lag, r) of the centred profile ``profile(grp, bin, n)``, over its whole sum of squares."""
    z = profile.selectExpr("grp", "bin", "n - avg(n) over (partition by grp) as z")
    whole = z.groupBy("grp").agg(F.sum(F.col("z") * F.col("z")).alias("whole")).where("whole > 0")
    later = z.select("grp", F.col("bin").alias("bin2"), F.col("z").alias("z2"))
    sums = z.join(later, "grp").where("bin2 >= bin").groupBy("grp", (F.col("bin2") - F.col("bin")).alias("lag")).agg(F.sum(F.col("z") * F.col("z2")).alias("s"))
    return sums.join(whole, "grp").select("grp", "lag", (F.col("s") / F.col("whole")).alias("r"))


def period_amplitude(correlation: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """(grp, period, amplitude): the highest local maximum of an autocorrelation between two lags, less the mean of the valleys on both sides of it."""
    near = correlation.selectExpr("*", "lag(r) over (partition by grp order by lag) as before", "lead(r) over (partition by grp order by lag) as after")
    inside = F.col("lag") * step
    peaks = near.where(inside.between(low, high) & (F.col("lag") > 0) & (F.col("r") > F.col("before")) & (F.col("r") > F.col("after")))
    best = peaks.groupBy("grp").agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("best")).select("grp", F.col("best.r").alias("peak"), (-F.col("best.minus")).alias("at"))
    sides = correlation.join(best, "grp").groupBy("grp", "peak", "at").agg(F.min(F.when(F.col("lag") < F.col("at"), F.col("r"))).alias("first"), F.min(F.when((F.col("lag") > F.col("at")) & (F.col("lag") <= 2 * F.col("at")), F.col("r"))).alias("second"))
    return sides.where("first is not null and second is not null").select("grp", (F.col("at") * step).alias("period"), (F.col("peak") - (F.col("first") + F.col("second")) / 2).alias("amplitude"))

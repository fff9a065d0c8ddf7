"""Closed contours: area, length, samples at equal spacing, pair correlation along the arc."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_edges(vertices: DataFrame) -> DataFrame:
    """(grp, pos, x, y, next_x, next_y, arc, step): each vertex with the next one around, the arc length up to it and to the next.

    One group is one contour, so a task holds whole contours but never several groups at once.
    """
    around = "over (partition by grp order by pos)"
    ahead = vertices.selectExpr("grp", "pos", "x", "y", *(f"coalesce(lead({c}) {around}, first_value({c}) {around}) as next_{c}" for c in ("x", "y")))
    sized = ahead.withColumn("step", F.sqrt((F.col("next_x") - F.col("x")) * (F.col("next_x") - F.col("x")) + (F.col("next_y") - F.col("y")) * (F.col("next_y") - F.col("y"))))
    return sized.selectExpr("grp", "pos", "x", "y", "next_x", "next_y", f"coalesce(sum(step) {around[:-1]} rows between unbounded preceding and 1 preceding), 0D) as arc", "step")


def area_and_length(edges: DataFrame) -> DataFrame:
    """(grp, area, length) of closed contours of three vertices or more."""
    twice = F.sum(F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y"))
    return edges.groupBy("grp").agg(F.count("*").alias("n"), (F.abs(twice) / 2).alias("area"), F.sum("step").alias("length")).where("n >= 3").drop("n")


def equal_samples(edges: DataFrame, n: int) -> DataFrame:
    """(grp, k, x, y): ``n`` points at equal arc distances from the first vertex on.

    Every edge generates the samples that fall on it, so no range join is needed.
    """
    total = edges.groupBy("grp").agg(F.sum("step").alias("total"))
    spaced = edges.join(total, "grp").where("step > 0").withColumn("h", F.col("total") / n)
    low, high = F.ceil(F.col("arc") / F.col("h")), F.least(F.ceil((F.col("arc") + F.col("step")) / F.col("h")) - 1, F.lit(n - 1))
    some = spaced.withColumn("low", low).withColumn("high", high).where("low <= high")
    each = some.withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("t", (F.col("k") * F.col("h") - F.col("arc")) / F.col("step"))
    return each.select("grp", F.col("k").cast("int").alias("k"), *((F.col(c) + F.col("t") * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in ("x", "y")))


def arc_pair_correlation(positions: DataFrame, length: float, width: float, reach: float) -> DataFrame:
    """(grp, bin, g): pairs in each bin of cyclic distance, over what uniform positions would give.

    Positions are dealt to cells as wide as the reach and meet only those of
    their own and the following cell, so pairs beyond the reach are not made.
    """
    top = int(min(reach, length / 2) / width + 1e-9)
    span = top * width
    cells = max(1, int(length / span))
    numbered = positions.selectExpr("grp", "s", "row_number() over (partition by grp order by s) as id", f"least(cast(floor(s / {length / cells}D) as int), {cells - 1}) as cell")
    near = F.array_distinct(F.array(*(F.pmod(F.col("cell") + k, F.lit(cells)) for k in (-1, 0, 1))))
    right = numbered.select("grp", F.col("s").alias("s2"), F.col("id").alias("id2"), F.explode(near).alias("cell"))
    apart = F.abs(F.col("s") - F.col("s2"))
    pairs = numbered.join(right, ["grp", "cell"]).where("id < id2").withColumn("d", F.least(apart, F.lit(length) - apart)).where(F.col("d") <= span)
    counts = pairs.groupBy("grp", F.least(F.floor(F.col("d") / width), F.lit(top - 1)).cast("int").alias("bin")).agg(F.count("*").alias("pairs"))
    grid = positions.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(top - 1))))
    expected = F.col("k") * (F.col("k") - 1) / 2 * (2 * width / length)
    return grid.join(counts, ["grp", "bin"], "left").select("grp", "bin", (F.coalesce("pairs", F.lit(0)) / expected).alias("g"))


def folded(aligned: DataFrame, n_bins: int) -> DataFrame:
    """(grp, lag, mean): a profile whose peak is in bin 0, averaged over both directions from it."""
    return aligned.groupBy("grp", F.least("bin", n_bins - F.col("bin")).cast("int").alias("lag")).agg(F.avg("n").alias("mean"))


def bragg_peak(power: DataFrame, length: float) -> DataFrame:
    """(grp, mode, power, spacing): the strongest mode of ``power(grp, mode, power)``, the lower one of equals, and the spacing it implies."""
    best = power.groupBy("grp").agg(F.max(F.struct(F.round("power", 9).alias("p"), (-F.col("mode")).alias("minus"))).alias("best"))
    return best.select("grp", (-F.col("best.minus")).alias("mode"), F.col("best.p").alias("power"), (F.lit(length) / -F.col("best.minus")).alias("spacing"))

"""Axial slices, slabs, posteriors and edges of a z distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTSIDE = -99


def slice_of(z: Column, z0: float, thickness: float, guard: float = 0.0) -> Column:
    """-1, 0 or 1: three adjacent half-open slices around z0, each less a guard on both sides; OUTSIDE elsewhere."""
    at = F.floor((z - z0) / thickness + 0.5)
    low = F.lit(z0) + (at - 0.5) * thickness + guard
    return F.when(at.between(-1, 1) & (z >= low) & (z < low + (thickness - 2 * guard)), at.cast("int")).otherwise(OUTSIDE)


def slice_report(points: DataFrame, z0: float, thickness: float, guard: float = 0.0) -> DataFrame:
    """(grp, slice, n, pct_of_central, coverage) of the three slices of each group, empty ones too.

    Coverage is the share of a slice that the group's range of z reaches.
    """
    sized = points.where("z is not null and not isnan(z)")
    span = sized.groupBy("grp").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    grid = span.withColumn("slice", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    counts = sized.groupBy("grp", slice_of(F.col("z"), z0, thickness, guard).alias("slice")).agg(F.count("*").alias("n"))
    both = grid.join(counts, ["grp", "slice"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    central = both.where("slice = 0").select("grp", F.col("n").alias("n0"))
    low, high = F.lit(z0) + (F.col("slice") - 0.5) * thickness + guard, F.lit(z0) + (F.col("slice") + 0.5) * thickness - guard
    reach = (F.least(high, "z_max") - F.greatest(low, "z_min")) / (thickness - 2 * guard)
    return both.join(central, "grp").select("grp", "slice", "n", F.when(F.col("n0") > 0, 100.0 * F.col("n") / F.col("n0")).alias("pct_of_central"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), reach)).alias("coverage"))


def slab_index(z: Column, slabs: list[tuple[float, float, float]]) -> Column:
    """Position of the slab (low, high, centre), bounds included, that holds z; of several that with the nearest centre, then the lower; -1 outside."""
    places = [F.when((z >= lo) & (z <= hi), F.struct(F.abs(z - mid).alias("d"), F.lit(k).alias("k"))) for k, (lo, hi, mid) in enumerate(slabs)]
    return F.coalesce(F.least(*places)["k"] if len(places) > 1 else places[0]["k"], F.lit(-1))


def posterior(z: Column, parts: list[tuple[float, float, float]]) -> tuple[Column, Column]:
    """Most likely component (weight, mean, sd) of a Gaussian mixture, and its responsibility."""
    density = [F.lit(w / s) * F.exp(-0.5 * (z - m) * (z - m) / F.lit(s * s)) for w, m, s in parts]
    total = sum(density[1:], density[0])
    best = F.greatest(*(F.struct(d.alias("p"), F.lit(-k).alias("minus")) for k, d in enumerate(density)))
    return F.when(total > 0, -best["minus"]), F.when(total > 0, best["p"] / total)


def edge_truncation(points: DataFrame, width: float, share: float, least: int) -> DataFrame:
    """(grp, side, edge, n, share, cut): whether an end of the z range is a cut and not a tail.

    It is where the bin at the edge has ``least`` points and ``share`` of the
    fullest bin, bins counted from the lowest z. Rows with a null, NaN or
    infinite z don't count.
    """
    finite = points.where("abs(z) < double('infinity')")
    ends = finite.groupBy("grp").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    placed = finite.join(ends, "grp")
    last = F.greatest(F.ceil((F.col("high") - F.col("low")) / width) - 1, F.lit(0))
    bins = placed.groupBy("grp", F.least(F.floor((F.col("z") - F.col("low")) / width), last).alias("bin")).agg(F.count("*").alias("n")).groupBy("grp").agg(F.max("n").alias("most"))
    edges = placed.groupBy("grp").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.count(F.when(F.col("z") < F.col("low") + width, 1)).alias("bottom"), F.count(F.when(F.col("z") > F.col("high") - width, 1)).alias("top"))
    sides = F.explode(F.array(F.struct(F.lit("bottom").alias("side"), F.col("low").alias("edge"), F.col("bottom").alias("n")), F.struct(F.lit("top").alias("side"), F.col("high").alias("edge"), F.col("top").alias("n"))))
    rows = edges.join(bins, "grp").select("grp", "most", sides.alias("s")).select("grp", "s.*", (F.col("s.n") / F.col("most")).alias("share"))
    return rows.withColumn("cut", (F.col("n") >= least) & (F.col("share") >= share))


def normal_mass(low: float, high: float, mean: float, sd: float) -> float:
    """Mass of a normal distribution between two bounds."""
    return 0.5 * (math.erf((high - mean) / (sd * math.sqrt(2))) - math.erf((low - mean) / (sd * math.sqrt(2))))


def boundary_fraction(points: DataFrame, boundary: float, band: float, window: tuple[float, float], mean: float, sd: float) -> DataFrame:
    """(grp, fraction, expected): share of z within a band of a boundary, and that of a normal distribution cut to the window."""
    low, high = max(boundary - band, window[0]), min(boundary + band, window[1])
    whole = normal_mass(*window, mean, sd)
    expected = 0.0 if high <= low else normal_mass(low, high, mean, sd) / whole if whole > 0 else float("nan")
    near = F.avg(F.when(F.abs(F.col("z") - boundary) <= band, 1.0).otherwise(0.0))
    return points.groupBy("grp").agg(near.alias("fraction")).withColumn("expected", F.lit(expected))


def step_of_frame(frame: Column, steps: int, per_step: int, interleaved: bool = False) -> Column:
    """Stage step of a frame, in blocks or one frame of each step in turn; -1 for trailing frames."""
    step = frame % steps if per_step > 1 and interleaved else F.floor(frame / per_step)
    return F.when((frame >= 0) & (frame < steps * per_step), step.cast("bigint")).otherwise(F.lit(-1))


def arc_bin(s: Column, length: float, n_bins: int, origin: float = 0.0) -> Column:
    """Bin of a position around a closed contour, counted from an origin."""
    return F.least(F.floor(F.pmod(s - origin, F.lit(length)) / (length / n_bins)), F.lit(n_bins - 1)).cast("int")


def otsu(values: DataFrame, bins: int = 256) -> DataFrame:
    """(grp, threshold): the cut of a histogram of ``values(grp, value)`` that parts it best; the middle of a flat stretch of best cuts.

    Histograms are aggregated first, so the windows run over ``bins`` rows for
    each group. Null, NaN and infinite values don't count.
    """
    finite = values.where("abs(value) < double('infinity')")
    ends = finite.groupBy("grp").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    placed = finite.join(ends, "grp").where("high > low").withColumn("bin", F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)))
    counts = placed.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    grid = ends.where("high > low").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    whole = grid.join(counts, ["grp", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double")).withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * width)
    run = whole.selectExpr("*", "sum(n) over (partition by grp order by bin) as w0", "sum(n) over (partition by grp) as w", "sum(n * centre) over (partition by grp order by bin) as m0", "sum(n * centre) over (partition by grp) as m")
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1
    scored = run.where(f"bin < {bins - 1} and w0 > 0 and w0 < w").withColumn("between", F.col("w0") * w1 * gap * gap)
    best = scored.selectExpr("*", "max(between) over (partition by grp) as best").where("between >= best * (1 - 1e-9)")
    first = best.selectExpr("*", "bin - row_number() over (partition by grp order by bin) as island").selectExpr("*", "min(island) over (partition by grp) as lead_island").where("island = lead_island")
    ends_of = first.groupBy("grp").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.first("low").alias("low"), F.first("high").alias("high"))
    found = ends_of.select("grp", (F.col("low") + (F.col("a") + F.col("b") + 2) / 2 * width).alias("threshold"))
    return found.unionByName(ends.where("high = low").select("grp", F.col("low").cast("double").alias("threshold")))

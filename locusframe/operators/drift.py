"""Residual drift: shifts of time segments against the whole, and whether they go on from one segment to the next.

Profiles are sparse histograms, so what is shifted and joined follows the
extent of the data and the number of segments, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .nulls import permuted

#: Fixed values of the check: fewest rows of a segment, fewest segments, level, and least autocorrelation of a drift.
LEAST_ROWS, LEAST_SEGMENTS, LEVEL, LEAST_ACF = 50, 8, 0.05, 0.2


def _segment(segments: int) -> Column:
    """Which of so many equal spans from f0 to f1 a frame lies in."""
    return F.least(F.floor((F.col("frame") - F.col("f0")) * F.lit(float(segments)) / (F.col("f1") + 1 - F.col("f0"))), F.lit(segments - 1)).cast("int")


def segment_profiles(values: DataFrame, segments: int, width: float) -> DataFrame:
    """(grp, segment, bin, n) of ``values(grp, frame, v)``: equal spans of frames, bins of ``width`` from the group's least value on. Rows with nulls or NaN don't count."""
    clean = values.where("grp is not null and frame is not null and v is not null and not isnan(v)")
    ends = clean.groupBy("grp").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("v").alias("v0"))
    return clean.join(ends, "grp").groupBy("grp", _segment(segments).alias("segment"), F.floor((F.col("v") - F.col("v0")) / width).alias("bin")).agg(F.count("*").alias("n"))


def segment_shifts(profiles: DataFrame, width: float, reach: float) -> DataFrame:
    """(grp, segment, n, shift, fine) of every segment with LEAST_ROWS rows or more.

    ``shift`` is the lag, in steps of ``width`` up to ``reach``, at which the
    segment's profile is most like that of all; of equal ones the segment is
    moved least to the left. ``fine`` sets the peak between the steps by a
    parabola through its neighbours.
    """
    lags = int(reach / width)
    profiles = stored(profiles, "profiles")
    whole = profiles.groupBy("grp", "bin").agg(F.sum("n").alias("of_all"))
    moved = profiles.select("grp", "segment", "n", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), "bin").withColumn("bin", F.col("bin") + F.col("lag"))
    scores = moved.join(whole, ["grp", "bin"]).groupBy("grp", "segment", "lag").agg(F.sum(F.col("n") * F.col("of_all")).alias("score"))
    best = scores.groupBy("grp", "segment").agg(F.min(F.struct((-F.col("score")).alias("s"), "lag")).alias("best")).select("grp", "segment", F.col("best.lag").alias("top"), (-F.col("best.s")).alias("high"))
    sides = scores.join(best, ["grp", "segment"]).groupBy("grp", "segment", "top", "high").agg(*(F.coalesce(F.max(F.when(F.col("lag") == F.col("top") + k, F.col("score"))), F.lit(0)).alias(name) for k, name in ((-1, "left"), (1, "right"))))
    bend = F.col("left") + F.col("right") - 2 * F.col("high")
    away = F.when(bend < 0, (F.col("left") - F.col("right")) / (2 * bend)).otherwise(0.0)
    sizes = profiles.groupBy("grp", "segment").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
    return sides.join(sizes, ["grp", "segment"]).select("grp", "segment", "n", (-F.col("top") * F.lit(float(width))).alias("shift"), (-(F.col("top") + away) * F.lit(float(width))).alias("fine"))


def coherence(shifts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(grp, n_segments, range, acf, p, coherent) of ``shifts(grp, segment, shift)`` with LEAST_SEGMENTS segments or more.

    Lag-one autocorrelation over the segments there are, against shifts dealt
    anew among them; p is the share of replicates with as large a one. Equal
    shifts throughout are no drift.
    """
    placed = shifts.selectExpr("grp", "segment", "shift", "cast(row_number() over (partition by grp order by segment) as bigint) as key")
    means = placed.groupBy("grp").agg(F.count("*").alias("n_segments"), F.avg("shift").alias("mean"), (F.max("shift") - F.min("shift")).alias("range"), (F.var_pop("shift") * F.count("*")).alias("sum2")).where(F.col("n_segments") >= LEAST_SEGMENTS)
    rows = stored(placed.join(means, "grp").select("grp", "key", (F.col("shift") - F.col("mean")).alias("off")), "centred-shifts")
    every = rows.select("grp", F.lit(0).alias("replicate"), "key", "off").unionByName(permuted(rows, "off", replicates, seed).withColumnRenamed("moved", "off"))
    steps = every.selectExpr("grp", "replicate", "off * lead(off) over (partition by grp, replicate order by key) as product")
    each = steps.groupBy("grp", "replicate").agg(F.sum("product").alias("s"))
    own = each.where("replicate = 0").select("grp", F.col("s").alias("own"))
    # Products are summed in other orders, so equal ones may differ in the last digits.
    null = each.where("replicate > 0").join(own, "grp").join(means.select("grp", "sum2"), "grp").groupBy("grp").agg(F.avg((F.col("s") >= F.col("own") - 1e-9 * F.col("sum2")).cast("double")).alias("p"))
    joined = means.join(own, "grp").join(null, "grp")
    flat = F.col("range") <= 0
    acf = F.when(flat, 0.0).otherwise(F.col("own") / F.col("sum2"))
    out = joined.select("grp", "n_segments", "range", acf.alias("acf"), F.when(flat, 1.0).otherwise(F.col("p")).alias("p"))
    return out.withColumn("coherent", (F.col("p") < LEVEL) & (F.col("acf") > LEAST_ACF))


def drift_check(values: DataFrame, segments: int, width: float, reach: float, replicates: int, seed: int) -> DataFrame:
    """``coherence`` of the segments of ``values(grp, frame, v)``, one axis of a movie for each group."""
    shifts = stored(segment_shifts(segment_profiles(values, segments, width), width, reach), "segment-shifts")
    found = stored(coherence(shifts, replicates, seed), "drift")
    discard(shifts)
    return found


def plane_bins(points: DataFrame, segments: int, width: float, moved: DataFrame | None = None) -> DataFrame:
    """(grp, segment, bx, by, n) of ``points(grp, frame, x, y)``: equal spans of frames, square bins of ``width`` from the group's least x and y on.

    With ``moved(grp, segment, dx, dy)`` a segment's points are moved back by
    its shift before they are counted. Rows with nulls, NaN or infinite places
    don't count.
    """
    clean = points.where("grp is not null and frame is not null and abs(x) < double('infinity') and abs(y) < double('infinity')")
    ends = clean.groupBy("grp").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    rows = clean.join(ends, "grp").select("grp", _segment(segments).alias("segment"), (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"))
    if moved is not None:
        back = moved.select("grp", "segment", "dx", "dy")
        rows = rows.join(back, ["grp", "segment"], "left").select("grp", "segment", *((F.col(c) - F.coalesce(d, F.lit(0.0))).alias(c) for c, d in (("x", "dx"), ("y", "dy"))))
    return rows.groupBy("grp", "segment", F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / width).alias("by")).agg(F.count("*").alias("n"))


def plane_shifts(bins: DataFrame, width: float, reach: float) -> DataFrame:
    """(grp, segment, n, lag_x, lag_y, dx, dy) of every segment with LEAST_ROWS rows or more, as a stored table.

    The lag, in bins up to ``reach`` along each axis, is that at which the
    segment's counts are most like those of all other segments; of equal ones
    the shortest, then the least x and y. A segment that shares nothing with
    the others has none. ``dx`` and ``dy``, by how much the segment has been
    moved, set the peak between the bins by a parabola along each axis.

    Only occupied bins within reach of each other meet: cells as wide as the
    reach are joined with their neighbours, and pairs are summed by lag before
    they are shuffled. The segment's likeness to itself is taken off again.
    """
    lags = int(reach / width)
    wide = max(lags, 1)
    bins = stored(bins, "plane-bins")
    whole = bins.groupBy("grp", "bx", "by").agg(F.sum("n").alias("m"))
    cell = lambda c: F.floor(F.col(c) / wide)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    ours = bins.select("*", around("bx").alias("cx")).select("*", around("by").alias("cy"))

    def products(others: DataFrame, keys: list[str], sign: int) -> DataFrame:
        theirs = others.select(*keys, F.col("bx").alias("ox"), F.col("by").alias("oy"), "m", cell("bx").alias("cx"), cell("by").alias("cy"))
        pairs = ours.join(theirs, [*keys, "cx", "cy"]).select("grp", "segment", (F.col("ox") - F.col("bx")).alias("lag_x"), (F.col("oy") - F.col("by")).alias("lag_y"), (F.col("n") * F.col("m") * sign).alias("v"))
        return pairs.where((F.abs("lag_x") <= lags) & (F.abs("lag_y") <= lags))

    every = products(whole, ["grp"], 1).unionByName(products(bins.withColumnRenamed("n", "m"), ["grp", "segment"], -1))
    scores = stored(every.groupBy("grp", "segment", "lag_x", "lag_y").agg(F.sum("v").alias("score")), "plane-scores")
    order = F.struct((-F.col("score")).alias("s"), (F.col("lag_x") * F.col("lag_x") + F.col("lag_y") * F.col("lag_y")).alias("d"), "lag_x", "lag_y")
    best = scores.groupBy("grp", "segment").agg(F.min(order).alias("best")).select("grp", "segment", F.col("best.lag_x").alias("px"), F.col("best.lag_y").alias("py"), (-F.col("best.s")).alias("high"))
    at = lambda i, j: F.coalesce(F.max(F.when((F.col("lag_x") == F.col("px") + i) & (F.col("lag_y") == F.col("py") + j), F.col("score"))), F.lit(0))
    sides = scores.join(best, ["grp", "segment"]).groupBy("grp", "segment", "px", "py", "high").agg(at(-1, 0).alias("x1"), at(1, 0).alias("x2"), at(0, -1).alias("y1"), at(0, 1).alias("y2"))

    def shift(peak: str, before: str, after: str) -> Column:
        bend = F.col(before) + F.col(after) - 2 * F.col("high")
        return -(F.col(peak) + F.when(bend < 0, (F.col(before) - F.col(after)) / (2 * bend)).otherwise(0.0)) * F.lit(float(width))

    sizes = bins.groupBy("grp", "segment").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
    joined = sides.join(sizes, ["grp", "segment"])
    found = stored(joined.select("grp", "segment", "n", F.col("px").alias("lag_x"), F.col("py").alias("lag_y"), shift("px", "x1", "x2").alias("dx"), shift("py", "y1", "y2").alias("dy")), "plane-shifts")
    discard(bins, scores)
    return found


def drift_curve(points: DataFrame, segments: int, width: float, reach: float, rounds: int = 2) -> DataFrame:
    """(grp, segment, n, dx, dy): the drift of ``points(grp, frame, x, y)`` in the plane, segment by segment, as a stored table.

    The first round compares each segment with others that have drifted too;
    each further one moves the segments back by what is known and measures
    what is left. An empty table gives an empty one.
    """
    curve = plane_shifts(plane_bins(points, segments, width), width, reach)
    for _ in range(rounds - 1):
        more = plane_shifts(plane_bins(points, segments, width, curve), width, reach)
        rest = more.select("grp", "segment", F.col("dx").alias("rx"), F.col("dy").alias("ry"))
        sums = curve.join(rest, ["grp", "segment"]).select("grp", "segment", "n", (F.col("dx") + F.col("rx")).alias("dx"), (F.col("dy") + F.col("ry")).alias("dy"))
        before, curve = curve, stored(sums, "drift-curve")
        discard(before, more)
    return curve.select("grp", "segment", "n", "dx", "dy")

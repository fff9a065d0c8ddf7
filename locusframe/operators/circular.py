"""Ordered sequences on a circle: runs, gaps, windows, correlations, structure factors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def circular_runs(bins: DataFrame, n_bins: int) -> DataFrame:
    """Runs of filled and empty bins of each group on a circle of ``n_bins``: grp, filled, run_length.

    ``bins(grp, bin, filled)`` has every bin. Runs that meet at the origin are
    one; a circle of one kind is one run.
    """
    turn = bins.selectExpr("*", f"coalesce(filled <> lag(filled) over (partition by grp order by bin), false) as change")
    numbered = turn.selectExpr("*", "sum(int(change)) over (partition by grp order by bin rows unbounded preceding) as run", "first_value(filled) over (partition by grp order by bin) = last_value(filled) over (partition by grp order by bin rows between unbounded preceding and unbounded following) as closed")
    wrapped = numbered.selectExpr("*", "max(run) over (partition by grp) as last_run").withColumn("run", F.when(F.col("closed") & (F.col("run") == F.col("last_run")), F.lit(0)).otherwise(F.col("run")))
    return wrapped.groupBy("grp", "run").agg(F.first("filled").alias("filled"), F.count("*").alias("run_length")).select("grp", "filled", "run_length")


def arc_gaps(positions: DataFrame, length: float) -> DataFrame:
    """(grp, s, gap) to the next position of the group around a circle of this length."""
    following = positions.selectExpr("grp", "s", "lead(s) over (partition by grp order by s) as next_s", "min(s) over (partition by grp) as first_s")
    return following.select("grp", "s", F.when(F.col("next_s").isNull(), F.col("first_s") + length - F.col("s")).otherwise(F.col("next_s") - F.col("s")).alias("gap"))


def gap_regularity(gaps: DataFrame) -> DataFrame:
    """Population coefficient of variation of the gaps of each group, from two gaps on, and their circular lag-one correlation, from three on."""
    centred = gaps.selectExpr("*", "gap - avg(gap) over (partition by grp) as dev")
    pairs = centred.selectExpr("*", "coalesce(lead(dev) over (partition by grp order by s), first_value(dev) over (partition by grp order by s)) as next_dev")
    square = F.sum(F.col("dev") * F.col("dev"))
    return pairs.groupBy("grp").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.stddev_pop("gap") / F.avg("gap")).alias("cv"), F.when((square > 0) & (F.count("*") > 2), F.sum(F.col("dev") * F.col("next_dev")) / square).alias("rho1"))


def structure_factor(positions: DataFrame, length: float, modes: int) -> DataFrame:
    """(grp, mode, s): squared modulus of the mean phase factor, times the number of positions."""
    phase = F.col("mode") * F.lit(2 * math.pi / length) * F.col("s")
    each = positions.withColumn("mode", F.explode(F.sequence(F.lit(1), F.lit(modes))))
    sums = each.groupBy("grp", "mode").agg(F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("i"), F.count("*").alias("n"))
    return sums.select("grp", "mode", ((F.col("c") * F.col("c") + F.col("i") * F.col("i")) / F.col("n")).alias("power"))


def rotation_correlation(profile: DataFrame, n_bins: int) -> DataFrame:
    """(grp, shift, corr) of every pair of a profile ``(grp, bin, a, b)`` with all its rotations, both centred."""
    z = profile.selectExpr("grp", "bin", "a - avg(a) over (partition by grp) as a", "b - avg(b) over (partition by grp) as b")
    moved = z.select("grp", "bin", "a").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).withColumn("other", (F.col("bin") + F.col("shift")) % n_bins)
    return moved.join(z.select("grp", F.col("bin").alias("other"), "b"), ["grp", "other"]).groupBy("grp", "shift").agg(F.sum(F.col("a") * F.col("b")).alias("corr"))


def circular_windows(profile: DataFrame, n_bins: int, width: int) -> DataFrame:
    """(grp, bin, n): sums over windows of ``width`` bins from each bin on, around the circle."""
    into = profile.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("bin", F.pmod(F.col("bin") - F.col("back"), F.lit(n_bins)))
    return into.groupBy("grp", "bin").agg(F.sum("n").alias("n"))


def peak_bin(profile: DataFrame, n_bins: int) -> DataFrame:
    """(grp, peak): the fullest bin; ties go to the larger sum over three bins, then to the lower bin."""
    three = circular_windows(profile, n_bins, 3).select("grp", F.pmod(F.col("bin") + 1, F.lit(n_bins)).alias("bin"), F.col("n").alias("three"))
    best = profile.join(three, ["grp", "bin"]).groupBy("grp").agg(F.max(F.struct("n", "three", (-F.col("bin")).alias("minus"))).alias("best"))
    return best.select("grp", (-F.col("best.minus")).alias("peak"))


def aligned(profile: DataFrame, n_bins: int) -> DataFrame:
    """(grp, bin, n) with every group's peak in bin 0."""
    return profile.join(peak_bin(profile, n_bins), "grp").select("grp", F.pmod(F.col("bin") - F.col("peak"), F.lit(n_bins)).alias("bin"), "n")

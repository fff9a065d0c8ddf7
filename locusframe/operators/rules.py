"""Rules on clusters, pairs and contours: states, verdicts with reasons, curation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITERIA = ("peak", "valley", "count", "leak")


def depth_state(depth: Column, exclude: float, doubt: float) -> Column:
    """Beyond ``exclude`` unanchored, beyond ``doubt`` doubtful, else anchored; null and NaN are not evaluated."""
    return F.when(depth.isNull() | F.isnan(depth), "not evaluated").when(depth > exclude, "unanchored").when(depth > doubt, "doubtful").otherwise("anchored")


def lumen_rule(strict: Column, mid: Column, sens: Column, tubulin: Column, spectrin: Column, usable: Column, widefield: Column, margin: float, low_margin: float, veto_outside: float) -> tuple[Column, Column, Column]:
    """(remove, doubtful, vetoed) from isolation at three levels and the depth in two images; a null depth is not inside."""
    deep = lambda m: F.coalesce((tubulin > m) & (spectrin > m), F.lit(False)) & widefield
    inside, shallow = deep(margin), deep(low_margin)
    usable = usable & widefield
    terms = (shallow & mid) | (inside & usable)
    vetoed = usable & strict & ~terms & F.coalesce(spectrin < -veto_outside, F.lit(False))
    remove = (strict | terms) & ~vetoed
    return remove, (shallow | inside | sens | vetoed) & ~remove, vetoed


def combination_table(pairs: DataFrame, viable: float, marginal: float) -> DataFrame:
    """(criteria, viable, viable_or_marginal, axons) of each of the 16 sets of criteria that may be asked for.

    ``pairs(axon, peak, valley, count, leak)``: three flags and an estimate. A
    pair that fails a flag asked for is out; with leak asked for it is viable
    or marginal by its estimate, without it viable.
    """
    sets = [c for k in range(len(CRITERIA), -1, -1) for c in combinations(CRITERIA, k)]
    asked = F.explode(F.array(*(F.struct(F.lit("+".join(c) or "none").alias("criteria"), *(F.lit(x in c).alias(f"ask_{x}") for x in CRITERIA)) for c in sets)))
    each = pairs.select("*", asked.alias("set")).select("*", "set.*")
    flags = (~F.col("ask_peak") | F.col("peak")) & (~F.col("ask_valley") | F.col("valley")) & (~F.col("ask_count") | F.col("count"))
    below = lambda t: F.coalesce(F.col("leak") <= t, F.lit(False))
    good = flags & (~F.col("ask_leak") | below(viable))
    fair = flags & (~F.col("ask_leak") | below(marginal))
    return each.groupBy("criteria").agg(F.count(F.when(good, 1)).alias("viable"), F.count(F.when(fair, 1)).alias("viable_or_marginal"), F.countDistinct(F.when(good, F.col("axon"))).alias("axons"))


def pool_reason(status: Column, failure: Column, assessed: Column, rejected: Column, gate: Column) -> Column:
    """Why a contour does not enter the pool, in fixed sentences; null if it does."""
    return (
        F.when(status != "ok", F.concat(F.lit("analysis "), status, F.when(failure != "", F.concat(F.lit(": "), failure)).otherwise("")))
        .when(~assessed, "contour not assessed by the quality gate")
        .when(rejected != "", F.concat(F.lit("contour rejected: "), rejected))
        .when(gate != "", F.concat(F.lit("contour not reliable: "), gate))
    )


def pair_verdict(flags: list[tuple[str, Column]], leak: Column, viable: float, marginal: float) -> tuple[Column, Column]:
    """(verdict, reasons): all flags and the leak estimate; every failing flag is named."""
    good = flags[0][1]
    for _, flag in flags[1:]:
        good = good & flag
    low = F.coalesce(leak <= marginal, F.lit(False))
    verdict = F.when(good & F.coalesce(leak <= viable, F.lit(False)), "VIABLE").when(good & low, "MARGINAL").otherwise("NOT VIABLE")
    reasons = F.array_compact(F.array(*(F.when(~flag, name) for name, flag in flags), F.when(~low, "leak")))
    return verdict, F.array_join(reasons, "; ")


def best_verdict(pairs: DataFrame) -> DataFrame:
    """(axon, verdict) of the best pair of each axon."""
    rank = F.when(F.col("verdict") == "VIABLE", 0).when(F.col("verdict") == "MARGINAL", 1).otherwise(2)
    return pairs.groupBy("axon").agg(F.min(F.struct(rank.alias("rank"), "verdict")).alias("best")).select("axon", "best.verdict")


def edge_clusters(points: DataFrame, distance: Column, margin: float, most: float = 0.5) -> DataFrame:
    """(label, nearest, touches) of every cluster; nothing touches where more than ``most`` of the clusters would."""
    near = points.where("label >= 0").groupBy("label").agg(F.min(F.abs(distance)).alias("nearest")).withColumn("close", F.col("nearest") <= margin)
    share = near.agg(F.avg(F.col("close").cast("double")).alias("share"))
    return near.join(F.broadcast(share)).select("label", "nearest", (F.col("close") & (F.col("share") <= most)).alias("touches"))


def kept_labels(points: DataFrame, excluded: DataFrame) -> DataFrame:
    """(label) of every cluster that is not excluded."""
    return points.where("label >= 0").select("label").distinct().join(excluded.select("label"), "label", "left_anti")


def frame_analysis(points: DataFrame, n_frames: int, windows: int = 20, low: float = 0.2, high: float = 0.8, most: float = 0.8) -> DataFrame:
    """(label, mean_fraction, window_share, passed): clusters must be spread over the movie.

    Counts of each cluster and window are aggregated first; the mean frame must
    lie in the middle part and no window may hold more than ``most`` of a cluster.
    """
    window = F.least(F.floor(F.col("frame") / (n_frames / windows)), F.lit(windows - 1))
    counts = points.where("label >= 0").groupBy("label", window.alias("window")).agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))
    both = counts.groupBy("label").agg((F.sum("frames") / F.sum("n") / n_frames).alias("mean_fraction"), (F.max("n") / F.sum("n")).alias("window_share"))
    return both.withColumn("passed", F.col("mean_fraction").between(low, high) & (F.col("window_share") <= most))

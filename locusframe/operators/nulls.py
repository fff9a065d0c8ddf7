"""Null models by replicates: reassigned marks, with seeds that any engine gives again.

A replicate is a number; the place of a row in it follows from the MD5 of the
seed, the replicate and the row's own key. Ranks are counted over ranges of the
order, so no task needs a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .statistics import correlation, in_ranges, running


def placed(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows``, stored, with ``name``, their number from 0 within ``groups`` by ``order``, which must tell all rows of a group apart."""
    keys = [*groups, *order]
    counted = running(in_ranges(rows, *keys), ", ".join(keys), {"__k": "1"})
    first = counted.groupBy(*groups).agg(F.min("__k").alias("__first"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups]
    joined = counted.alias("r").join(first.alias("f"), same)
    return stored(joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("__k") - F.col("__first")).alias(name)), "placed")


def average_rank(rows: DataFrame, groups: list[str], value: str, key: str, name: str) -> DataFrame:
    """``rows``, stored, with ``name``: the rank of ``value`` within ``groups`` from 1, ties averaged; ``key`` tells rows apart."""
    numbered = placed(rows, groups, [value, key], "__at")
    ties = numbered.groupBy(*groups, value).agg(F.avg("__at").alias("__mean"))
    out = stored(numbered.join(ties, [*groups, value]).select(*rows.columns, (F.col("__mean") + 1).alias(name)), "ranked")
    discard(numbered)
    return out


def shuffle_key(seed: int, replicate: Column, key: Column) -> Column:
    """What rows of a replicate are ordered by: as good as random, and the same for every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), key.cast("string")))


def permuted(rows: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """(grp, replicate, key, moved), stored: ``value`` of ``rows(grp, key, ...)`` dealt anew among the keys of each group, once for each replicate."""
    base = placed(rows.select("grp", "key", value), ["grp"], ["key"], "at")
    many = base.select("grp", "key", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = many.withColumn("draw", shuffle_key(seed, F.col("replicate"), F.col("key")))
    dealt = placed(drawn, ["grp", "replicate"], ["draw", "key"], "at")
    out = stored(dealt.join(base.select("grp", "at", F.col(value).alias("moved")), ["grp", "at"]).select("grp", "replicate", "key", "moved"), "permuted")
    discard(base, dealt)
    return out


def mark_permutation(marks: DataFrame, replicates: int, seed: int, least: int = 6) -> DataFrame:
    """(grp, n, rho, z, p) of ``marks(grp, key, a, b)``: rank correlation against reassignments of ``a`` among the keys of a group.

    p counts replicates whose correlation is as far from 0 as the observed
    one, which counts as well. Marks that are null or NaN are left out; groups
    with fewer than ``least`` left, or without any spread, have nulls.
    """
    clean = marks.where("grp is not null and a is not null and b is not null and not isnan(a) and not isnan(b)").select("grp", "key", "a", "b")
    ranked = average_rank(average_rank(clean, ["grp"], "a", "key", "ra"), ["grp"], "b", "key", "rb")
    mean = ranked.groupBy("grp").agg(F.avg("ra").alias("ma"), F.avg("rb").alias("mb"), F.count("*").alias("n"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"), correlation("ra", "rb").alias("rho"))
    moved = permuted(ranked, "ra", replicates, seed).join(ranked.select("grp", "key", "rb"), ["grp", "key"])
    sums = moved.groupBy("grp", "replicate").agg(F.sum(F.col("moved") * F.col("rb")).alias("s"))
    each = sums.join(mean, "grp").withColumn("r", F.try_divide(F.col("s") / F.col("n") - F.col("ma") * F.col("mb"), F.sqrt(F.col("va") * F.col("vb"))))
    far = F.abs("r") >= F.abs("rho") - 1e-12
    one = each.groupBy("grp").agg(F.avg("r").alias("centre"), F.stddev_samp("r").alias("sd"), F.count(F.when(far, 1)).alias("far"))
    fine = (F.col("n") >= least) & (F.col("va") > 0) & (F.col("vb") > 0)
    found = mean.join(one, "grp").select("grp", "n", F.when(fine, F.col("rho")).alias("rho"), F.when(fine & (F.col("sd") > 0), F.try_divide(F.col("rho") - F.col("centre"), F.col("sd"))).alias("z"), F.when(fine, (F.col("far") + 1) / (replicates + 1)).alias("p"))
    return found


def envelope(curves: DataFrame, replicates: int) -> DataFrame:
    """(grp, at, observed, low, high, outside) of ``curves(grp, replicate, at, value)``, replicate 0 being the observed one: the largest and least values of the others at each place."""
    null = F.when(F.col("replicate") > 0, F.col("value"))
    one = curves.where(F.col("replicate") <= replicates).groupBy("grp", "at").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("observed"), F.min(null).alias("low"), F.max(null).alias("high"))
    return one.withColumn("outside", (F.col("observed") < F.col("low")) | (F.col("observed") > F.col("high")))


def global_rank(curves: DataFrame) -> DataFrame:
    """(grp, rank_p) of ``curves(grp, replicate, at, value)``: share of curves that are at least as extreme as curve 0.

    A curve is as extreme as its most extreme place: the smaller of its ranks
    from below and above among the curves of the group there, ties counting in
    full.
    """
    part = "partition by grp, at order by value"
    ranks = curves.selectExpr("grp", "replicate", f"least(rank() over ({part}), rank() over ({part} desc)) as r")
    depth = ranks.groupBy("grp", "replicate").agg(F.min("r").alias("depth"))
    own = depth.where("replicate = 0").select("grp", F.col("depth").alias("own"))
    return depth.join(own, "grp").groupBy("grp").agg(F.avg((F.col("depth") <= F.col("own")).cast("double")).alias("rank_p"))


def ratio_permutation(pairs: DataFrame, sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(grp, observed, null_median, p): median of min / max of the sizes of ``pairs(grp, a, b)`` against sizes dealt anew within each ring.

    ``sizes(grp, ring, key, size)`` has the sizes that may be dealt; ``a`` and
    ``b`` are keys. p counts replicates at or below the observed median.
    """
    rings = sizes.select(F.struct("grp", "ring").alias("grp"), "key", "size")
    moved = permuted(rings, "size", replicates, seed).select(F.col("grp.grp").alias("grp"), "replicate", "key", F.col("moved").alias("size"))
    every = moved.unionByName(sizes.select("grp", F.lit(0).alias("replicate"), "key", "size"))
    side = lambda c, name: every.select("grp", "replicate", F.col("key").alias(c), F.col("size").alias(name))
    both = pairs.select("grp", "a", "b").join(side("a", "sa"), ["grp", "a"]).join(side("b", "sb"), ["grp", "b", "replicate"])
    medians = both.groupBy("grp", "replicate").agg(F.percentile(F.least("sa", "sb") / F.greatest("sa", "sb"), F.lit(0.5)).alias("m"))
    own = medians.where("replicate = 0").select("grp", F.col("m").alias("observed"))
    null = medians.where("replicate > 0").join(own, "grp")
    return null.groupBy("grp", "observed").agg(F.percentile("m", F.lit(0.5)).alias("null_median"), ((F.count(F.when(F.col("m") <= F.col("observed"), 1)) + 1) / (replicates + 1)).alias("p"))

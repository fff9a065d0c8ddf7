"""Two-sample and nested statistics as grouped aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``part``, stored: ranges of the order, so that running sums need one window for each part and the totals of the parts before."""
    dealt = rows.repartitionByRange(*order)
    return stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")


def running(dealt: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Columns added to rows ``in_ranges``: running sums of expressions, and ``<name>_all``, their totals.

    Only one row of totals for each part goes through one task.
    """
    per_part = dealt.groupBy("part").agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
    offsets = per_part.selectExpr("part", *(f"coalesce(sum({k}) over (order by part rows between unbounded preceding and 1 preceding), 0) as {k}_before" for k in sums), *(f"sum({k}) over () as {k}_all" for k in sums))
    own = dealt.selectExpr("*", *(f"sum({e}) over (partition by part order by {order} rows unbounded preceding) as {k}_own" for k, e in sums.items()))
    joined = own.join(F.broadcast(offsets), "part")
    return joined.select(*(c for c in dealt.columns), *((F.col(f"{k}_own") + F.col(f"{k}_before")).alias(k) for k in sums), *(f"{k}_all" for k in sums))


def ks_distance(values: DataFrame, a: str, b: str) -> DataFrame:
    """Largest distance of the right-continuous distribution functions of groups a and b of values(grp, value)."""
    counts = values.where(F.col("grp").isin(a, b)).groupBy("value").agg(F.sum((F.col("grp") == a).cast("int")).alias("of_a"), F.sum((F.col("grp") == b).cast("int")).alias("of_b"))
    run = running(in_ranges(counts, "value"), "value", {"na": "of_a", "nb": "of_b"})
    return run.agg(F.max(F.abs(F.col("na") / F.col("na_all") - F.col("nb") / F.col("nb_all"))).alias("ks"))


def intraclass_correlation(values: DataFrame) -> DataFrame:
    """One-way ICC of values(grp, animal, value): share of variance between animals of each group, 0 at least.

    Squares are summed about the means, so large values lose no digits.
    """
    per = values.groupBy("grp", "animal").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    grand = per.groupBy("grp").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    off = F.col("m") - F.col("grand")
    top = per.join(grand, "grp").groupBy("grp").agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.sum(F.col("n") * off * off).alias("between"),
    )
    n0 = (F.col("total") - F.col("n2") / F.col("total")) / (F.col("k") - 1)
    ms_b, ms_w = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k"))
    var_b = F.greatest(F.lit(0.0), (ms_b - ms_w) / n0)
    return top.where("k >= 2 and total > k").select("grp", F.when(ms_w > 0, var_b / (var_b + ms_w)).alias("icc"))


def welch_t(values: DataFrame, a: str, b: str) -> DataFrame:
    """Welch's t and degrees of freedom of two groups of values(grp, value)."""
    of = lambda g: (F.when(F.col("grp") == g, F.col("value")),)
    (xa,), (xb,) = of(a), of(b)
    one = values.agg(F.avg(xa).alias("ma"), F.avg(xb).alias("mb"), (F.var_samp(xa) / F.count(xa)).alias("va"), (F.var_samp(xb) / F.count(xb)).alias("vb"), F.count(xa).alias("na"), F.count(xb).alias("nb"))
    total = F.col("va") + F.col("vb")
    return one.select(((F.col("ma") - F.col("mb")) / F.sqrt(total)).alias("t"), (total * total / (F.col("va") * F.col("va") / (F.col("na") - 1) + F.col("vb") * F.col("vb") / (F.col("nb") - 1))).alias("df"))


def average_ranks(values: DataFrame, column: str) -> Column:
    """Ranks within grp, ties averaged."""
    return F.expr(f"rank() over (partition by grp order by {column}) + (count(*) over (partition by grp, {column}) - 1) / 2.0D")


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where either side has no spread, which ``corr`` refuses."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of pairs(grp, a, b) of each group with four pairs or more."""
    ranked = pairs.select("grp", average_ranks(pairs, "a").alias("ra"), average_ranks(pairs, "b").alias("rb"))
    return ranked.groupBy("grp").agg(F.count("*").alias("n"), correlation("ra", "rb").alias("rho")).where("n >= 4")


def holm(tests: DataFrame) -> DataFrame:
    """Step-down adjusted p of tests(name, p); nulls are skipped and not counted.

    Ranks, and then the largest of the parts before, run over ranges of p.
    """
    ranked = running(in_ranges(tests.where("p is not null").select("name", "p"), "p", "name"), "p, name", {"k": "1"})
    step = ranked.withColumn("q", (F.col("k_all") - F.col("k") + 1) * F.col("p"))
    before = step.groupBy("part").agg(F.max("q").alias("q")).selectExpr("part", "max(q) over (order by part rows between unbounded preceding and 1 preceding) as before")
    own = step.selectExpr("part", "name", "p", "max(q) over (partition by part order by p, name rows unbounded preceding) as own")
    return own.join(F.broadcast(before), "part").select("name", "p", F.least(F.lit(1.0), F.greatest("own", "before")).alias("p_holm"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share."""
    p = successes / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def freedman_diaconis(values: DataFrame) -> DataFrame:
    """(grp, width): bin width 2 IQR n^(-1/3), with exact quartiles."""
    one = values.groupBy("grp").agg(F.percentile("value", F.lit(0.75)).alias("q3"), F.percentile("value", F.lit(0.25)).alias("q1"), F.count("*").alias("n"))
    return one.select("grp", (2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1 / 3))).alias("width"))


def rand_index(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labelings (a, b) from their contingency table."""
    two = lambda n: n * (n - 1) / 2
    table = labels.groupBy("a", "b").agg(F.count("*").alias("n"))
    cell = table.agg(F.sum(two(F.col("n"))).alias("cell"), F.sum("n").alias("total"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rows"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("cols"))
    joined = cell.join(F.broadcast(rows)).join(F.broadcast(cols))  # three single rows
    expected = F.col("rows") * F.col("cols") / two(F.col("total"))
    most = (F.col("rows") + F.col("cols")) / 2
    return joined.select(F.when(most != expected, (F.col("cell") - expected) / (most - expected)).otherwise(F.lit(1.0)).alias("ari"))


def two_level(values: DataFrame, order: str = "value") -> DataFrame:
    """Mean of animal means of each group of values(axon, animal, grp, value), with their sd and median; null keys don't count, and of repeated axons the first by ``order`` does."""
    once = values.where("grp is not null and animal is not null").groupBy("axon").agg(F.min(F.struct(F.col(order).alias("place"), "animal", "grp", "value")).alias("one")).select("axon", "one.animal", "one.grp", "one.value")
    animals = once.groupBy("grp", "animal").agg(F.avg("value").alias("m"), F.count("*").alias("axons"))
    return animals.groupBy("grp").agg(F.count("*").alias("animals"), F.sum("axons").alias("axons"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.percentile("m", F.lit(0.5)).alias("median"))

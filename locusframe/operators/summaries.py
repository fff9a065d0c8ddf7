"""Summaries of result tables over methods, animals, scopes and null values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mixed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, first, last) of the guard columns that hold more than one value; null and empty cells don't count."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*").where("value <> ''")
    return cells.groupBy("column", "value").agg(F.count("*").alias("rows")).groupBy("column").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")).where("n > 1")


def by_animal(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(animal, measure, n, mean, sd, t) of each measure: t tests the mean against 0."""
    long = rows.where("animal is not null").select("animal", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("m")).select("animal", "m.*").where("value is not null and not isnan(value)")
    one = long.groupBy("animal", "measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return one.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def over_scopes(rows: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """(scope, grp, n, animals, mean): each row counts in every scope whose condition it meets."""
    each = rows.withColumn("scope", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in scopes.items())))))
    return each.groupBy("scope", "grp").agg(F.count("*").alias("n"), F.countDistinct("animal").alias("animals"), F.avg("value").alias("mean"))


def readings(rows: DataFrame, levels: list[str], least_animals: int) -> DataFrame:
    """(grp, one column a level, median_spacing, evidence): counts of each reading; a group is evident if enough animals have the first level."""
    first = F.countDistinct(F.when(F.col("reading") == levels[0], F.col("animal")))
    counts = [F.count(F.when(F.col("reading") == level, 1)).alias(level) for level in levels]
    return rows.groupBy("grp").agg(*counts, F.percentile("spacing", F.lit(0.5)).alias("median_spacing"), (first >= least_animals).alias("evidence"))


def conclusions(long: DataFrame, spread: float = 0.1) -> DataFrame:
    """One row for each axon and readout of ``long(axon, method, readout, kind, is_reference, value, verdict)``: does the conclusion depend on the method?

    Least and largest value and their methods (of equal values the first by
    name), their range over the reference's value, and whether that is large.
    For readouts with verdicts: yes if one differs from the reference's, no if
    others agree with it, undetermined without a reference or another verdict.
    """
    ref = lambda c: F.max(F.when(F.col("is_reference"), F.col(c)))
    low = F.min(F.when(F.col("value").isNotNull(), F.struct("value", "method")))
    of = long.groupBy("axon", "readout", "kind").agg(
        ref("value").alias("reference_value"), ref("verdict").alias("reference_verdict"), F.count("*").alias("n_methods"), F.count("value").alias("n_values"),
        low.alias("low"), F.max("value").alias("max_value"), F.count("verdict").alias("n_verdicts"), F.count(F.when(~F.col("is_reference"), F.col("verdict"))).alias("n_others"),
        F.countDistinct("verdict").alias("kinds_of_verdict"), F.countDistinct(F.when(~F.col("is_reference"), F.col("verdict"))).alias("other_kinds"), F.max(F.when(~F.col("is_reference"), F.col("verdict"))).alias("other_verdict"),
    )
    of_high = long.where("value is not null").groupBy("axon", "readout", "value").agg(F.min("method").alias("max_method")).withColumnRenamed("value", "max_value")
    both = of.join(of_high, ["axon", "readout", "max_value"], "left")
    span = F.col("max_value") - F.col("low.value")
    relative = F.when(F.col("reference_value") != 0, span / F.abs("reference_value"))
    has_verdict = F.col("kind").isin("p_value", "verdict")
    differs = (F.col("other_kinds") > 1) | (F.col("other_verdict") != F.col("reference_verdict"))
    depends = F.when(~has_verdict, "spread only").when(F.col("reference_verdict").isNull() | (F.col("n_others") == 0), "undetermined").when(differs, "yes").otherwise("no")
    return both.select("axon", "readout", "kind", "reference_value", "n_methods", "n_values", F.col("low.value").alias("min_value"), F.col("low.method").alias("min_method"), "max_value", "max_method", span.alias("range"), relative.alias("relative_range"), F.when(~has_verdict, relative > spread).alias("large_spread"), depends.alias("depends"))


def over_axons(conclusion: DataFrame) -> DataFrame:
    """(readout, kind, n_axons, n_depends, n_undetermined, n_large_spread, median_relative_range)."""
    count = lambda c: F.count(F.when(c, 1))
    return conclusion.groupBy("readout", "kind").agg(F.count("*").alias("n_axons"), count(F.col("depends") == "yes").alias("n_depends"), count(F.col("depends") == "undetermined").alias("n_undetermined"), count(F.col("large_spread")).alias("n_large_spread"), F.percentile("relative_range", F.lit(0.5)).alias("median_relative_range"))


def z_scores(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(grp, z) of ``observed(grp, observed)`` among ``null(grp, value)``; null with fewer than two values or no spread."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    spread = null.groupBy("grp").agg(F.avg(finite).alias("m"), F.stddev_samp(finite).alias("sd"), F.count(finite).alias("n"))
    return observed.join(spread, "grp", "left").select("grp", F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("observed") - F.col("m")) / F.col("sd")).alias("z"))


def finite_summary(values: DataFrame) -> DataFrame:
    """(grp, n, median, positive): median and share above 0 of the finite values."""
    ok = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return values.groupBy("grp").agg(F.count(ok).alias("n"), F.percentile(ok, F.lit(0.5)).alias("median"), F.avg((ok > 0).cast("double")).alias("positive"))


def fisher_z(pairs: DataFrame) -> DataFrame:
    """(grp, n, r, z): correlation of ``pairs(grp, a, b)`` and its standard score, for groups of more than three."""
    one = pairs.groupBy("grp").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).where("n > 3 and abs(r) < 1")
    return one.withColumn("z", F.atanh("r") * F.sqrt(F.col("n") - 3))


def planned_runs(methods: DataFrame, reference: str) -> DataFrame:
    """(place, method, params, n): runs in order, the reference first, of equal ones the first; slow ones are refused."""
    once = methods.where("not slow").groupBy("method", "params").agg(F.min("asked").alias("asked"), F.count("*").alias("n"))
    ordered = once.withColumn("key", F.struct((F.col("method") != reference).alias("later"), "asked"))
    return ordered.selectExpr("cast(row_number() over (order by key) as int) as place", "method", "params", "n")


def tau_choices(values: DataFrame) -> DataFrame:
    """(tau, n) of values rounded to a hundredth."""
    return values.groupBy(F.bround("value", 2).alias("tau")).agg(F.count("*").alias("n"))


def fusion_scale(d50: Column) -> Column:
    """Half-way distance less 20, 0 at least."""
    return F.greatest(d50 - 20.0, F.lit(0.0))


def design_effect(icc: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, icc, effect, effective_n): 1 + (m - 1) icc with m the mean number of rows of an animal, and the rows over it."""
    of = sizes.groupBy("grp", "animal").agg(F.count("*").alias("n")).groupBy("grp").agg(F.avg("n").alias("m"), F.sum("n").alias("rows"))
    effect = 1 + (F.col("m") - 1) * F.col("icc")
    return icc.join(of, "grp").select("grp", "icc", effect.alias("effect"), (F.col("rows") / effect).alias("effective_n"))

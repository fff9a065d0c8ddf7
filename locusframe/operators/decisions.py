"""Decisions on rows: precedence of flags, set splits, differences of records, ranks among null values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_flags(decisions: DataFrame) -> DataFrame:
    """(key, method, flag): of all decisions on a key the one of highest precedence (smallest ``rank``), the latest of those, then the largest id.

    One aggregate with a partial step before the shuffle; no window over a key's decisions.
    """
    place = F.struct((-F.col("rank")).alias("minus"), "at", "id", "method", "flag")
    return decisions.groupBy("key").agg(F.max(place).alias("best")).select("key", "best.method", "best.flag")


def four_way(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """(grp, in_a, in_b, n): how many rows lie in both, one or none of two regions."""
    return rows.groupBy("grp", a.alias("in_a"), b.alias("in_b")).agg(F.count("*").alias("n"))


def record_differences(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(key, field, a, b) of every field in which two records of a key differ; a null equals a null.

    A key that one side alone has differs in field ``key``.
    """
    sides = [df.select("key", *(F.col(f).cast("string").alias(f"{s}_{f}") for f in fields), F.col("key").cast("string").alias(f"{s}_key")) for s, df in (("a", left), ("b", right))]
    pairs = sides[0].join(sides[1], "key", "full")
    alone = F.col("a_key").isNull() | F.col("b_key").isNull()
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in ("key", *fields))))
    return pairs.select("key", alone.alias("alone"), rows.alias("r")).select("key", "alone", "r.*").where("not (a <=> b) and (not alone or field = 'key')").drop("alone")


def central_position(stacks: DataFrame) -> DataFrame:
    """(grp, central): the middle position of ``stacks(grp, pos, n)``, positions from 0 on; of two middle ones the fuller, then the lower."""
    sized = stacks.join(stacks.groupBy("grp").agg(F.count("*").alias("size")), "grp")
    middle = sized.where("pos between floor((size - 1) / 2) and floor(size / 2)")
    return middle.groupBy("grp").agg(F.max(F.struct("n", (-F.col("pos")).alias("minus"))).alias("best")).select("grp", (-F.col("best.minus")).alias("central"))


def monte_carlo_p(values: DataFrame) -> DataFrame:
    """(grp, n, p, p_two_sided) of the observed value of each group among its null values, ``values(grp, observed, value)``.

    The rank p-value counts the observed value itself; two-sided is twice the smaller tail, at most 1.
    """
    slack = F.greatest(F.lit(1.0), F.abs("observed")) * 1e-12
    tail = lambda c: (F.lit(1.0) + F.count(F.when(c, 1))) / (F.count("value") + 1)
    both = values.groupBy("grp").agg(F.count("value").alias("n"), tail(F.col("value") >= F.col("observed") - slack).alias("p"), tail(F.col("value") <= F.col("observed") + slack).alias("low"))
    return both.select("grp", "n", "p", F.least(F.lit(1.0), 2 * F.least("p", "low")).alias("p_two_sided"))

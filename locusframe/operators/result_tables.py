"""Upserts, duplicate keys, stems, wide views and text cells of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and ``new``; a null key equals a null. Unequal columns are refused."""
    if set(old.columns) != set(new.columns):
        raise ValueError("the tables have other columns")
    known = new.select(*(F.col(k).alias(f"new_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"new_{k}"))
    return old.join(known, same, "left_anti").unionByName(new)


def duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows after the first of their key."""
    return rows.selectExpr("*", f"row_number() over (partition by {', '.join(keys)} order by {order}) as copy").where("copy > 1")


def wide(rows: DataFrame, key: str, column: str, names: list[str], value: str) -> DataFrame:
    """One row for each key with a column of sums for each name."""
    return rows.groupBy(key).agg(*(F.sum(F.when(F.col(column) == n, F.col(value))).alias(n) for n in names))


def cell_text(c: Column) -> Column:
    """Text that fits in a cell: semicolons become commas, line ends spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, ";", ","), "[\\r\\n]+", " "))


def fingerprint(rows: DataFrame, group: str, value: str, length: int = 16) -> DataFrame:
    """(group, fingerprint): hash of the sorted values of each group."""
    joined = F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), "\n")
    return rows.groupBy(group).agg(F.substring(F.sha2(joined, 256), 1, length).alias("fingerprint"))

"""Text scalars of localization tables as column expressions: names, keys, units, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed suffixes of column names and the units they state, longest first, and the suffix of values without discarded clusters.
UNITS = (("_nm2", "nm^2"), ("_um2", "um^2"), ("_nm", "nm"), ("_um", "um"), ("_px", "pixels"), ("_percent", "%"), ("_deg", "degrees"))
DISCARD = "_discard"
#: Genotypes that have one spelling.
GENOTYPES = ("WT", "KO")
NA = "NA"


def unit_of(name: Column) -> Column:
    """Unit that a column name states; empty if none."""
    base = F.regexp_replace(name, f"{DISCARD}$", "")
    out = None
    for suffix, unit in UNITS:
        out = F.when(base.endswith(suffix), unit) if out is None else out.when(base.endswith(suffix), unit)
    return out.when(base.startswith("fraction_") | base.startswith("share_"), "fraction (0-1)").otherwise("")


def genotype(value: Column) -> Column:
    """A known genotype in its spelling, whatever the case and the spaces around; others trimmed, null empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.upper(text).isin(*GENOTYPES), F.upper(text)).otherwise(text)


def first_match(path: Column, pattern: str) -> Column:
    """First group of the pattern, without regard to case; null where it does not match."""
    found = F.regexp_extract(path, f"(?i){pattern}", 1)
    return F.when(found != "", found)


def identity(path: Column) -> list[Column]:
    """genotype, animal, roi and axon read from a path."""
    return [genotype(first_match(path, "(?:^|[_/ ])(wt|ko)(?=[_/ .]|$)")).alias("genotype"), first_match(path, "animal[_ -]?(\\d+)").alias("animal"), first_match(path, "roi[_ -]?(\\d+)").alias("roi"), first_match(path, "axon[_ -]?(\\d+)").alias("axon")]


def date_of(path: Column) -> Column:
    """yymmdd at the start of the file name as yy.mm.dd; null for impossible dates."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    digits = F.regexp_extract(name, "^(?:20)?(\\d{6})(?!\\d)", 1)
    month, day = F.substring(digits, 3, 2).cast("int"), F.substring(digits, 5, 2).cast("int")
    return F.when((digits != "") & month.between(1, 12) & day.between(1, 31), F.concat_ws(".", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def trace_label(year: Column, roi: Column, axon: Column) -> Column:
    """year.ROI.axon, with NA for what is missing."""
    return F.concat_ws(".", *(F.coalesce(x, F.lit(NA)) for x in (year, roi, axon)))


def cluster_key(ring: Column, label: Column, x: Column, y: Column) -> Column:
    """Key of a cluster that a second run gives again: its ring, label and centroid to the nm."""
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return F.concat(F.lit("r"), ring.cast("string"), F.lit("_l"), label.cast("string"), F.lit("_x"), whole(x), F.lit("_y"), whole(y))


def guide_text(points: Column) -> Column:
    """x,y;x,y of an array of structs (x, y), to a tenth."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", F.format_string("%.1f", F.bround(p["x"], 1)), F.format_string("%.1f", F.bround(p["y"], 1)))), ";")


def guide_points(text: Column) -> Column:
    """The array of structs (x, y) of such a text; null if it is blank."""
    pairs = F.filter(F.split(F.trim(text), ";"), lambda p: F.trim(p) != "")
    return F.when(F.trim(text) != "", F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))))


def pair_key(n: Column, pairs: Column) -> Column:
    """n|a-b,a-b of an array of structs (a, b)."""
    return F.concat(n.cast("string"), F.lit("|"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))), ","))


def pair_key_parts(text: Column) -> tuple[Column, Column]:
    """n and the sorted array of structs (a, b) of such a key."""
    tail = F.filter(F.split(F.substring_index(F.trim(text), "|", -1), ","), lambda p: p != "")
    pairs = F.transform(tail, lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("a"), F.split(p, "-")[1].cast("int").alias("b")))
    return F.substring_index(F.trim(text), "|", 1).cast("int"), F.array_sort(pairs)


def with_suffix(path: Column, suffix: str) -> Column:
    """Path of a side file: the last extension of the file name replaced."""
    return F.concat(F.regexp_replace(path, "(?<=[^/])\\.[^./]*$", ""), F.lit(suffix))


def bool_cell(value: Column) -> Column:
    """True, False or NA."""
    return F.when(value.isNull(), NA).when(value, "True").otherwise("False")


def parsed_bool(text: Column) -> Column:
    return F.when(F.trim(text) == "True", True).when(F.trim(text) == "False", False)


def parsed_number(text: Column) -> Column:
    """The number in a cell; NaN for an empty one or NA."""
    return F.when(F.trim(text).isin("", NA), F.lit(float("nan"))).otherwise(F.trim(text).cast("double"))


def duration(seconds: Column) -> Column:
    """Seconds up to 90, minutes up to 90, then hours."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return F.when(s < 90, F.concat(whole(s), F.lit(" s"))).when(s < 5400, F.concat(whole(s / 60), F.lit(" min"))).otherwise(F.concat(F.format_string("%.1f", s / 3600), F.lit(" h")))


def time_left(share: Column, elapsed: Column) -> Column:
    """Straight-line estimate of the time left, in fixed words; empty below a share of 2 % or 10 s."""
    left = elapsed * (1 - share) / share
    whole = lambda c: F.bround(c, 0).cast("bigint")
    five = F.greatest(whole(left / 5) * 5, F.lit(5)).cast("string")
    words = F.when(left < 90, F.concat(F.lit("about "), five, F.lit(" s left"))).when(left < 5400, F.concat(F.lit("about "), whole(left / 60).cast("string"), F.lit(" min left"))).otherwise(F.concat(F.lit("about "), F.format_string("%.1f", left / 3600), F.lit(" h left")))
    return F.when((share >= 0.02) & (share < 1.0) & (elapsed >= 10), words).otherwise("")

"""Binding events over time: linking, collapse, dark times, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_sessions(locs: DataFrame, dark_frames: int) -> DataFrame:
    """Add ``session`` (from 1) to locs(grp, frame, event_id): a gap in time of more than ``dark_frames`` starts a new one. Linking in space is in ``paint``."""
    gap = locs.selectExpr("*", "frame - lag(frame) over (partition by grp order by frame, event_id) as gap")
    return gap.selectExpr("*", f"sum(case when gap is null or gap > {dark_frames + 1} then 1 else 0 end) over (partition by grp order by frame, event_id rows unbounded preceding) as session").drop("gap")


def collapse(sessions: DataFrame, last_frame: int) -> DataFrame:
    """One row for each session: first and last frame, length, localizations, plain mean and sum of x, and whether it is uncensored; means by precision are in ``paint``."""
    one = sessions.groupBy("grp", "session").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n_locs"), F.avg("x").alias("x_mean"), F.sum("x").alias("x_sum"))
    return one.withColumn("length", F.col("last") - F.col("first") + 1).withColumn("complete", (F.col("first") > 0) & (F.col("last") < last_frame))


def dark_times(events: DataFrame) -> DataFrame:
    """Frames since the latest end of all earlier events of the group; -1 for the first and for overlaps."""
    run = events.selectExpr("grp", "session", "first", "max(last) over (partition by grp order by first, session rows between unbounded preceding and 1 preceding) as before")
    return run.select("grp", "session", F.when(F.col("before") < F.col("first"), F.col("first") - F.col("before")).otherwise(F.lit(-1)).alias("dark"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n) of bins of equal width from 0."""
    return df.groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def next_frame_neighbours(locs: DataFrame, window: float) -> DataFrame:
    """Nearest localization of the same group in the following frame, closer than ``window``: event_id, other, d."""
    later = locs.select("grp", (F.col("frame") - 1).alias("frame"), F.col("event_id").alias("other"), F.col("x").alias("other_x"))
    pairs = locs.join(later, ["grp", "frame"]).withColumn("d", F.abs(F.col("x") - F.col("other_x"))).where(F.col("d") < window)
    return pairs.groupBy("event_id").agg(F.min(F.struct("d", "other")).alias("best")).select("event_id", "best.other", "best.d")


def revisit_fraction(events: DataFrame, gap: int) -> DataFrame:
    """Share of each group's events that follow another within ``gap`` frames."""
    back = events.selectExpr("grp", "first - lag(last) over (partition by grp order by first, session) as since")
    return back.groupBy("grp").agg(F.avg(F.when(F.col("since") <= gap, 1.0).otherwise(0.0)).alias("revisit"), F.count("*").alias("n_events"))

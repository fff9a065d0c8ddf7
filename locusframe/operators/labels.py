"""Labels looked up, shared and matched: equi-joins, contingency tables, nearest decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import in_ranges


def labels_at(points: DataFrame, reference: DataFrame) -> DataFrame:
    """``points`` with the label of the reference point at exactly the same x, y, z; -1 where there is none, the lowest of several."""
    one = reference.groupBy("x", "y", "z").agg(F.min("label").alias("label"))
    return points.join(one, ["x", "y", "z"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def states_of(points: DataFrame, discarded: DataFrame) -> DataFrame:
    """``points`` with state noise, discarded or kept, told by their label."""
    gone = discarded.select("label", F.lit(True).alias("gone")).distinct()
    state = F.when(F.col("label") < 0, "noise").when(F.col("gone"), "discarded").otherwise("kept")
    return points.join(gone, "label", "left").withColumn("state", state).drop("gone")


def shared_events(events: DataFrame) -> DataFrame:
    """(a, b, only_a, only_b, shared) of every pair of labels that share an event, ``events(event, label)``.

    Pairs are made within an event, so labels without a common event never meet.
    """
    own = events.where("label >= 0").select("event", "label").distinct()
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    pairs = own.select("event", F.col("label").alias("a")).join(own.select("event", F.col("label").alias("b")), "event").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = pairs.join(sizes.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), "shared")


def correspondence(labels: DataFrame) -> DataFrame:
    """(a, kind, n_parts): what became of each cluster of labelling a in labelling b, by majority; ``labels(a, b)`` with -1 for noise.

    A cluster is missed if most of its points are noise, split if two clusters
    of b have it as their majority, merged if the one that has it is the
    majority of another too, else one-to-one.
    """
    table = labels.where("a >= 0 or b >= 0").groupBy("a", "b").agg(F.count("*").alias("n"))
    of_b = table.where("b >= 0").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("minus"))).alias("best")).select("b", (-F.col("best.minus")).alias("a"))
    of_a = table.where("a >= 0").groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("minus"))).alias("best")).select("a", (-F.col("best.minus")).alias("b"))
    parts = of_b.where("a >= 0").groupBy("a").agg(F.count("*").alias("n_parts"))
    heads = of_a.where("b >= 0").groupBy("b").agg(F.count("*").alias("n_heads"))
    both = of_a.join(parts, "a", "left").join(heads, "b", "left")
    kind = F.when(F.col("b") < 0, "missed").when(F.coalesce("n_parts", F.lit(0)) > 1, "split").when(F.col("n_heads") > 1, "merged").otherwise("one-to-one")
    return both.select("a", kind.alias("kind"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


def matched_decisions(pairs: DataFrame) -> DataFrame:
    """(cluster, decision, d) of ``pairs(cluster, decision, d)`` within the tolerance: each decision goes to its nearest cluster, and of several on one the last counts."""
    nearest = pairs.groupBy("decision").agg(F.min(F.struct("d", "cluster")).alias("best")).select("decision", "best.cluster", "best.d")
    return nearest.groupBy("cluster").agg(F.max(F.struct("decision", "d")).alias("last")).select("cluster", "last.decision", "last.d")


def holds_all(points: DataFrame, regions: dict[str, Column]) -> DataFrame:
    """(grp, region, inside, all_inside) of each group and region."""
    counts = points.groupBy("grp").agg(F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(k) for k, c in regions.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("region"), F.col(k).alias("inside"), (F.col(k) == F.col("n")).alias("all_inside")) for k in regions)))
    return counts.select("grp", rows.alias("r")).select("grp", "r.*")


def distinct_values(values: DataFrame, tolerance: float) -> DataFrame:
    """(grp, value) ascending, leaving out each that is within the tolerance of one that stays; equal values are aggregated first."""
    few = values.groupBy("grp", "value").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sort_array(F.collect_list("value")).alias("all"))
    step = lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x - F.element_at(kept, -1) > tolerance, F.concat(kept, F.array(x))).otherwise(kept)
    return few.select("grp", F.explode(F.aggregate("all", F.array().cast("array<double>"), step)).alias("value"))


def duplicate_labels(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(label, n, first, last) of the labels that more than one row has."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).where("n > 1")


def unique_best(candidates: DataFrame) -> DataFrame:
    """(key, candidate) of the highest score of each key, if one candidate alone has it."""
    top = candidates.groupBy("key", "score").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    best = top.groupBy("key").agg(F.max(F.struct("score", "n", "candidate")).alias("best"))
    return best.where("best.n = 1").select("key", "best.candidate")


def nearest_angle(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, id, offset) in degrees from each angle of ``a(grp, id, turn)`` to the nearest of ``b(grp, turn)`` of the group.

    Both sides are dealt to ranges of group and angle, and an angle meets the
    one before and the one after it by running windows within a range, or at
    the ends of the ranges before and after; no pairs are made.
    """
    both = a.select("grp", "id", "turn").unionByName(b.select("grp", F.lit(None).cast("bigint").alias("id"), "turn"))
    dealt = in_ranges(both.where("grp is not null"), "grp", "turn")
    marked = dealt.withColumn("other", F.when(F.col("id").isNull(), F.col("turn")))
    edges = marked.groupBy("part", "grp").agg(F.min("other").alias("low"), F.max("other").alias("high")).selectExpr(
        "part", "grp", "max(high) over (partition by grp order by part rows between unbounded preceding and 1 preceding) as earlier",
        "min(low) over (partition by grp order by part desc rows between unbounded preceding and 1 preceding) as later",
        "min(low) over (partition by grp) as least", "max(high) over (partition by grp) as most",
    )
    # Backwards too the frame ends at the row: one that begins there is gone through anew for every row.
    seen = marked.selectExpr(
        "part", "grp", "id", "turn", "last_value(other) ignore nulls over (partition by part, grp order by turn, id nulls first rows between unbounded preceding and current row) as before",
        "last_value(other) ignore nulls over (partition by part, grp order by turn desc, id desc nulls last rows between unbounded preceding and current row) as after",
    ).where("id is not null")
    apart = lambda x: F.least(F.abs(F.col("turn") - x), 360.0 - F.abs(F.col("turn") - x))
    placed = seen.join(edges, ["part", "grp"]).where("least is not null")
    return placed.select("grp", "id", F.least(*(apart(F.col(c)) for c in ("before", "after", "earlier", "later", "least", "most"))).alias("offset"))

"""One-to-one assignment of two point sets within a tolerance: as many pairs as can be, and of those the least total distance."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .clusters import components


def candidate_pairs(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(grp, a, b, d, n_a, n_b) of places ``left(grp, id, x, y, n)`` and ``right`` of the same group within ``tolerance``, by a join on grid cells."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    one = left.select("grp", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("x").alias("ax"), F.col("y").alias("ay"), near.alias("c")).select("grp", "a", "n_a", "ax", "ay", "c.*")
    two = right.select("grp", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return one.join(two, ["grp", "cx", "cy"]).withColumn("d", d).where(F.col("d") <= tolerance).select("grp", "a", "b", "d", "n_a", "n_b")


def transported(links: list[tuple[int, int, float]], many_a: dict[int, int], many_b: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many go from a to b, of links (a, b, d): as many as can be, of the least total distance; a has ``many_a`` and b room for ``many_b``.

    Augmenting paths of least added distance, each of which moves as many as
    it can. Potentials keep the lengths of steps from being negative, so that
    each path is found nearest first; other paths of the same length follow
    without another search by distance.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, d in sorted(links):
        near.setdefault(a, []).append((b, d))
    cost = {(a, b): d for a, b, d in links}
    high = {("a", a): 0.0 for a in near} | {("b", b): 0.0 for _, b, _ in links}
    left, room = {a: many_a[a] for a in near}, {b: many_b[b] for _, b, _ in links}
    flow: dict[tuple[int, int], int] = {}
    to_b: dict[int, list[int]] = {b: [] for b in room}  # those with flow to b
    ended = 0.0  # the potential beyond the last b

    def move(path: list[int]) -> None:
        """Along a, b, a, b, ...: forward to each b, back from each but the last."""
        steps = list(zip(path[::2], path[1::2], strict=True))
        backs = list(zip(path[2::2], path[1:-1:2], strict=True))
        many = min(left[path[0]], room[path[-1]], *(flow[e] for e in backs))
        left[path[0]] -= many
        room[path[-1]] -= many
        for a, b in steps:
            if not flow.get((a, b)):
                to_b[b].append(a)
            flow[a, b] = flow.get((a, b), 0) + many
        for a, b in backs:
            flow[a, b] -= many
            if not flow[a, b]:
                to_b[b].remove(a)

    def level(start: int, dead: set[int]) -> list[int] | None:
        """A path that adds no length, depth first; b in ``dead`` lead nowhere."""
        path, ways = [start], [iter(near[start])]
        while ways:
            a = path[-1]
            for b, d in ways[-1]:
                if b in dead or d + high["a", a] - high["b", b] > 0:
                    continue
                dead.add(b)
                if room[b] and high["b", b] - ended <= 0:
                    dead.difference_update([*path, b][1::2])
                    return [*path, b]
                back = [x for x in to_b[b] if x not in path[::2] and high["b", b] - cost[x, b] - high["a", x] <= 0]
                if back:
                    path += [b, back[0]]
                    ways.append(iter(near[back[0]]))
                    break
            else:
                ways.pop()
                path = path[:-2]
        return None

    while True:
        heap: list = [(0.0, "a", a, a) for a in near if left[a]]
        heapq.heapify(heap)
        seen: dict[tuple[str, int], float] = {}
        before: dict[tuple[str, int], int] = {}
        end = None
        while heap:
            v, kind, x, by = heapq.heappop(heap)
            if kind == "end":
                end, length = x, v
                break
            if (kind, x) in seen:
                continue
            seen[kind, x] = v
            before[kind, x] = by
            if kind == "a":
                for b, d in near[x]:
                    if ("b", b) not in seen:
                        heapq.heappush(heap, (v + max(0.0, d + high["a", x] - high["b", b]), "b", b, x))
                continue
            for a in to_b[x]:
                heapq.heappush(heap, (v + max(0.0, high["b", x] - cost[a, x] - high["a", a]), "a", a, x))
            if room[x]:
                heapq.heappush(heap, (v + max(0.0, high["b", x] - ended), "end", x, x))
        if end is None:
            return {e: n for e, n in flow.items() if n}
        for node in high:
            high[node] += min(seen.get(node, length), length)
        ended += length
        path = [end]
        while True:
            a = before["b", path[0]]
            path.insert(0, a)
            if left[a]:
                break
            path.insert(0, before["a", a])
        move(path)
        dead: set[int] = set()
        for a in near:
            while left[a] and (found := level(a, dead)):
                move(found)


def assigned(links: list[tuple[int, int, float]]) -> dict[int, int]:
    """Partner of each a that gets one, of links (a, b, d): as many as can be, of the least total distance."""
    return {a: b for a, b in transported(links, {a: 1 for a, _, _ in links}, {b: 1 for _, b, _ in links})}


def match(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """(grp, a, b, d): pairs of ``left(grp, id, x, y)`` and ``right`` of the same group, each point in one at most.

    Of all ways to pair points within ``tolerance`` that with most pairs, and
    of those that of least total distance. Points that share a place are one
    node that counts as many, and pair in the order of their ids. Pairs of
    places that have no other candidate are taken at once. The rest falls into
    components of the graph of candidates, which share no point; each is
    solved by itself. Where the tolerance passes the spacing of the points a
    component, and with it the work of one task, can be as large as a group.
    Points without a place (null, NaN) and null groups have no partner.
    """
    placed = lambda df: df.where("grp is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = lambda df: placed(df).groupBy("grp", "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    links = stored(candidate_pairs(spots(left), spots(right), tolerance), "candidate-pairs")
    many = lambda c: links.groupBy("grp", c).agg(F.count("*").alias(f"links_{c}"))
    counted = links.join(many("a"), ["grp", "a"]).join(many("b"), ["grp", "b"])
    none = F.lit(0).cast("long")
    alone = counted.where("links_a = 1 and links_b = 1").select("grp", "a", "b", "d", none.alias("from_a"), none.alias("from_b"), F.least("n_a", "n_b").alias("n"))
    open_links = stored(counted.where("links_a > 1 or links_b > 1").select("grp", "a", "b", "d", "n_a", "n_b", F.struct("grp", F.lit(0).alias("side"), F.col("a").alias("id")).alias("of_a"), F.struct("grp", F.lit(1).alias("side"), F.col("b").alias("id")).alias("of_b")), "open-pairs")
    ends = open_links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comps = components(both.select(F.col("a").alias("id")).distinct(), both)
    columns = alone.columns

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["a", "b"])
        flow = transported(list(part[["a", "b", "d"]].itertuples(index=False, name=None)), dict(zip(part["a"], part["n_a"], strict=True)), dict(zip(part["b"], part["n_b"], strict=True)))
        part["n"] = [flow.get(e, 0) for e in zip(part["a"], part["b"], strict=True)]
        for c in "ab":
            part[f"from_{c}"] = part.groupby(c)["n"].cumsum() - part["n"]
        return part[part["n"] > 0][columns]

    grouped = open_links.join(comps.select(F.col("id").alias("of_a"), "root"), "of_a").select("grp", "a", "b", "d", "n_a", "n_b", "root")
    solved = stored(grouped.groupBy("root").applyInPandas(solve, alone.schema), "solved-pairs")
    moved = alone.unionByName(solved).select("grp", "a", "b", "d", "from_a", "from_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    moved = moved.select("grp", "a", "b", "d", (F.col("from_a") + F.col("i")).alias("k_a"), (F.col("from_b") + F.col("i")).alias("k_b"))
    ids = lambda df, c: placed(df).selectExpr("grp", f"min(id) over (partition by grp, x, y) as {c}", f"row_number() over (partition by grp, x, y order by id) - 1L as k_{c}", f"id as id_{c}")
    named = moved.join(ids(left, "a"), ["grp", "a", "k_a"]).join(ids(right, "b"), ["grp", "b", "k_b"])
    found = stored(named.select("grp", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d"), "pairs")
    discard(links, open_links, solved)
    return found


def unmatched(points: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Points of one side (``a`` or ``b``) that have no partner in ``pairs``."""
    return points.join(pairs.select("grp", F.col(side).alias("id")), ["grp", "id"], "left_anti")


def match_summary(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, n_a, n_b, n_pairs, total, share): points, pairs, their distance, and the share of the smaller side that is paired."""
    size = lambda df, name: df.groupBy("grp").agg(F.count("*").alias(name))
    got = pairs.groupBy("grp").agg(F.count("*").alias("n_pairs"), F.sum("d").alias("total"))
    joined = size(left, "n_a").join(size(right, "n_b"), "grp", "full").join(got, "grp", "left").fillna(0, ["n_a", "n_b", "n_pairs"]).fillna(0.0, ["total"])
    least = F.least("n_a", "n_b")
    return joined.select("grp", "n_a", "n_b", "n_pairs", "total", F.when(least > 0, F.col("n_pairs") / least).alias("share"))

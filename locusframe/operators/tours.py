"""Closed contours through the nodes of a group: the shortest of improved tours from many starts, each of which is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contours of up to so many nodes are solved by going through all sets of nodes.
EXACT = 9
#: Small contours of one size that are solved at once.
AT_ONCE = 2000


def shortest_tours(d: np.ndarray) -> np.ndarray:
    """The shortest closed tour from node 0 of each small distance matrix of ``d``, by dynamic programming over sets of visited nodes; ties go to smaller nodes."""
    g, n = d.shape[:2]
    each = np.arange(g)
    best = {(1 << k, k): d[:, 0, k] for k in range(1, n)}
    way = np.zeros((1 << (n - 1), n, g), np.int8)
    for full in range(2, 1 << n, 2):
        inside = [k for k in range(1, n) if full >> k & 1]
        for k in inside if len(inside) > 1 else []:
            rest, others = full ^ (1 << k), [j for j in inside if j != k]
            lengths = np.stack([best[rest, j] + d[:, j, k] for j in others])
            at = lengths.argmin(axis=0)
            best[full, k] = lengths[at, each]
            way[full >> 1, k] = np.array(others, np.int8)[at]
    full = np.full(g, (1 << n) - 2)
    k = 1 + np.stack([best[(1 << n) - 2, j] + d[:, j, 0] for j in range(1, n)]).argmin(axis=0)
    tours = np.zeros((g, n), np.int64)
    for place in range(n - 1, 0, -1):
        tours[:, place] = k
        full, k = full ^ (1 << k), way[full >> 1, k, each].astype(np.int64)
    return tours


def shortest_tour(d: np.ndarray) -> list[int]:
    """The shortest closed tour of one small distance matrix."""
    return shortest_tours(d[None])[0].tolist()


def improved(d: np.ndarray, tour: np.ndarray) -> np.ndarray:
    """The tour after turning around, time and again, the stretch whose ends save most, until none does."""
    slack = 1e-9 * max(float(d.max()), 1e-300)
    while True:
        here, there = tour, np.roll(tour, -1)
        now = d[here, there]
        # Edge i and edge j are replaced by (i, j) and (i + 1, j + 1).
        gain = np.triu(now[:, None] + now[None, :] - d[np.ix_(here, here)] - d[np.ix_(there, there)], 2)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[i, j] <= slack:
            return tour
        tour = np.concatenate([tour[: i + 1], tour[i + 1 : j + 1][::-1], tour[j + 1 :]])


def contour_tours(nodes: DataFrame, starts: int | None = None) -> DataFrame:
    """(grp, length, path): the closed tour of ``nodes(grp, id, x, y)`` of each group with three nodes or more; ``path`` has the ids in order.

    Nodes in the order of their angle about their mean, begun at each node in
    turn (or at ``starts`` of them, evenly spread), are improved until no
    stretch can be turned around to advantage; the shortest tour counts. Starts
    are rows, so a contour is as many tasks as it has starts, each with its
    nodes. Up to EXACT nodes the shortest tour of all is found. A path begins
    at the smallest id and goes on to the smaller of its neighbours; nodes
    without a place are left out.
    """
    placed = nodes.where("grp is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("grp", "id", "x", "y")
    lists = placed.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p")).withColumn("n", F.size("p")).where("n >= 3")
    many = F.when(F.col("n") <= EXACT, 1).otherwise(F.col("n") if starts is None else F.least(F.col("n"), F.lit(starts)))
    dealt = lists.select("grp", "n", many.alias("many"), F.col("p.id").alias("ids"), F.col("p.x").cast("array<double>").alias("xs"), F.col("p.y").cast("array<double>").alias("ys"))
    dealt = dealt.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1))).repartition("grp", "start")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, ys = (batch.column(c).flatten() for c in ("ids", "xs", "ys"))
            sizes, start, many = (batch.column(c).to_numpy() for c in ("n", "start", "many"))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
            p = np.stack([xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False)], axis=1)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                step = AT_ONCE if n <= EXACT else 1
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    own = p[first[some][:, None] + np.arange(n)]
                    d = np.hypot(own[:, :, None, 0] - own[:, None, :, 0], own[:, :, None, 1] - own[:, None, :, 1])
                    if n <= EXACT:
                        tours = shortest_tours(d)
                    else:
                        rel = own[0] - own[0].mean(axis=0)
                        order = np.lexsort((np.arange(n), np.arctan2(rel[:, 1], rel[:, 0])))
                        tour = improved(d[0], np.roll(order, -(int(start[some[0]]) * int(n) // int(many[some[0]]))))
                        tours = np.roll(tour, -int(np.argmin(tour)))[None]
                    back = tours[:, -1] < tours[:, 1]
                    tours[back, 1:] = tours[back, :0:-1]
                    length = d[np.arange(len(some))[:, None], tours, np.roll(tours, -1, axis=1)].sum(axis=1)
                    path = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * int(n), pa.int32()), ids.take(pa.array((first[some][:, None] + tours).ravel())))
                    yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(some)), pa.array(length), path], names=["grp", "length", "path"])

    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}
    found = dealt.mapInArrow(search, f"grp {kind['grp']}, length double, path array<{kind['id']}>")
    # Lengths of one tour from two starts may differ in the last digits, so equal paths are one.
    return found.groupBy("grp").agg(F.min(F.struct(F.round("length", 9).alias("length"), "path")).alias("best")).select("grp", "best.length", "best.path")


def tour_steps(tours: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, pos, id, x, y, step): the nodes of a tour in order, each with the distance to the next one."""
    placed = tours.select("grp", F.posexplode("path").alias("pos", "id"), F.size("path").alias("n")).join(nodes.select("grp", "id", "x", "y"), ["grp", "id"])
    ahead = placed.select("grp", F.expr("(pos + n - 1) % n").alias("pos"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return placed.join(ahead, ["grp", "pos"]).select("grp", "pos", "id", "x", "y", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("step"))

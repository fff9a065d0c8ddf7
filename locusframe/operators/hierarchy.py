"""Hierarchical density clustering: spanning tree of mutual reachability, condensed tree, most stable clusters.

Points of no core distance are equal to others, and of each such place only the
first goes into the tree; the others hang on it. Up to FEW points the tree is
one task, which grows it point by point. Beyond, it grows by Boruvka rounds:
every component takes its lightest outgoing edge. Points are summed up by component and grid cell, so that only
pairs of cells that can hold such an edge are looked into, within a radius that
grows from round to round. The condensed tree is made range
by range of edge weights: the components of a range are independent of each
other, and each is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored
from .clusters import components, numbered
from .neighbours import nearest
from .regions import distance
from .statistics import in_ranges, running

#: Edges of one component that a task goes through at most, unless the lightest of a range are more.
EDGES = 500_000
#: Points whose tree one task makes; its work is their square, its memory is in proportion to them.
FEW = 10_000
#: Equal points are this far apart, so that their density is finite.
NEAREST = 1e-9


def core_distances(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, x, y, core): distance to the k-th nearest other point, or to the farthest where there are fewer; points without a place have none."""
    found = nearest(points, k, radius).groupBy("id").agg(F.max("d").alias("core"))
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return placed.select("id", "x", "y").join(found, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def _outgoing(nodes: DataFrame, r: float) -> DataFrame:
    """(comp, w, a, b, other): the lightest edge of each component to another one, if it weighs ``r`` at most; ties go to smaller ids."""
    s = r / 2
    placed = nodes.withColumn("cx", F.floor(F.col("x") / s)).withColumn("cy", F.floor(F.col("y") / s))
    cells = placed.groupBy("comp", "cx", "cy").agg(F.min("core").alias("c0")).withColumn("gx", F.expr("cx div 2 - if(cx < 0 and cx % 2 <> 0, 1, 0)")).withColumn("gy", F.expr("cy div 2 - if(cy < 0 and cy % 2 <> 0, 1, 0)"))
    around = lambda x, y, moves: F.explode(F.array(*(F.struct((F.col(x) + i).alias(x), (F.col(y) + j).alias(y)) for i, j in moves))).alias("c")
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = cells.groupBy("gx", "gy").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).select("lo", "hi", around("gx", "gy", square))
    mixed = spread.groupBy("c.gx", "c.gy").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("gx", "gy")
    edge = cells.join(mixed, ["gx", "gy"], "left_semi").select("comp", "cx", "cy", "c0")
    wide = [(i, j) for i in range(-3, 4) for j in range(-3, 4)]
    one = edge.select(F.col("comp").alias("ca"), F.col("c0").alias("c0a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), around("cx", "cy", wide)).select("ca", "c0a", "ax", "ay", "c.cx", "c.cy")
    two = edge.select(F.col("comp").alias("cb"), F.col("c0").alias("c0b"), "cx", "cy")
    apart = [F.abs(F.col(p) - F.col(q)) for p, q in (("ax", "cx"), ("ay", "cy"))]
    near = s * F.sqrt(sum(F.pow(F.greatest(d - 1, F.lit(0)), 2) for d in apart))
    far = s * F.sqrt(sum(F.pow(d + 1, 2) for d in apart))
    pairs = one.join(two, ["cx", "cy"]).where("ca <> cb").select("*", F.greatest("c0a", "c0b", near).alias("low"), F.greatest("c0a", "c0b", far).alias("high")).where(F.col("low") <= r)
    bound = pairs.groupBy("ca").agg(F.min("high").alias("bound"))
    pairs = pairs.join(bound, "ca").where(F.col("low") <= F.col("bound") * (1 + 1e-9)).select("ca", "ax", "ay", "cb", F.col("cx").alias("bx"), F.col("cy").alias("by"))
    side = lambda c, x, y, q: placed.select(F.col("comp").alias(c), F.col("cx").alias(x), F.col("cy").alias(y), F.col("id").alias(f"i{q}"), F.col("x").alias(f"x{q}"), F.col("y").alias(f"y{q}"), F.col("core").alias(f"core{q}"))
    both = pairs.join(side("ca", "ax", "ay", "1"), ["ca", "ax", "ay"]).join(side("cb", "bx", "by", "2"), ["cb", "bx", "by"])
    w = F.greatest("core1", "core2", distance(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")))
    best = both.withColumn("w", w).where(F.col("w") <= r).groupBy("ca").agg(F.min(F.struct("w", F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"), F.col("cb").alias("other"))).alias("best"))
    return best.select(F.col("ca").alias("comp"), "best.*")


def _tree_of_few(part: pd.DataFrame) -> pd.DataFrame:
    """The least spanning tree of points, ties by (w, a, b): the lightest edge out of the tree is added until no point is left."""
    ids, x, y, core = (part[c].to_numpy() for c in ("id", "x", "y", "core"))
    n, here = len(ids), 0
    w, a, b = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    out = np.ones(n, bool)
    edges = []
    for _ in range(n - 1):
        out[here] = False
        dx, dy = x - x[here], y - y[here]
        now = np.maximum(np.maximum(core, core[here]), np.sqrt(dx * dx + dy * dy))
        low, high = np.minimum(ids, ids[here]), np.maximum(ids, ids[here])
        better = out & ((now < w) | ((now == w) & ((low < a) | ((low == a) & (high < b)))))
        w[better], a[better], b[better] = now[better], low[better], high[better]
        left = np.flatnonzero(out)
        tied = left[w[left] == w[left].min()]
        here = tied[np.lexsort((b[tied], a[tied]))[0]]
        edges.append((a[here], b[here], w[here]))
    return pd.DataFrame(edges, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})


def spanning_tree(points: DataFrame) -> DataFrame:
    """(a, b, w), stored: the least spanning tree of ``points(id, x, y, core)`` by mutual reachability, ties by (w, a, b).

    An edge weighs the largest of the two core distances and the distance.
    Every edge of at most the radius is within it, so what is taken is right
    for all pairs, though few are ever formed.
    """
    # Edges of no weight come first, those from the smallest id of a place before the others of the place.
    equal = points.where("core = 0").selectExpr("min(id) over (partition by x, y) as a", "id as b")
    copies = stored(equal.where("a <> b").select("a", "b", F.lit(0.0).alias("w")), "tree-of-copies")
    nodes = stored(points.join(copies.select(F.col("b").alias("id")), "id", "left_anti").withColumn("comp", F.col("id")), "tree-nodes")
    n, r, *ends = nodes.agg(F.count("*"), F.percentile_approx("core", 0.5), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    none = points.sparkSession.createDataFrame([], f"a {points.schema['id'].dataType.simpleString()}, b {points.schema['id'].dataType.simpleString()}, w double")
    if not n:
        return stored(none, "tree")
    if n <= FEW and points.schema["id"].dataType.simpleString() == "bigint":
        out = stored(nodes.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_tree_of_few, "a long, b long, w double").unionByName(copies), "tree")
        discard(nodes, copies)
        return out
    wide, high = ends[1] - ends[0], ends[3] - ends[2]
    reach = (wide**2 + high**2) ** 0.5 or 1.0
    # At least as far as points are from each other where they lie evenly.
    r, parts, left = max(2 * (r or 0.0), (wide * high / n) ** 0.5, reach * 1e-6), [copies], n
    while left > 1:
        found = stored(_outgoing(nodes, r), "lightest")
        taken = found.select("a", "b", "w").distinct()
        many = taken.count()
        if not many:
            discard(found)
            # Core distances can exceed the distances, and with them every weight.
            r *= 4
            continue
        parts.append(stored(taken, "tree"))
        links = found.select(F.col("comp").alias("a"), F.col("other").alias("b"))
        merged = components(nodes.select(F.col("comp").alias("id")).distinct(), links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        old, nodes = nodes, stored(nodes.join(merged.select(F.col("id").alias("comp"), "root"), "comp").select("id", "x", "y", "core", F.col("root").alias("comp")), "tree-nodes")
        discard(old, found)
        left -= many
        r *= 1.5  # components grow, and so do the gaps between them
    out = none
    for part in parts:
        out = out.unionByName(part)
    out = stored(out, "tree")
    discard(nodes, *parts)
    return out


_ROWS = "kind string, root long, size long, cluster long, total double, below double, parent long, birth double, stability double, own boolean"


def _merged(key: tuple, edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """Goes up the edges of one component: states of it at the end, clusters that end, and parts that join a cluster."""
    above: dict[int, int] = {}
    state: dict[int, list] = {}  # root: size, open cluster, sum of densities at which points leave it, worth of clusters below
    parts: dict[int, list[int]] = {}  # roots of the range that are in no cluster yet
    for side in ("a", "b"):
        for root, size, cluster, total, below in edges[[f"root_{side}", f"size_{side}", f"cluster_{side}", f"total_{side}", f"below_{side}"]].itertuples(index=False):
            if root not in state:
                state[root] = [int(size), None if pd.isna(cluster) else int(cluster), total, below]
                parts[root] = [root] if pd.isna(cluster) else []

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out: list[dict] = []
    for e, w, a, b in edges.sort_values("e")[["e", "w", "root_a", "root_b"]].itertuples(index=False):
        a, b = top(a), top(b)
        density = 1.0 / max(w, NEAREST)
        (na, ca, ta, la), (nb, cb, tb, lb) = state.pop(a), state.pop(b)
        below = 0.0
        if ca is not None and cb is not None:  # both are clusters, which end here
            for n, c, t, under in ((na, ca, ta, la), (nb, cb, tb, lb)):
                worth = t - n * density
                out.append({"kind": "cluster", "cluster": c, "parent": int(e), "size": n, "birth": density, "stability": worth, "own": worth >= under})
                below += max(worth, under)
            now = [na + nb, int(e), (na + nb) * density, below]
        elif ca is not None or cb is not None:
            c, t, under, small = (ca, ta, la, nb) if ca is not None else (cb, tb, lb, na)
            now = [na + nb, c, t + small * density, under]
        else:
            now = [na + nb, int(e) if na + nb >= least else None, (na + nb) * density if na + nb >= least else 0.0, 0.0]
        loose = parts.pop(a) + parts.pop(b)
        if now[1] is not None:
            out += [{"kind": "part", "root": r, "cluster": now[1], "birth": density} for r in loose]
            loose = []
        low, high = min(a, b), max(a, b)
        above[high] = low
        state[low], parts[low] = now, loose
    out += [{"kind": "state", "root": int(key[0]), "size": n, "cluster": c, "total": t, "below": u} for n, c, t, u in state.values()]
    return pd.DataFrame(out).reindex(columns=[x.split()[0] for x in _ROWS.split(", ")]).astype({c: "Int64" for c in ("root", "size", "cluster", "parent")})


def condensed_tree(ids: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, size, birth, stability, own) and members (id, cluster, leaves) of a spanning tree, both stored.

    A cluster is a component of ``least`` points or more, between the edges
    that join it to others of that size; density is 1 / weight. ``own`` says
    that its stability is no less than that of the clusters below, and
    ``leaves`` at which density a point leaves its cluster. The last cluster
    has no parent.

    Ranges of weights are taken from the lightest on, as many edges at a time
    as leave no component with more than EDGES of them.
    """
    ordered = running(in_ranges(tree, "w", "a", "b"), "w, a, b", {"e": "1"}).select("a", "b", "w", "e")
    edges = stored(ordered, "ordered-edges")
    n = edges.count()
    free = stored(ids.select("id", F.col("id").alias("root")), "free-points")  # points with the component they are in
    whole = stored(free.select("id", "root"), "components")
    states = clusters = members = None
    done = 0
    while done < n:
        upto = n
        while True:
            mine = edges.where((F.col("e") > done) & (F.col("e") <= upto))
            at = lambda c: whole.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
            placed = stored(mine.join(at("a"), "a").join(at("b"), "b").select("e", "w", "root_a", "root_b"), "edges-of-range")
            links = placed.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
            ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
            if upto == n:  # the last edges of a tree join all that is left
                joined = stored(ends.join(F.broadcast(ends.agg(F.min("id").alias("root")))), "last-component")
            else:
                joined = components(ends, links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
            groups = placed.join(joined.select(F.col("id").alias("root_a"), F.col("root").alias("grp")), "root_a")
            if upto - done <= EDGES or groups.groupBy("grp").count().agg(F.max("count")).first()[0] <= EDGES:
                break
            discard(placed)
            upto = done + max(EDGES, (upto - done) // 2)
        for side in ("a", "b"):
            if states is None:
                extra = {"size": F.lit(1).cast("long"), "cluster": F.lit(None).cast("long"), "total": F.lit(0.0), "below": F.lit(0.0)}
                groups = groups.select("*", *(v.alias(f"{k}_{side}") for k, v in extra.items()))
            else:
                own = states.select(F.col("root").alias(f"root_{side}"), *(F.col(k).alias(f"{k}_{side}") for k in ("size", "cluster", "total", "below")))
                fill = {f"size_{side}": 1, f"total_{side}": 0.0, f"below_{side}": 0.0}
                groups = groups.join(own, f"root_{side}", "left").fillna(fill)
        out = stored(groups.groupBy("grp").applyInPandas(lambda key, part: _merged(key, part, least), _ROWS), "merged")
        found = out.where("kind = 'cluster'").select("cluster", "parent", "size", "birth", "stability", "own")
        clusters = found if clusters is None else clusters.unionByName(found)
        joining = out.where("kind = 'part'").select("root", "cluster", F.col("birth").alias("leaves"))
        now = stored(free.join(joining, "root").select("id", "cluster", "leaves"), "members")
        members = now if members is None else members.unionByName(now)
        change = joined.withColumnRenamed("root", "new").withColumnRenamed("id", "root")
        renamed = lambda df: df.join(change, "root", "left").select("id", F.coalesce("new", "root").alias("root"))  # noqa: B023, E731
        old_free, old_whole, free, whole = free, whole, stored(renamed(free.join(joining, "root", "left_anti")), "free-points"), stored(renamed(whole), "components")
        kept = out.where("kind = 'state'").select("root", "size", "cluster", "total", "below")
        if states is not None:
            kept = kept.unionByName(states.join(change.select("root"), "root", "left_anti"))
        states = stored(kept, "states")
        discard(old_free, old_whole, placed)
        done = upto
    empty = ids.sparkSession.createDataFrame
    if clusters is None:
        return empty([], "cluster long, parent long, size long, birth double, stability double, own boolean"), empty([], "id long, cluster long, leaves double")
    last = states.where("cluster is not null").selectExpr("cluster", "cast(null as long) as parent", "size", "0.0D as birth", "total as stability", "false as own")
    return stored(clusters.unionByName(last), "clusters"), stored(members, "members")


def stable_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the uppermost cluster over or at each that is worth more than those below it, the last one of all left out; null where none is."""
    now = stored(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("own") & F.col("parent").isNotNull(), F.col("cluster")).alias("chosen")), "ancestors")
    while now.where("up is not null").limit(1).count():
        over = now.select(F.col("cluster").alias("up"), F.col("up").alias("farther"), F.col("chosen").alias("higher"))
        old, now = now, stored(now.join(over, "up", "left").select("cluster", F.col("farther").alias("up"), F.coalesce("higher", "chosen").alias("chosen")), "ancestors")
        discard(old)
    return now.select("cluster", "chosen")


def hdbscan(points: DataFrame, least: int, samples: int | None = None, radius: float = 1.0) -> DataFrame:
    """(id, label, leaves) of the most stable clusters of at least ``least`` points; -1 is noise.

    ``samples`` neighbours give the core distance (``least`` if not given).
    Labels are numbered by the smallest id of a cluster. ``leaves`` is the
    density at which a point leaves its cluster of the condensed tree, null
    where it never is in one. The whole table is never a cluster. Points
    without a place (null, NaN) are noise.
    """
    cores = stored(core_distances(points, samples or least, radius), "cores")
    tree = spanning_tree(cores)
    clusters, members = condensed_tree(cores.select("id"), tree, least)
    chosen = members.join(stable_clusters(clusters), "cluster").select("id", "leaves", "chosen")
    firsts = chosen.where("chosen is not null").groupBy("chosen").agg(F.min("id").alias("root"))
    labels = firsts.join(numbered(firsts), "root").select("chosen", "label")
    found = chosen.join(labels, "chosen", "left").select("id", "label", "leaves")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "leaves")

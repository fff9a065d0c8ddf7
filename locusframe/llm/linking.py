"""Verified links inside candidate buckets, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, join_counted, let_go, mix, stored

#: Nodes and bytes of text of one side of a cell, on average; bytes of text that are cut into tokens at a time.
BLOCK = 256
BLOCK_BYTES = 2 << 20
#: Cells of up to so many pairs are compared together, pair by pair, since a matrix costs more than these; tokens that are looked up at a time.
PAIRS, LOOKUPS = 8, 1 << 20
BATCH_BYTES, HUB_BYTES = 4 << 20, 1 << 17


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``, as a stored table; root is the smallest node of its component.

    Distributed union-find by alternating large and small stars: the number of
    rounds is logarithmic, each is two shuffles of at most as many edges, and
    lineage is cut by a table in the shared folder after each round, which
    replaces the one before.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        # Large star: larger neighbours of each node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, now = now, stored(small.distinct(), "edges")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "roots")
    discard(now)
    return roots


def close_sets(left: np.ndarray, right: np.ndarray, row: np.ndarray, token: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows ``left`` and ``right`` are similar enough: a matrix of exact Jaccard similarities, cut at the threshold.

    ``row`` and ``token`` list the sets, ``size`` has their sizes. Tokens of
    one row alone are left out; the others are taken in slices of 4096, so
    the two incidence matrices stay small however long the texts are.
    """
    _, code, often = np.unique(token, return_inverse=True, return_counts=True)
    shared = often > 1
    column = (np.cumsum(shared) - 1)[code]
    use = shared[code]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = [np.full(len(size), -1), np.full(len(size), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        sides = []
        for where, n in zip(place, both.shape, strict=True):
            at = where[row[part]]
            side = np.zeros((n, 4096), np.float32)
            side[at[at >= 0], column[part][at >= 0] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    union = size[left][:, None] + size[right][None, :] - both.astype(np.float64)
    return both >= (similarity - 1e-12) * np.maximum(union, 1)


def close_pairs(left: np.ndarray, right: np.ndarray, row: np.ndarray, token: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether row ``left[i]`` and row ``right[i]`` are similar enough, for many pairs of few rows each at once.

    ``row`` and ``token`` list the sets in the order of rows, ``size`` has
    their sizes. Every token of a left row is looked up among those of its
    right row.
    """
    salt = mix(np.arange(1, len(size) + 1, dtype=np.uint64))
    known = np.sort(mix(token ^ salt[row]))
    first, count = np.cumsum(size) - size, size[left]
    shared = np.zeros(len(left), np.int64)
    ends, a = np.cumsum(count), 0
    while a < len(left) and len(known):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - count[a] + LOOKUPS, "right")))
        n = count[a:b]
        at = np.arange(n.sum()) + np.repeat(first[left[a:b]] - (np.cumsum(n) - n), n)
        pair = np.repeat(np.arange(a, b), n)
        asked = mix(token[at] ^ salt[right[pair]])
        hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        shared += np.bincount(pair[hit], minlength=len(left))
        a = b
    return shared >= (similarity - 1e-12) * np.maximum(size[left] + size[right] - shared, 1)


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the links (a, b) that join what earlier ones have not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            above[x] = y
            keep.append(i)
    return keep


def compare_cells(cells: DataFrame, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], similarity: float) -> DataFrame:
    """Links (a, b) inside the cells of ``cells(hub, i, j, node, comp, part, text)``.

    A cell has about BLOCK rows to each side: those with bit 1 of ``part`` are
    compared with those with bit 2, where ``comp`` differs. Of the links of a
    cell as many are returned as join its components, and no more.
    """

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([np.asarray(rows.column(k)) for k in ("hub", "i", "j")])
        cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), rows.num_rows)
        size = np.asarray(pc.binary_length(rows.column("text")).fill_null(0)).astype(np.int64)
        ends, k = np.cumsum(size), 0
        while k < len(cuts) - 1:
            start = ends[cuts[k]] - size[cuts[k]]
            to = max(k + 1, int(np.searchsorted(ends[cuts[k + 1 :] - 1], start + BATCH_BYTES, "right")) + k)
            some = rows.slice(cuts[k], cuts[to] - cuts[k]).combine_chunks()
            token, row = tokens(some.column("text"))
            many = np.bincount(row, minlength=some.num_rows)
            node, comp, part = (np.asarray(some.column(c)) for c in ("node", "comp", "part"))
            a, b, some_left, some_right = [], [], [], []
            first = np.searchsorted(row, cuts[k : to + 1] - cuts[k])
            for c in range(to - k):
                low, high = cuts[k + c] - cuts[k], cuts[k + c + 1] - cuts[k]
                left, right = np.flatnonzero(part[low:high] & 1), np.flatnonzero(part[low:high] & 2)
                own, sizes = comp[low:high], many[low:high]
                # Sets whose sizes alone rule a pair out, or that are in one component, need no look at their tokens.
                large = np.maximum.outer(sizes[left], sizes[right])
                may = (np.minimum.outer(sizes[left], sizes[right]) >= (similarity - 1e-12) * large) & (own[left][:, None] != own[right])
                left, right = left[may.any(axis=1)], right[may.any(axis=0)]
                if len(left) and len(left) * len(right) <= PAIRS:
                    some_left.append(np.repeat(low + left, len(right)))
                    some_right.append(np.tile(low + right, len(left)))
                elif len(left):
                    asked = np.zeros(high - low, bool)
                    asked[left] = asked[right] = True
                    some_row, some_token = row[first[c] : first[c + 1]] - low, token[first[c] : first[c + 1]]
                    if not asked.all():
                        some_row, some_token = some_row[asked[some_row]], some_token[asked[some_row]]
                    close = close_sets(left, right, some_row, some_token, sizes, similarity)
                    x, y = np.nonzero(close & (own[left][:, None] != own[right][None, :]))
                    keep = _forest(own[left[x]], own[right[y]])
                    a.append(node[low + left[x[keep]]])
                    b.append(node[low + right[y[keep]]])
            if some_left:
                x, y = np.concatenate(some_left), np.concatenate(some_right)
                other = comp[x] != comp[y]
                x, y = x[other], y[other]
                close = close_pairs(x, y, row, token, many, similarity)
                x, y = x[close], y[close]
                keep = _forest(comp[x], comp[y])
                a.append(node[x[keep]])
                b.append(node[y[keep]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            k = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            last = np.ones(now.num_rows, bool)
            for k in ("hub", "i", "j"):
                column = np.asarray(now.column(k))
                last &= column == column[-1]
            whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if whole:
                yield from links(now.slice(0, whole))
            rest = now.slice(whole)
        if rest is not None:
            yield from links(rest)

    dealt = cells.select("hub", "i", "j", "node", "comp", "part", "text").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def compare_with_hubs(cells: DataFrame, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], similarity: float) -> DataFrame:
    """Links (a, b) of hub and node in the cells of ``cells(hub, j, part, node, text)``: the row of part 1 is the hub's, those of part 2 are its nodes'.

    All cells of a batch are compared at once: a token of a node counts where
    its hub, told by the number of the cell, has it too.
    """

    def links(rows: pa.Table) -> tuple[pa.RecordBatch, int]:
        """The links of some rows, and the place of the last hub among them."""
        token, row = tokens(rows.column("text").combine_chunks())
        part, node = np.asarray(rows.column("part")), np.asarray(rows.column("node"))
        cell, lead = np.cumsum(part == 1), np.flatnonzero(part == 1)
        size = np.bincount(row, minlength=rows.num_rows)
        key = mix(token ^ mix(cell.astype(np.uint64))[row])
        of_hub = part[row] == 1
        known = np.sort(key[of_hub])
        asked, at = key[~of_hub], row[~of_hub]
        hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)
        shared = np.bincount(at[hit], minlength=rows.num_rows)
        union = size + size[lead[cell - 1]] - shared
        found = np.flatnonzero((part == 2) & (shared >= (similarity - 1e-12) * np.maximum(union, 1)))
        return pa.RecordBatch.from_arrays([pa.array(node[lead[cell[found] - 1]]), pa.array(node[found])], ["a", "b"]), int(lead[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: pa.Table | None = None
        for batch in batches:
            for part in batches_of(batch, "text", HUB_BYTES):
                now = pa.Table.from_batches([part])
                now = now if hub is None else pa.concat_tables([hub, now])
                out, last = links(now)
                hub = now.slice(last, 1)
                if out.num_rows:
                    yield out

    dealt = cells.select("hub", "j", "part", "node", "text").repartition("hub", "j").sortWithinPartitions("hub", "j", "part")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _blocks(some: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.when(some, 1)) / BLOCK, F.sum(F.when(some, F.col("bytes"))) / BLOCK_BYTES))).cast("int")


def link_buckets(sketches: DataFrame, prepare: Callable[[DataFrame], DataFrame], tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], similarity: float) -> DataFrame | None:
    """Components (node, root) of the verified links between nodes that share a bucket.

    ``sketches(node, bands)`` is a stored table and may repeat rows. ``prepare``
    gets the nodes that share any bucket and returns their texts (node, text);
    ``tokens`` gives the sets whose Jaccard similarity counts, as arrays of
    token and row in the order of rows. None if there is no link.

    Every pair of a bucket is decided without emitting it. Each bucket has a
    hub, the node that shares most buckets with others, so that the origin of
    a family is the hub of nearly all of its buckets. First each node is
    compared with the hubs of its buckets. Two nodes of a bucket are then in
    one component, or in one hub's group and one of them outside the hub's
    component. These outsiders are compared with the whole group: both are cut
    into blocks, and each cell of two blocks is a matrix of exact similarities
    made in one place. Groups are told by hub and not by bucket, so what two
    nodes share in many bands is compared once. Joins on buckets and hubs,
    which may be very common, go by ``join_counted``.
    """
    members = sketches.select("node", F.explode("bands").alias("bucket"))
    ends = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    buckets = stored(ends.where("low <> high").select("bucket", "n"), "buckets")
    shared = stored(join_counted(members, buckets, "bucket").distinct(), "shared")
    discard(buckets)
    central = stored(shared.groupBy("node").agg(F.sum("n").alias("c")), "central")
    placed = shared.join(central.hint("merge"), "node").select("bucket", "n", F.struct((-F.col("c")).alias("c"), "node").alias("place"))
    hub = stored(placed.groupBy("bucket").agg(F.min("place").alias("first"), F.max("n").alias("n")).select("bucket", F.col("first.node").alias("hub"), "n"), "hubs-of-buckets")
    texts = stored(prepare(central.select("node")).withColumn("bytes", F.octet_length("text")), "near-texts")
    pairs = join_counted(shared.select("bucket", "node"), hub, "bucket").where("node <> hub").select("hub", "node").distinct()
    stars = stored(pairs.join(texts.select("node", "bytes").hint("merge"), "node").select("hub", "node", "bytes"), "stars")
    discard(shared, central, hub)

    # Each node against its hubs.
    sizes = stored(stars.groupBy("hub").agg(F.count("*").alias("n"), _blocks(F.lit(True)).alias("nj")), "hubs")
    own = F.xxhash64(F.lit(29), "node")
    as_left = sizes.select("hub", F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), F.col("hub").alias("node"), F.lit(1).alias("part"))
    as_right = join_counted(stars, sizes, "hub").select("hub", F.pmod(own, "nj").cast("int").alias("j"), "node", F.lit(2).alias("part"))
    edges = stored(compare_with_hubs(as_left.unionByName(as_right).join(texts.hint("merge"), "node"), tokens, similarity), "links")
    roots = connected_components(edges)

    # Outsiders of a hub's component against its whole group.
    comp = lambda df, node, name: df.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)).hint("merge"), node, "left").withColumn(name, F.coalesce(name, node))
    grouped = stored(comp(stars, "node", "comp"), "groups")
    mixed = comp(grouped.groupBy("hub").agg(F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")), "hub", "hub_comp")
    mixed = stored(mixed.where("c1 <> c2").select("hub", "n", "hub_comp"), "hubs")
    some = stored(join_counted(grouped, mixed, "hub").select("hub", "node", "bytes", "comp", (F.col("comp") != F.col("hub_comp")).alias("outside")), "groups")
    kinds = stored(some.groupBy("hub").agg(F.count("*").alias("n"), _blocks(F.col("outside")).alias("ni"), _blocks(F.lit(True)).alias("nj")), "hubs")
    of = join_counted(some, kinds, "hub").withColumn("own", own)
    one = F.col("outside") & (F.col("ni") == 1) & (F.col("nj") == 1)
    as_left = of.where("outside").select("hub", F.pmod("own", "ni").cast("int").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), "node", "comp", F.when(one, 3).otherwise(1).alias("part"))
    as_right = of.where(~one).select("hub", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), F.pmod("own", "nj").cast("int").alias("j"), "node", "comp", F.lit(2).alias("part"))
    more = compare_cells(as_left.unionByName(as_right).join(texts.hint("merge"), "node"), tokens, similarity)
    more = stored(more, "links")
    if more.limit(1).count():
        whole = edges.unionByName(more)
        discard(roots)
        roots = connected_components(whole)
    discard(stars, sizes, edges, more, grouped, mixed, some, kinds, texts)
    let_go(sketches.sparkSession)
    return roots if roots.limit(1).count() else None

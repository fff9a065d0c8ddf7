"""Merkle manifest of a table: trees of digests reduced by superblocks.

The leaves of a tree are numbered in order; numbers are bucketed by
``fanout ** levels``, and each bucket collapses that many levels in one task.
The roots of the buckets are the leaves of the next round, so a table of n rows
takes log(n) / log(fanout ** levels) rounds, and no task holds more than one
bucket. On the way back each bucket finds the siblings of its nodes (the lower
proof) and appends those of its own root (the upper proof).

Texts are digested where they are read; only digests are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, discard, fold, key_text, stored

FANOUT, LEVELS = 8, 3
#: Starts of trees in ranges of rows are broadcast up to so many; there are no more than ranges and trees together.
STARTS = 200_000
_PROOF = "lefts array<string>, rights array<string>"


def framed(c: Column) -> Column:
    """A value as text that no other sequence of values reads like: ``-`` for null, else its bytes in UTF-8 and itself."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the framed columns, one after the other."""
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def reduced(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a bucket and of each of ``levels`` levels above; a last run may be short, even of one node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(tower: list[list[str]], fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each node of the bottom level, the digests left and right of its way up, one text for each level."""
    sides: tuple[list[list[str]], list[list[str]]] = ([], [])
    for nodes in tower[:-1]:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        sides[0].append(["".join(run[:i]) for run in runs for i in range(len(run))])
        sides[1].append(["".join(run[i + 1 :]) for run in runs for i in range(len(run))])
    bottom = range(len(tower[0]))
    return tuple([[level[i // fanout**k] for k, level in enumerate(side)] for i in bottom] for side in sides)


@dataclass
class Reduction:
    """The tables of a reduction from the leaves to one node for each tree; ``fanout`` and ``levels`` of a bucket."""

    tables: list[DataFrame]
    fanout: int
    levels: int

    @property
    def roots(self) -> DataFrame:
        return self.tables[-1]


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, place, digest, ...)``, stored, with ``idx``, their number in the tree by place and digest, and ``n``, those of the tree.

    Rows are sorted by ranges of tree and place, so a tree of any size spreads
    over tasks; what goes through one task is a row for each range of a tree.
    """
    order = ["tree", "place", "digest"]
    dealt = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "leaves")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    starts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    starts = starts.selectExpr("tree", "part", "first", "coalesce(sum(many) over (partition by tree order by part rows between unbounded preceding and 1 preceding), 0) as before", "sum(many) over (partition by tree) as n")
    starts = F.broadcast(starts) if bounded(starts, STARTS) else starts
    joined = dealt.join(starts, ["tree", "part"])
    return joined.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def reduce_trees(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Reduction:
    """Collapse all trees of ``leaves(tree, place, digest, ...)`` at once, ``levels`` levels a round.

    A single leaf is its own root. Only the largest number of nodes of any tree
    comes to the driver.
    """
    size = fanout**levels

    def collapse(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        steps = min(levels, height(n, fanout))
        top = reduced(part.sort_values("idx")["digest"].tolist(), fanout, steps)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [int(key[1])], "digest": top, "n": [-(-n // size)]})

    tables = [stored(numbered(leaves), "numbered")]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        nodes = tables[-1].select("tree", F.expr(f"idx div {size}").alias("bucket"), "idx", "digest", "n")
        tables.append(stored(nodes.groupBy("tree", "bucket").applyInPandas(collapse, "tree string, idx long, digest string, n long"), "nodes"))
    return Reduction(tables, fanout, levels)


def prove(reduction: Reduction, tops: DataFrame) -> DataFrame:
    """The leaves with ``lefts`` and ``rights``, the digests beside each step to the top.

    ``tops(tree, lefts, rights, ...)`` says how each root goes on from there;
    its other columns are passed down to the leaves.
    """
    fanout, levels = reduction.fanout, reduction.levels
    size = fanout**levels
    passed = [c for c in tops.columns if c not in ("tree", "lefts", "rights")]
    above = tops.withColumn("idx", F.lit(0).cast("long"))

    for i in range(len(reduction.tables) - 2, -1, -1):
        nodes = reduction.tables[i].withColumn("bucket", F.expr(f"idx div {size}"))
        upper = above.withColumnRenamed("idx", "bucket")
        kept = nodes.columns if i == 0 else ["tree", "bucket", "idx", "digest", "n"]
        fields = [f for f in nodes.select(*kept).schema if f.name != "bucket"] + [f for f in tops.schema if f.name != "tree"]

        def lower(part: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("idx").drop(columns="bucket")
            tower = reduced(part["digest"].tolist(), fanout, min(levels, height(int(part["n"].iloc[0]), fanout)))
            lefts, rights = siblings(tower, fanout)
            one = up.iloc[0]
            for c in passed:
                part[c] = one[c]
            part["lefts"] = [x + list(one["lefts"]) for x in lefts]
            part["rights"] = [x + list(one["rights"]) for x in rights]
            return part

        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        found = nodes.select(*kept).groupBy("tree", "bucket").cogroup(upper.groupBy("tree", "bucket")).applyInPandas(lower, schema)
        above = found if i == 0 else stored(found.select("tree", "idx", "lefts", "rights", *passed), "proofs")
    if len(reduction.tables) == 1:
        above = reduction.tables[0].join(tops, "tree")
    return above.drop("n")


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Proofs of ``leaves(tree, place, digest, ...)`` up to the root of the roots of their trees.

    Adds ``idx``, ``subroot`` (root of the tree), ``root`` (of all subroots in
    the order of ``tree``), ``lefts`` and ``rights`` (for each level from the
    leaf up, the digests left and right of the node). Leaves are in the order
    of ``place``, null first, and of their digests where places are equal, so
    repeated rows are leaves of their own. A table without rows has no root
    and an empty manifest.
    """
    reduction = reduce_trees(leaves, fanout, levels)
    empty = F.array().cast("array<string>")
    forest = reduce_trees(reduction.roots.select(F.lit("").alias("tree"), F.col("tree").alias("place"), "digest"), fanout, levels)
    ways = prove(forest, forest.roots.select("tree", empty.alias("lefts"), empty.alias("rights"), F.col("digest").alias("root")))
    tops = stored(ways.select(F.col("place").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root"), "tops")
    discard(*forest.tables)
    return prove(reduction, tops)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and the digests beside its way up lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("lefts"), rights.alias("rights")), leaf, lambda d, s: F.sha2(F.concat(s["lefts"], d, s["rights"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of documents by language, held against a copy in which every third text was put in lower case.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Null
    columns are framed as ``-``; a null language is a tree of its own, the
    first; a null doc_id comes first and is never tampered with; empty, long
    and repeated texts are leaves like others; extra columns, whatever their
    names, are ignored.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    touched = F.coalesce(fold(F.col("doc_id"), 3) == 0, F.lit(False))
    leaf = digest(*fields, F.col("text"))
    rows = docs.select(key_text(F.col("lang")).alias("tree"), F.col("doc_id").alias("place"), leaf.alias("digest"), F.when(touched, digest(*fields, lower)).otherwise(leaf).alias("seen"))
    proofs = manifest(rows)
    found = proofs.select(F.col("place").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), folded(F.col("seen"), F.col("lefts"), F.col("rights")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_sql(fanout: int = FANOUT) -> str:
    """DuckDB SQL for the rows of ``audit``; CRC-32 is written out, since there is no function for it."""
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    fields = " || ".join(text(c) for c in ("doc_id", "source", "lang", "n_chars"))
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
docs AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS tree, sha256({fields} || {text('text')}) AS leaf,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c // 256, steps[(xor(c % 256, b) + 1)::INT])), 4294967295) % 3 AS third,
    sha256({fields} || {text(f"translate(text, '{upper}', '{lower}')")}) AS low FROM documents, crc),
leaves AS (SELECT *, CASE WHEN third = 0 THEN low ELSE leaf END AS seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs),
up AS (SELECT 0 AS level, tree, idx, leaf AS h, n FROM leaves UNION ALL
    SELECT level + 1, tree, idx // {fanout}, sha256(string_agg(h, '' ORDER BY idx)), (n + {fanout - 1}) // {fanout} FROM up WHERE n > 1 GROUP BY level, tree, idx // {fanout}, n),
subs AS (SELECT tree, level, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, h, n FROM subs UNION ALL
    SELECT level + 1, idx // {fanout}, sha256(string_agg(h, '' ORDER BY idx)), (n + {fanout - 1}) // {fanout} FROM top WHERE n > 1 GROUP BY level, idx // {fanout}, n),
sides AS (SELECT tree, level, idx, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, idx // {fanout} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, idx // {fanout} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM up WHERE n > 1),
top_sides AS (SELECT level, idx, coalesce(string_agg(h, '') OVER (PARTITION BY level, idx // {fanout} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY level, idx // {fanout} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM top WHERE n > 1),
steps AS (SELECT l.tree, l.idx, s.level, s.a, s.b FROM leaves l JOIN sides s ON l.tree = s.tree AND s.idx = l.idx // ({fanout} ** s.level)::BIGINT UNION ALL
    SELECT l.tree, l.idx, u.level + t.level, t.a, t.b FROM leaves l JOIN subs u USING (tree) JOIN top_sides t ON t.idx = u.idx // ({fanout} ** t.level)::BIGINT),
proofs AS (SELECT tree, idx, list(a ORDER BY level) AS lefts, list(b ORDER BY level) AS rights, sha256(string_agg(a || b, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY ALL),
folding AS (SELECT l.tree, l.idx, 1 AS k, l.seen AS h, p.lefts, p.rights FROM leaves l LEFT JOIN proofs p USING (tree, idx) UNION ALL
    SELECT tree, idx, k + 1, sha256(lefts[k] || h || rights[k]), lefts, rights FROM folding WHERE k <= len(lefts))
SELECT l.doc_id, l.leaf, u.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subs u USING (tree) JOIN folding f ON f.tree = l.tree AND f.idx = l.idx AND f.k = 1 + coalesce(len(f.lefts), 0) LEFT JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""

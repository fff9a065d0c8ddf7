"""Fuzzy line deduplication by MinHash over character shingles.

Equal lines are one node. Every node gets a one-permutation MinHash signature
of its character shingles, banded for high recall; candidates are verified by
exact Jaccard similarity, links are joined by distributed union-find, and the
first line of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, batches_of, discard, distinct_pairs, join_counted, mix, named, steady, stored, text_bytes, unused, with_row
from .linking import link_buckets
from .near_dedup import band_keys

#: Characters of a shingle, least characters of a line that is compared unless every line is, least similarity.
SHINGLE = 8
LEAST_CHARS = 24
SIMILARITY = 0.8
BANDS, PER_BAND = 12, 4
#: Lines that a task remembers to have banded.
SEEN = 500_000
#: Values that each shingle throws at the bins of the signature.
THROWS = 2
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_EMPTY = np.uint32(0xFFFFFFFF)
#: What a value becomes that is borrowed from so many bins before: once for each bin, times a constant and plus one.
_STEP, _SHIFT = np.ones(256, np.uint32), np.zeros(256, np.uint32)
for _k in range(1, 256):
    _STEP[_k] = int(_STEP[_k - 1]) * 0x85EBCA6B & 0xFFFFFFFF
    _SHIFT[_k] = (int(_SHIFT[_k - 1]) * 0x85EBCA6B + 1) & 0xFFFFFFFF
_WORD = "[^\\x20\\x09-\\x0D]"


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the rows among them."""
    points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def shingle_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lines given as runs of code points, and how many each line has."""
    up, down = _power_tables()
    runs = np.maximum(0, ends - starts - (SHINGLE - 1))
    hashes = np.empty(max(0, len(points) - SHINGLE + 1), np.uint64)
    step = len(up) - SHINGLE - 1
    for a in range(0, len(hashes), step):
        b = min(len(hashes), a + step)
        sums = np.zeros(b - a + SHINGLE, np.uint64)
        np.cumsum((points[a : b + SHINGLE - 1].astype(np.uint64) + np.uint64(1)) * up[: b - a + SHINGLE - 1], out=sums[1:])
        hashes[a:b] = (sums[SHINGLE:] - sums[: b - a]) * down[: b - a]
    first = np.cumsum(runs) - runs
    return mix(hashes[np.arange(runs.sum()) + np.repeat(starts - first, runs)]), runs


def signatures(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, bins: int = BANDS * PER_BAND) -> np.ndarray:
    """One-permutation MinHash of the lines given as runs of code points; empty bins borrow from the bin before."""
    own, runs = shingle_hashes(points, starts, ends)
    base = np.repeat(np.arange(len(starts), dtype=np.int64) * bins, runs)
    signature = np.full(len(starts) * bins, _EMPTY, np.uint32)
    for odd in _ODD[:THROWS]:
        thrown = own * odd
        thrown ^= thrown >> np.uint64(29)
        where = ((thrown >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(signature, base + where.astype(np.int64), thrown.astype(np.uint32))
    signature = signature.reshape(-1, bins)
    filled = signature != _EMPTY
    # The last filled bin at or before each, around the circle; a line without any has none.
    place = np.where(np.hstack([filled, filled]), np.arange(2 * bins, dtype=np.int32), -1)
    last = np.maximum.accumulate(place, axis=1)[:, bins:]
    away = np.arange(bins, 2 * bins) - last
    row, hole = np.nonzero(~filled & (last >= 0))
    d = away[row, hole]
    signature[row, hole] = signature[row, last[row, hole] % bins] * _STEP[d] + _SHIFT[d]
    return signature


def line_bands(lines: DataFrame) -> DataFrame:
    """(row, at, node, h2, bands) of every line of ``lines(row, at, line, node, h2)``.

    ``bands`` is empty for a line shorter than a shingle, and for one that the
    task has given bands lately.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in batches_of(batch, "line", 1 << 17):
                nodes = np.asarray(part.column("node"))
                long = part.column("long").to_numpy(zero_copy_only=False)
                one = np.sort(np.unique(nodes, return_index=True)[1])
                one = one[[bool(k) and x not in seen for k, x in zip(long[one], nodes[one].tolist(), strict=True)]]
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(nodes[one].tolist())
                data, offsets = text_bytes(part.column("line").take(pa.array(one)))
                points, edges = code_points(data, offsets)
                keys = band_keys(signatures(points, edges[:-1], edges[1:]), BANDS, PER_BAND)
                cuts = np.zeros(len(nodes) + 1, np.int32)
                cuts[one + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "at", "node", "h2")), bands], ["row", "at", "node", "h2", "bands"])

    rows = lines.select("row", "at", "node", "h2", (F.char_length("line") >= SHINGLE).alias("long"), "line")
    return rows.mapInArrow(run, "row bigint, at int, node bigint, h2 bigint, bands array<bigint>")


def lines_of(docs: DataFrame, every: bool = False) -> DataFrame:
    """(row, at, line, node, h2) of every line of ``docs(row, text)`` with a word, or only of those that are long enough, in native operations."""
    lines = docs.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    used = lines.where(F.col("line").rlike(_WORD) if every else F.char_length("line") >= LEAST_CHARS)
    return used.select("row", "at", "line", F.xxhash64("line").alias("node"), F.xxhash64(F.lit(13), "line").alias("h2"))


def tokens(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character shingles of the lines and the row of each."""
    points, edges = code_points(*text_bytes(lines))
    hashes, runs = shingle_hashes(points, edges[:-1], edges[1:])
    row = np.repeat(np.arange(len(runs)), runs)
    keep = np.sort(distinct_pairs(row, hashes)[0])
    return hashes[keep], row[keep]


def jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the sets of character shingles of two columns of lines, row by row."""
    sides = []
    for column in (left, right):
        h, r = tokens(column)
        sides.append((h, r, np.bincount(r, minlength=len(column))))
    (ha, ra, na), (hb, rb, nb) = sides
    h, r = np.concatenate([ha, hb]), np.concatenate([ra, rb])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    shared = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=len(na))
    return shared / np.maximum(na + nb - shared, 1)


def kept_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """(row, kept) of every document of ``docs(row, text)`` with a compared line that stays: the sorted positions of those lines.

    Equal lines are told by 128 bits of hash; the graph of similar lines knows
    them by the first 64. Lines shorter than a shingle are one shingle each,
    so only equal ones are similar: they need no bands. The line that stays of
    a component is that of the smallest row and position.
    """
    placed = stored(line_bands(lines_of(docs, every)), "line-sketches")
    firsts = stored(placed.groupBy("node", "h2").agg(F.min(F.struct("row", "at")).alias("one")).select("node", "one.row", "one.at"), "first-lines")

    def prepare(nodes: DataFrame) -> DataFrame:
        wanted = firsts.join(nodes.hint("merge"), "node", "left_semi").groupBy("row").agg(F.collect_list(F.struct("node", "at")).alias("wanted"))
        found = docs.join(wanted.hint("merge"), "row").select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("one"))
        return found.select("one.node", F.element_at("lines", F.col("one.at") + 1).alias("text"))

    roots = link_buckets(placed.where(F.size("bands") > 0).select("node", "bands"), prepare, tokens, SIMILARITY)
    kept = firsts
    if roots is not None:
        grouped = stored(firsts.join(roots.hint("merge"), "node").select("root", "row", "at"), "similar-lines")
        best = stored(grouped.groupBy("root").agg(F.min(F.struct("row", "at")).alias("best"), F.count("*").alias("n")), "best-lines")
        others = join_counted(grouped, best, "root").where(F.struct("row", "at") != F.col("best")).select("row", "at")
        kept = firsts.join(others.hint("merge"), ["row", "at"], "left_anti")
    out = stored(kept.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("kept")), "kept-lines")
    discard(firsts, placed, roots, *((grouped, best) if roots is not None else ()))
    return out


def dedup_lines(docs: DataFrame, every: bool = False, removed: str = "n_removed") -> DataFrame:
    """Texts with one line of each group of similar lines, over all documents.

    Returns the columns of ``docs`` with text replaced, and the number of lines
    ``removed``, in place of a column of that name; others may have any name. With
    ``every`` all lines with a word are compared, however short; without it
    those under 24 characters stay. Documents that lose nothing, null and
    empty texts included, keep their text as it is; a document that loses
    every line has the text left over, if only an empty one. Of equal rows and
    lines the first keeps its line. Very long texts cost time in proportion to
    their length. An empty table gives an empty one.
    """
    own = steady(docs.drop(removed))
    row, kept = unused(own, "row"), unused(own, "kept")
    own = with_row(own, row)
    text = F.col("text").cast("string")
    found = kept_lines(own.select(F.col(row).alias("row"), F.coalesce(text, F.lit("")).alias("text")), every)
    lines = unused(own, "lines")
    joined = own.join(found.select(F.col("row").alias(row), F.col("kept").alias(kept)).hint("merge"), row, "left").withColumn(lines, F.split(text, "\n"))
    used = F.transform(lines, lambda x, i: F.when(x.rlike(_WORD) if every else F.char_length(x) >= LEAST_CHARS, i))
    placed = joined.withColumn(kept, F.array_except(F.array_compact(used), F.coalesce(kept, F.array().cast("array<int>"))))  # now those that go
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(kept)), lambda i: F.get(F.col(lines), i))
    n = F.when(text.isNull(), 0).otherwise(F.size(kept))
    return placed.select(*(F.when(n > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else named(c) for c in docs.drop(removed).columns), n.alias(removed))

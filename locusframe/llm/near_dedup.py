"""Near duplicates by DartMinHash over weighted five-word shingles.

Every element (shingle) owns a plane of weight times rank into which hashed
darts fall, one per unit of area on average. A document sees the darts below
its elements' weights; for each coordinate of the signature it keeps the
earliest. Darts are generated by regions of doubling weight and rank, so a
document looks only as deep as it needs to fill its coordinates, about
k ln k darts however long it is. The chance that two documents agree on a
coordinate is their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, distinct_pairs, join_counted, mix, shingles, steady, stored, text_bytes, unused, with_row, word_hashes
from .linking import link_buckets

SHINGLE = 5
SIMILARITY = 0.8
BANDS, PER_BAND = 30, 6
#: Height of the first region in rank.
FIRST_RANK = 0.25
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(64)
def _poisson_cdf(mean: float) -> np.ndarray:
    steps = np.arange(1, int(mean + 12 * np.sqrt(mean) + 24))
    logs = np.concatenate([[-mean], -mean + np.cumsum(np.log(mean / steps))])
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def elements(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their counts and the row of each; a row is kept in 16 bits beside 48 of the hash."""
    hashes, first = shingles(words, rows, SHINGLE)
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(first))
    key = np.sort((row << np.uint64(48)) | (hashes >> np.uint64(16)))
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    return mix((key[start] & np.uint64((1 << 48) - 1)) + np.uint64(1)), count, (key[start] >> np.uint64(48)).astype(np.int64)


def dart_minhash(element: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int, k: int = BANDS * PER_BAND) -> np.ndarray:
    """Signatures (n, k) of weighted sets given as (element, weight, row); rows without elements stay at the largest value."""
    signature = np.full(n * k, _NONE, np.uint64)
    total = np.bincount(row, weights=weight, minlength=n)
    need = k * (np.log(k) + 2) / np.maximum(total, 1e-300)
    depth = np.maximum(0, np.ceil(np.log2(need / FIRST_RANK))).astype(np.int64)
    active, level = total > 0, 0
    while active.any():
        height = FIRST_RANK if level == 0 else FIRST_RANK * 2.0 ** (level - 1)
        seen = active[row]
        e, w, r = (element, weight, row) if seen.all() else (element[seen], weight[seen], row[seen])
        strip, low, width = 0, 0.0, 1.0
        while len(e):
            region = np.uint64((level << 8 | strip) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            base = mix(e ^ region)
            darts = np.searchsorted(_poisson_cdf(width * height), _unit(base), "right")
            hit = np.flatnonzero(darts)
            at = np.repeat(hit, darts[hit])
            ordinal = np.arange(len(at)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
            dart = mix(base[at] + (ordinal.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            if strip:
                inside = low + _unit(mix(dart + np.uint64(1))) * width < w[at]
                at, dart = at[inside], dart[inside]
            coordinate = ((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            rank = (np.uint64(level) << np.uint64(56)) | (mix(dart + np.uint64(2)) >> np.uint64(8))
            np.minimum.at(signature, r[at] * k + coordinate.astype(np.int64), rank)
            low, width, strip = low + width, low + width, strip + 1
            more = w > low
            e, w, r = e[more], w[more], r[more]
        level += 1
        # Deeper for those that their weight asks it of, and where a coordinate is still empty.
        empty = (signature.reshape(n, k) == _NONE).any(axis=1)
        active &= (depth >= level) | empty
        if level > 62:
            break
    return signature.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    parts = signature.reshape(len(signature), bands, per_band)
    for j in range(per_band):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j].astype(np.uint64))
    return keys.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, h1, h2, bands) of ``docs(row, doc_id, text)``: two hashes of the text and its band keys, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 2 << 20):
                _, one, other = np.unique(np.asarray(part.column("h1")), return_index=True, return_inverse=True)
                data, offsets = text_bytes(part.column("text").take(pa.array(one)))
                words, _, _, rows = word_hashes(data, offsets)
                signature = dart_minhash(*elements(words, rows), len(one))
                keys = band_keys(signature, BANDS, PER_BAND)
                filled = (np.diff(rows) > 0)[other]
                keys = keys[other][filled]
                cuts = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "h1", "h2")), bands], ["row", "doc_id", "h1", "h2", "bands"])

    rows = docs.select("row", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, h1 bigint, h2 bigint, bands array<bigint>")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the texts and the row of each; the nth of equal shingles is a token of its own.

    So the Jaccard similarity of two texts' tokens is the weighted one of their
    shingle counts.
    """
    words, _, _, rows = word_hashes(*text_bytes(texts))
    hashes, first = shingles(words, rows, SHINGLE)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    _, order, start = distinct_pairs(row, hashes)
    nth = np.empty(len(hashes), np.uint64)
    nth[order] = np.arange(len(hashes)) - np.repeat(start, np.diff(np.append(start, len(hashes))))
    return mix(hashes + nth * np.uint64(0x9E3779B97F4A7C15)), row


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle counts of two text columns, row by row."""
    sides = []
    for column in (left, right):
        words, _, _, rows = word_hashes(*text_bytes(column))
        hashes, first = shingles(words, rows, SHINGLE)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
        sides.append((h[start], r[start], np.diff(np.append(start, len(h))), np.diff(first)))
    (ha, ra, ca, na), (hb, rb, cb, nb) = sides
    h, r, c = np.concatenate([ha, hb]), np.concatenate([ra, rb]), np.concatenate([ca, cb])
    order = np.lexsort((h, r))
    h, r, c = h[order], r[order], c[order]
    twin = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    shared = np.bincount(r[twin], weights=np.minimum(c[twin], c[twin + 1]), minlength=len(na))
    return shared / np.maximum(na + nb - shared, 1)


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_id, first_row) of every document of ``docs(row, doc_id, text)``.

    Equal texts are one node before any band is dealt, so a group of exact
    copies costs one row per copy. A text without words is like no other.
    ``first_row`` is the row of the smallest doc_id of the class, of equal ids
    the first; ``class_id`` is that id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = stored(sketches(docs.select("row", "doc_id", text.alias("text"))), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    some = found.where(F.size("bands") > 0)
    same = stored(some.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min(place).alias("first"), F.count("*").alias("n")), "equal-texts")
    nodes = stored(some.join(same.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), "bands"), "node-sketches")

    def prepare(wanted: DataFrame) -> DataFrame:
        return docs.select(F.col("row").alias("node"), text.alias("text")).join(wanted.hint("merge"), "node", "left_semi")

    roots = link_buckets(nodes, prepare, tokens, SIMILARITY)
    if roots is not None:
        # The smallest doc_id of each class goes to its texts, which then take it to their copies.
        joined = stored(same.join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep").select("h1", "h2", "root", "first"), "linked-texts")
        best = stored(joined.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")), "classes")
        linked = join_counted(joined.select("h1", "h2", "root"), best, "root").select("h1", "h2", "best")
        whole = stored(same.join(linked.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", "n", F.coalesce("best", "first").alias("first")), "equal-texts")
        discard(same, joined, best, roots)
        same = whole
    pairs = join_counted(some.select("row", "doc_id", "h1", "h2"), same, ["h1", "h2"]).select("row", "doc_id", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"))
    out = stored(pairs.unionByName(found.where(F.size("bands") == 0).select("row", "doc_id", F.col("doc_id").alias("class_id"), F.col("row").alias("first_row"))), "classes")
    discard(found, nodes, same)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept for every document.

    class_id is the smallest doc_id of the group of near duplicates (similarity
    of 0.8 or more on counts of five-word shingles, taken transitively); the
    document with that id is kept, of repeated ids the first row. Texts of
    fewer than five words are compared as one shingle; null and empty texts are
    each a class of their own. A null id is kept only if its class has no
    other. Very long texts throw no more darts than short ones. Extra columns
    are ignored; an empty table gives an empty one.
    """
    own = with_row(steady(docs.select("doc_id", "text")), "row")
    return classes(own).select("doc_id", "class_id", (F.col("row") == F.col("first_row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group of near duplicates.

    Which one stays, and what null, short and repeated texts do, is as in
    ``near_duplicates``. Columns may have any name.
    """
    own = steady(docs)
    row = unused(own, "row")
    own = with_row(own, row)
    found = classes(own.select(F.col(row).alias("row"), "doc_id", "text"))
    gone = found.where("row <> first_row").select(F.col("row").alias(row))
    return own.join(gone.hint("merge"), row, "left_anti").drop(row)

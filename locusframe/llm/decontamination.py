"""Benchmark decontamination: short test items inside long documents.

Test items are partitioned by their number of five-word shingles, in classes
of doubling size S. For each class a document is cut into overlapping windows
of 2 S shingles, one every S, so that any place an item can stand lies whole
in a window of about its size; MinHash with many single-value bands then finds
the windows that share enough with an item. An item of up to FEW shingles, or
one that repeats itself, is looked up: a fifth of its distinct shingles may be
missing, so one of a fifth and one more must be there. An item of fewer than
five words is one shingle of all its words. Candidates are verified
by the exact share of the item's shingles that the whole document contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, batches_of, shingles, steady, stored, text_bytes, unused, with_row, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
#: Hash functions, each a band of its own. The least favourable windows are of 2 S shingles and share 0.8 of an item's, which are just over S / 2,
#: or 3 / 8 S where an item repeats some: a Jaccard similarity of 0.19 or 0.14, missed 4 times in 100,000 or 5 times in 10,000.
HASHES = 48
#: An item whose distinct shingles are less than this share of all is looked up, as a window of its size would hold too much else.
DISTINCT = 0.75
#: Smallest class of MinHash windows; items of up to FEW shingles are looked up instead: 0.8 of so few is all of them.
SMALLEST, FEW = 8, 4
#: Items, and bytes of their texts, that one pass holds; more are searched block by block.
BLOCK, BLOCK_BYTES = 20_000, 32 << 20
_RNG = np.random.default_rng(2029)
_MULTIPLY = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TO_WORDS = bytes(32 if NOT_ALNUM[i] else int(LOWER[i]) for i in range(256))


def word_tuples(text: str, n: int = SHINGLE, whole: bool = False) -> set[tuple[bytes, ...]]:
    """The runs of n words; with ``whole`` a text of fewer, but one at least, is one run."""
    words = text.encode("utf-8").translate(_TO_WORDS).split()
    if whole and 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str]):
        words, _, _, rows = word_hashes(*text_bytes(pa.array(texts, pa.string())), NOT_ALNUM)
        hashes, first = shingles(words, rows, SHINGLE)
        self.ids, self.texts = ids, texts
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.width = np.minimum(np.diff(rows), SHINGLE)
        size, runs = np.array([len(s) for s in self.sets], int), np.diff(first)
        #: For each width of shingles: sorted shingles that are looked up, and their items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        few = (size > 0) & ((size <= FEW) | (size < DISTINCT * runs))
        for n in sorted(set(self.width[few].tolist())):
            members = np.flatnonzero(few & (self.width == n))
            if n == SHINGLE:
                asked = [self.sets[i][: int((1 - CONTAINMENT) * size[i] + 1e-9) + 1] for i in members]
                one, members = np.concatenate(asked), np.repeat(members, [len(a) for a in asked])
            else:  # the shingle as texts have it that are cut into runs of so many words
                own, at = shingles(words, rows, n)
                one = own[at[members]]
            order = np.argsort(one, kind="stable")
            self.short[n] = one[order], members[order]
        self.classes: dict[int, tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = {}
        of = np.array([max(SMALLEST, 1 << (int(n) - 1).bit_length()) if not f and s else 0 for n, s, f in zip(runs, size, few, strict=True)], int)
        for c in sorted(set(of.tolist()) - {0}):
            members = np.flatnonzero(of == c)
            least = np.array([((self.sets[i].astype(np.uint32)[:, None] * _MULTIPLY) + _ADD).min(axis=0) for i in members])
            order = np.argsort(least, axis=0, kind="stable")
            values = [least[order[:, k], k] for k in range(HASHES)]
            filters = np.zeros((HASHES, 1 << 16), bool)
            for k in range(HASHES):
                filters[k, values[k] >> np.uint32(16)] = True
            self.classes[c] = (values, [members[order[:, k]] for k in range(HASHES)], filters)

    def _lookup(self, words: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) where a row has the shingle of a short item."""
        found: set[tuple[int, int]] = set()
        for n, (values, members) in self.short.items():
            hashes, first = shingles(words, rows, n)
            low = np.searchsorted(values, hashes, "left")
            for at in np.flatnonzero(values[np.minimum(low, len(values) - 1)] == hashes).tolist():
                row = int(np.searchsorted(first, at, "right")) - 1
                found.update((row, int(i)) for i in members[low[at] : np.searchsorted(values, hashes[at], "right")])
        return found

    def search(self, column: pa.Array) -> list[tuple[int, int, float]]:
        """(row, item, containment) of all verified finds in a text column."""
        if not self.classes and not self.short:
            return []
        words, _, _, rows = word_hashes(*text_bytes(column), NOT_ALNUM)
        hashes, first = shingles(words, rows, SHINGLE)
        return self._verified(column, self._lookup(words, rows) | self._windows(hashes, first), hashes, first)

    def _windows(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) where a window of a row shares a least hash with an item of its size."""
        found: set[tuple[int, int]] = set()
        if not self.classes or not len(hashes):
            return found
        small = hashes.astype(np.uint32)
        base = min(self.classes)
        counts = np.diff(first)
        blocks = -(-counts // base)
        block_first = np.concatenate([[0], np.cumsum(blocks)])
        starts = (np.arange(block_first[-1]) - np.repeat(block_first[:-1], blocks)) * base + np.repeat(first[:-1], blocks)
        for k in range(HASHES):
            least = np.minimum.reduceat(small * _MULTIPLY[k] + _ADD[k], starts)
            size, edge = base, block_first
            while True:
                if size in self.classes:
                    values, members, filters = self.classes[size]
                    window = least.copy()  # two neighbouring blocks of a document
                    window[:-1] = np.minimum(least[:-1], least[1:])
                    last = edge[1:][np.diff(edge) > 0] - 1
                    window[last] = least[last]
                    hit = np.flatnonzero(filters[k][window >> np.uint32(16)])
                    if len(hit):
                        low, high = np.searchsorted(values[k], window[hit], "left"), np.searchsorted(values[k], window[hit], "right")
                        for at, a, b in zip(hit[high > low], low[high > low], high[high > low], strict=True):
                            row = int(np.searchsorted(edge, at, "right")) - 1
                            found.update((row, int(i)) for i in members[k][a:b])
                if size >= max(self.classes):
                    break
                n = np.diff(edge)
                half = -(-n // 2)
                new = np.concatenate([[0], np.cumsum(half)])
                left = (np.arange(new[-1]) - np.repeat(new[:-1], half)) * 2 + np.repeat(edge[:-1], half)
                right = np.minimum(left + 1, np.repeat(edge[1:], half) - 1)
                least, edge, size = np.minimum(least[left], least[right]), new, size * 2
        return found

    def _verified(self, column: pa.Array, found: set[tuple[int, int]], hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """Those finds (row, item, containment) that hold enough of an item's shingles."""
        out, row_set, tuples = [], (-1, None), {}
        for row, item in sorted(found):
            if row_set[0] != row:
                row_set, tuples = (row, np.unique(hashes[first[row] : first[row + 1]])), {}
            n = int(self.width[item])
            if n == SHINGLE and np.isin(self.sets[item], row_set[1], assume_unique=True).sum() < CONTAINMENT * len(self.sets[item]) - 1e-9:
                continue
            if n not in tuples:
                tuples[n] = word_tuples(column[row].as_py() or "", n)
            want = word_tuples(self.texts[item], SHINGLE, True)
            share = len(want & tuples[n]) / len(want)
            if share >= CONTAINMENT - 1e-12:
                out.append((row, item, share))
        return out


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    """The test items with a text, in blocks of about ``block`` items or BLOCK_BYTES."""
    usable = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    count, size = usable.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, ceil(count / block), ceil((size or 0) / BLOCK_BYTES))
    place = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for i in range(n):
        rows = sorted(usable.where(place == i).collect(), key=lambda r: (str(r.item_id), r.text))
        yield Items([r.item_id for r in rows], [r.text for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, containment) of every test item of which a document holds 0.8 or more of the shingles.

    One pass over the documents for each block of items, no shuffle of texts;
    finds are stored after each pass, and its block is let go. Null and empty
    texts hold nothing, items without words are nowhere; items of fewer than
    five words are found where all their words stand in a row. Equal rows give
    equal finds, equal items one each; very long texts are searched whole;
    extra columns, whatever their names, are ignored; an empty table, or none
    of items, gives no finds.
    """
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("containment", T.DoubleType())])
    kind = pa.int64() if isinstance(item_type, T.LongType) else pa.int32() if isinstance(item_type, T.IntegerType) else pa.string()
    out = None
    for items in item_blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batches_of(batch, "text", 1 << 20):
                    rows = shared.value.search(part.column("text"))
                    ids = part.column("doc_id").take(pa.array([r for r, _, _ in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[i] for _, i, _ in rows]).cast(kind) if rows else pa.array([], kind), pa.array([s for _, _, s in rows], pa.float64())], ["doc_id", "item_id", "containment"])

        found = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that hold no test item.

    What null, empty, short, long and repeated texts and items do is as in
    ``find_leaks``; the finds of all blocks are stored by row number, and then
    one join leaves these rows out.
    """
    own = steady(docs)
    row = unused(own, "row")
    own = with_row(own, row)
    leaks = find_leaks(own.select(F.col(row).alias("doc_id"), "text"), benchmark, block)
    return own.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)

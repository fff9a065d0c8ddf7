"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

The model predicts the next token's class from the classes of the tokens
before it: the most frequent words, the end of the text, and classes of all
other words told by their endings. It is trained once on every token of the training
documents, whatever their number: each partition makes a pass from the same
parameters, and the results are averaged by their tokens. Batched matrix products over
the distinct contexts of a batch give normalised log-probabilities. Words of an
ending share its probability by their smoothed corpus counts, so every text has
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches_of, fold, steady, stored, text_bytes, with_row, word_hashes

#: Words with a class of their own, classes of the other words (a power of two), bytes of an ending, context length, dimensions.
VOCABULARY = 510
RARE_BITS, ENDING = 8, 3
CONTEXT = 2
DIMENSIONS = 16
RARE = 1 << RARE_BITS
#: Words whose counts every task holds, at most: those of at least the count that so many words reach. The counts of all others are joined.
DICTIONARY, SLOT_BITS = 1 << 17, 19
#: Partitions whose parameters one task adds up.
GROUP = 16
#: Noise words and tokens of a mini-batch, and Adagrad's rate and first squared gradient. They are the same for tables of any size.
NOISE, BATCH, RATE, START = 64, 256, 0.1, 1e-5
#: Bytes of text that a task trains on, and scores, at a time: more texts share more contexts.
TRAINED, SCORED = 1 << 20, 4 << 20
FOLDS, HELD = 7, 2
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "[\\x20\\x09-\\x0D]+"
_ODD = 2654435761


@dataclass(frozen=True)
class LogBilinear:
    classes: int  # of single words; then comes that of the end, then those of other words
    vectors: np.ndarray  # (classes, d) of context tokens
    mixing: np.ndarray  # (CONTEXT, d)
    targets: np.ndarray  # (classes, d)
    bias: np.ndarray  # (classes,)

    def logits(self, contexts: np.ndarray) -> np.ndarray:
        """Scores (n, classes) before normalisation."""
        hidden = sum(self.vectors[contexts[:, j]] * self.mixing[j] for j in range(CONTEXT))
        logits = hidden.astype(np.float32) @ self.targets.T.astype(np.float32)
        logits += self.bias.astype(np.float32)
        return logits

    def log10_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities (n, classes) after contexts (n, CONTEXT), nearest token last."""
        logits = self.logits(contexts)
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        logits *= np.float32(1 / np.log(10))
        return logits

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.mixing, self.targets, self.bias]


def begin(counts: np.ndarray, own: int, rng: np.random.Generator) -> tuple[LogBilinear, np.ndarray]:
    """The untrained model, which gives the unigram distribution nearly, and that distribution."""
    classes = len(counts)
    unigram = (counts + 0.5) / (counts.sum() + 0.5 * classes)
    r = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
    q = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
    c = np.full((CONTEXT, DIMENSIONS), 1 / CONTEXT, np.float32)
    return LogBilinear(own, r, c, q, np.log(unigram).astype(np.float32)), unigram


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places ``at``, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(rows[order], first, axis=0)


def _step(x: np.ndarray, s: np.ndarray, at: np.ndarray | slice, g: np.ndarray, rate: np.float32) -> None:
    """Adagrad's step on the rows ``at`` alone, since those without a gradient stay."""
    s[at] += g * g
    x[at] += rate * g / np.sqrt(s[at])


def squares(parameters: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of squared gradients before the first step."""
    return [np.full(x.shape, START, np.float32) for x in parameters]


def descend(parameters: list[np.ndarray], sums: list[np.ndarray], target: np.ndarray, context: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, noise: int = NOISE, rate: float = RATE) -> None:
    """Noise-contrastive estimation against the unigram distribution, in place (Adagrad, mini-batches that share noise)."""
    r, c, q, b = parameters
    rate = np.float32(rate)
    log_noise = np.log(noise * unigram).astype(np.float32)
    bounds = np.cumsum(unigram)
    order = rng.permutation(len(target))
    target, context = target.astype(np.int16)[order], context.astype(np.int16)[order]
    batches = max(1, len(order) // BATCH)
    cuts = np.linspace(0, len(order), batches + 1).astype(np.int64).tolist()
    drawn = np.minimum(np.searchsorted(bounds, rng.random((batches, noise))), len(b) - 1).astype(np.int16)
    for k, z in enumerate(drawn):
        w, h = target[cuts[k] : cuts[k + 1]], context[cuts[k] : cuts[k + 1]]
        share = np.float32(1 / len(w))
        vectors = r[h]
        hidden = np.einsum("ijk,jk->ik", vectors, c)
        q_w, q_z = q[w], q[z]
        up = np.einsum("ij,ij->i", hidden, q_w) + b[w] - log_noise[w]
        down = hidden @ q_z.T
        down += b[z] - log_noise[z]
        np.negative(down, out=down)
        for x in (up, down):
            np.clip(x, -30, 30, out=x)
            np.exp(x, out=x)
            x += 1
            np.divide(share, x, out=x)  # 1 - P(data) of tokens, P(data) of noise
        g_hidden = up[:, None] * q_w
        g_hidden -= down @ q_z
        g_b = (np.bincount(w, up, len(b)) - np.bincount(z, down.sum(axis=0), len(b))).astype(np.float32)
        g_c = np.einsum("ik,ijk->jk", g_hidden, vectors)
        at_q, g_q = _row_sums(np.concatenate([w, z]), np.concatenate([up[:, None] * hidden, -down.T @ hidden]))
        at_r, g_r = _row_sums(h.ravel(), (g_hidden[:, None, :] * c).reshape(-1, c.shape[1]))
        for x, s, at, g in zip(parameters, sums, (at_r, slice(None), at_q, slice(None)), (g_r, g_c, g_q, g_b), strict=True):
            _step(x, s, at, g, rate)


def contexts_of(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT classes before each token of texts that start at ``first``, nearest last; the end stands before a text."""
    context = np.full((len(ids), CONTEXT), end, np.int64)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    for j in range(CONTEXT):
        back = CONTEXT - j
        context[back:, j] = ids[:-back]
        context[place < back, j] = end
    return context


def train(sequences: list[np.ndarray], own: int, epochs: int = 3, rare: int = 1, seed: int = 8) -> LogBilinear:
    """Train on sequences of classes in memory."""
    rng = np.random.default_rng(seed)
    target = np.concatenate([np.zeros(0, np.int64), *sequences])
    model, unigram = begin(np.bincount(target, minlength=own + 1 + rare), own, rng)
    if len(target):
        first = np.cumsum([0, *map(len, sequences)])[:-1]
        context = contexts_of(target, first, own)
        sums = squares(model.parameters())
        for _ in range(epochs):
            descend(model.parameters(), sums, target, context, unigram, rng)
    return model


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all words of the training texts."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOW)
    words = training.select(F.explode(F.split(low, _SPLIT)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("c"))


def rare_class(number: Column) -> Column:
    """Class of the words of an ending, from the ending's bytes as a number."""
    return F.call_function("shiftright", (number * F.lit(_ODD)).bitwiseAND(F.lit((1 << 32) - 1)), F.lit(32 - RARE_BITS))


def ending_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for words given as runs of bytes."""
    tail = np.zeros(len(starts), np.uint64)
    for k in range(ENDING if len(data) else 0):
        tail |= np.where(ends - starts > k, LOWER[data[np.maximum(ends - 1 - k, 0)]], 0).astype(np.uint64) << np.uint64(8 * k)
    return (((tail * np.uint64(_ODD)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - RARE_BITS)).astype(np.int64)


class Dictionary:
    """Numbers and classes of words, looked up by the 64 bits of their hashes.

    Hash tables of one value a place: each holds the words for which the ones
    before had no room, so a batch of words is looked up in a few gathers.
    """

    def __init__(self, words: list[bytes], own: int):
        self.size, self.own = len(words), own  # the first words, by count, have classes of their own
        self.hashes = word_hashes(*text_bytes(pa.array(words, pa.binary())))[0] if words else np.zeros(1, np.uint64)
        self.tables: list[np.ndarray] = []
        left = np.arange(len(words))
        while len(left):
            at = self._place(self.hashes[left], len(self.tables))
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]

    @staticmethod
    def _place(hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes * np.uint64(2 * k + 1 + 0x9E3779B97F4A7C14)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those that are not here."""
        out, todo = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        for k, table in enumerate(self.tables):
            found = table[self._place(hashes[todo], k)]
            same = (found >= 0) & (self.hashes[found] == hashes[todo])
            out[todo[same]] = found[same]
            todo = todo[~same]
        return out

    def encode(self, column: pa.Array) -> Encoded:
        """Tokens of the rows of a text column, each row with its end."""
        data, offsets = text_bytes(column)
        hashes, starts, ends, rows = word_hashes(data, offsets)
        number = self.numbers(hashes)
        classes = np.where((number >= 0) & (number < self.own), number, self.own + 1 + ending_classes(data, starts, ends))
        texts = np.arange(len(rows) - 1)
        place = np.arange(len(hashes)) + np.repeat(texts, np.diff(rows))
        ids = np.full(len(hashes) + len(texts), self.own, np.int64)
        ids[place] = classes
        return Encoded(ids, rows[:-1] + texts, place, number, hashes, starts, ends, np.repeat(texts, np.diff(rows)), data)


@dataclass(frozen=True)
class Encoded:
    ids: np.ndarray  # class of every token, ends included
    first: np.ndarray  # place of the first token of each row
    place: np.ndarray  # place of each word among the tokens
    number: np.ndarray  # of each word in the dictionary, or -1
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of each word
    data: np.ndarray

    def unlisted(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Row, word and count of the distinct words of each row that the dictionary does not have."""
        at = np.flatnonzero(self.number < 0)
        order = at[np.lexsort((self.hashes[at], self.row[at]))]
        h, r = self.hashes[order], self.row[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(order) else np.zeros(0, np.int64)
        one = order[new]
        size = self.ends[one] - self.starts[one]
        offsets = np.append(0, np.cumsum(size))
        where = np.arange(offsets[-1]) + np.repeat(self.starts[one] - offsets[:-1], size)
        words = pa.StringArray.from_buffers(len(one), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LOWER[self.data[where]]))
        return self.row[one], words, np.diff(np.append(new, len(order)))


def one_pass(training: DataFrame, model: LogBilinear, dictionary: Dictionary, unigram: np.ndarray, number: int) -> LogBilinear:
    """Train on every token of ``training(text)``: a pass of each partition from ``model``, averaged by their tokens.

    ``number`` tells the draws of this pass from those of others. A task holds the parameters and the tokens of one MB of text (of one text,
    where that is longer). Parameters are added up in tasks of GROUP partitions
    each, in their order, and these sums likewise until GROUP are left.
    """
    shared = training.sparkSession.sparkContext.broadcast((model, dictionary, unigram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, dictionary, unigram = shared.value
        part_id = TaskContext.get().partitionId()
        rng = np.random.default_rng([8, number, part_id])
        parameters = [x.copy() for x in model.parameters()]
        sums = squares(parameters)
        n = 0
        for batch in batches:
            for part in batches_of(batch, "text", TRAINED):
                found = dictionary.encode(part.column("text"))
                descend(parameters, sums, found.ids, contexts_of(found.ids, found.first, dictionary.own), unigram, rng)
                n += len(found.ids)
        if n:
            flat = np.concatenate([x.ravel() for x in parameters]).astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([part_id]), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total = None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "sums"])
        for batch in batches:
            for key, more, sums in zip(*(batch.column(c).to_pylist() for c in ("set", "n", "sums")), strict=True):
                if key != now:
                    if now is not None:
                        yield row()
                    now, n, total = key, 0, 0.0
                n, total = n + more, total + np.frombuffer(sums)
        if now is not None:
            yield row()

    schema = "part long, n long, sums binary"
    texts = training.select(F.col("text").cast("string").alias("text"))
    found, left = texts.mapInArrow(run, schema), texts.rdd.getNumPartitions()
    while left > GROUP:
        by_set = found.withColumn("set", F.floor(F.col("part") / GROUP)).repartition("set").sortWithinPartitions("set", "part")
        found, left = by_set.select("set", "n", "sums").mapInArrow(add, schema), -(-left // GROUP)
    rows = sorted((r.part, r.n, r.sums) for r in found.collect())
    if not rows:
        return model
    flat = sum(np.frombuffer(s) for _, _, s in rows) / sum(n for _, n, _ in rows)
    shapes = [x.shape for x in model.parameters()]
    cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
    return LogBilinear(model.classes, *(x.reshape(k).astype(np.float32) for x, k in zip(np.split(flat, cuts), shapes, strict=True)))


def fit(training: DataFrame, dictionary: Dictionary, counts: np.ndarray) -> LogBilinear:
    """Train on every token of ``training`` once, however many there are; ``counts`` are its tokens of each class."""
    model, unigram = begin(counts, dictionary.own, np.random.default_rng(8))
    return one_pass(training, model, dictionary, unigram, 0)


def score_classes(model: LogBilinear, ids: np.ndarray, first: np.ndarray, block: int = 512) -> np.ndarray:
    """Log10 probability of each token's class; ``ids`` are the classes of texts that start at ``first``."""
    classes = len(model.bias)
    context = contexts_of(ids, first, model.classes)
    key = context[:, 0]
    for j in range(1, CONTEXT):
        key = key * classes + context[:, j]
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(ids) else np.zeros(0, np.int64)
    out = np.empty(len(ids))
    for a in range(0, len(new), block):
        b = min(len(new), a + block)
        table = model.logits(context[order[new[a:b]]])
        lo, hi = new[a], new[b] if b < len(new) else len(ids)
        at = order[lo:hi]
        row = np.repeat(np.arange(b - a), np.diff(np.append(new[a:b], hi)))
        own = table[row, ids[at]]
        most = table.max(axis=1)
        table -= most[:, None]
        np.exp(table, out=table)
        out[at] = own - (most + np.log(table.sum(axis=1)))[row]
    out *= 1 / np.log(10)
    return out


def listed_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words of ``counts(word, c)`` of at least the count that no more than ``most`` words reach, most frequent first.

    A histogram of the counts, in an eighth of a doubling, gives that count.
    """
    level = F.floor(F.log2("c") * 8)
    reached, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reached += r["count"]
        if reached > most:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(((r.word, r.c) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Counts and the model cover all training documents (those whose id's crc32
    modulo 7 is not 2; null ids train too). What a partition learns depends on
    the texts beside it, so the last digits of score depend on how the files
    are split. Frequent words are scored where the text is read, by a table of
    at most DICTIONARY words told by 64 bits of hash; only others, once for
    each document, are shuffled to their counts. The rest of a document
    travels with them under a key of its own that no word equals, so no key
    has more than its share. Null and empty texts are one end token; very long
    ones are scored whole; equal rows get equal scores; extra columns are
    ignored; an empty table gives no rows.
    """
    docs = steady(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    training = docs.where(~held)
    counts = stored(word_counts(training), "word-counts")
    n_docs = training.count()
    ending = F.conv(F.hex(F.substring(F.col("word").cast("binary"), -ENDING, ENDING)), 16, 10).cast("bigint")
    by_class = counts.groupBy(rare_class(ending).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    n_words, distinct = sum(r.c for r in by_class), sum(r.types for r in by_class)
    total, types = n_words + n_docs, distinct + (n_docs > 0)
    top = listed_words(counts, DICTIONARY)
    own = min(VOCABULARY, len(top))
    dictionary = Dictionary([w.encode("utf-8") for w, _ in top], own)
    rare = np.zeros((2, RARE))
    for r in by_class:
        rare[:, r.k] = r.c, r.types
    if own:
        data, offsets = text_bytes(pa.array([w for w, _ in top[:own]]))
        of = ending_classes(data, offsets[:-1], offsets[1:])
        np.subtract.at(rare[0], of, [c for _, c in top[:own]])
        np.subtract.at(rare[1], of, 1)
    model = fit(training, dictionary, np.array([*(c for _, c in top[:own]), n_docs, *rare[0]], float))
    # A word of an ending's class has (c + 1) of its tokens, types and one unseen word.
    shares = np.concatenate([np.zeros(own + 1), np.log10(rare.sum(axis=0) + 1)])
    logs = np.log10(np.array([c + 1 for _, c in top] + [1], float))
    shared = docs.sparkSession.sparkContext.broadcast((model, dictionary, logs, shares, n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, dictionary, logs, shares, n_docs = shared.value
        names = ["row", "doc_id", "word", "n", "n_tokens", "n_known", "log_counts", "log_classes"]
        null = lambda k, t: pa.nulls(k, t)
        for batch in batches:
            for part in batches_of(batch, "text", SCORED):
                found = dictionary.encode(part.column("text"))
                by_token = score_classes(model, found.ids, found.first) - shares[found.ids]
                by_count = np.full(len(found.ids), np.log10(n_docs + 1))
                by_count[found.place] = logs[found.number]  # the last one, 0, is that of words not listed
                shared_class = found.number >= model.classes
                by_token[found.place[shared_class]] += logs[found.number[shared_class]]
                rows, words, n = found.unlisted()
                ids = np.asarray(part.column("row"))
                sizes = np.diff(np.append(found.first, len(found.ids)))
                known = sizes - np.bincount(found.row[found.number < 0], minlength=len(ids)) - (0 if n_docs else 1)
                k = len(rows)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array([f" {x}" for x in ids.tolist()], pa.string()), null(len(ids), pa.int64()), pa.array(sizes), pa.array(known), pa.array(np.add.reduceat(by_count, found.first)), pa.array(np.add.reduceat(by_token, found.first))], names)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), null(k, pa.int64()), words, pa.array(n, pa.int64()), *(null(k, pa.int64()) for _ in range(2)), *(null(k, pa.float64()) for _ in range(2))], names)

    parts = with_row(docs.select(F.col("doc_id").cast("bigint"), "text"), "row").mapInArrow(run, "row bigint, doc_id bigint, word string, n bigint, n_tokens bigint, n_known bigint, log_counts double, log_classes double")
    # Counts are spread evenly by their words, so each task builds its table of a small share of the vocabulary.
    joined = parts.join(counts.hint("shuffle_hash"), "word", "left")
    more = F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("n")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("log_counts", more)).alias("log_counts"), F.sum(F.coalesce("log_classes", more)).alias("log_classes"),
    )
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))
    return sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), F.col("log_classes").alias("score"))

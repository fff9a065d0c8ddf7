"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed
toxic examples and unlabelled text, with the class-prior-corrected risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_ALNUM, batches_of, fold, text_bytes, with_columns, word_hashes

BITS = 17
#: Bounds of the training sample, in rows, and the folds that labels may come from.
POSITIVES = 3_000
UNLABELLED = 6_000
FOLDS = 5
#: Largest class prior that is taken from the labels.
MOST_TOXIC = 0.25
#: A feature counts if it is in so many positives, and in such a share of them.
LEAST_DOCS = 4
LEAST_SHARE = 0.02
#: and is so many times as common there as in unlabelled text.
LEAST_LIFT = 3.0


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each row: features, their weights, and row offsets.

    A weight is the square root of the word's share of the text; a row's
    weights have the Euclidean length 1.
    """
    data, offsets = text_bytes(column)
    hashes, _, _, rows = word_hashes(data, offsets, NOT_ALNUM)
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    keys, n = np.unique((row << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row = keys >> BITS
    size = np.maximum(counts, 1)[row]
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.sqrt(n / size).astype(np.float32), np.searchsorted(row, np.arange(len(counts) + 1))


def _dot(weights: np.ndarray, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[feature] * value, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def train(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float, epochs: int = 60, rate: float = 0.1, decay: float = 1e-6, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk with the logistic loss (Adam, mini-batches)."""
    dims = 1 << BITS
    w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w.astype(np.float32), b
    # Words of a few positives only say which example it is, and words as common elsewhere say nothing.
    df = lambda rows: np.bincount(np.concatenate([r[0] for r in rows]), minlength=dims)
    in_p, in_u = df(positive), df(unlabelled)
    spread = (in_p >= max(LEAST_DOCS, LEAST_SHARE * len(positive))) & (in_p / len(positive) >= LEAST_LIFT * in_u / len(unlabelled))
    cut = lambda rows: [(f[keep], x[keep]) for f, x in rows for keep in (spread[f],)]
    positive, unlabelled = cut(positive), cut(unlabelled)
    rng = np.random.default_rng(seed)
    m, v, mb, vb, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 0
    steps = max(4, min(24, len(unlabelled) // 256))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), steps), np.array_split(rng.permutation(len(unlabelled)), steps)
        for p_ids, u_ids in zip(ps, us, strict=True):
            if not len(p_ids) or not len(u_ids):
                continue
            rows = [positive[i] for i in p_ids] + [unlabelled[i] for i in u_ids]
            feature, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            sizes = np.array([len(r[0]) for r in rows])
            first = np.concatenate([[0], np.cumsum(sizes)])
            f = _dot(w, feature, value, first) + b
            s, k = sigmoid(f), len(p_ids)
            negative = np.logaddexp(0, f[k:]).mean() - prior * np.logaddexp(0, f[:k]).mean()
            slope = np.empty(len(f))
            if negative >= 0:  # the whole risk
                slope[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
                slope[k:] = s[k:] / len(u_ids)
            else:  # over-fitted: climb back along the negative part
                slope[:k] = prior * s[:k] / k
                slope[k:] = -s[k:] / len(u_ids)
            g = np.bincount(feature, weights=value * np.repeat(slope, sizes), minlength=dims) + decay * w
            gb = float(slope.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32), b


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text"):
                feature, value, first = hashed_words(part.column("text"))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("positive"), cut(feature), cut(value)], ["positive", "feature", "value"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, feature binary, value binary")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Train on at most ``positives`` toxic and ``unlabelled`` other documents outside fold 0.

    Both are those with the smallest hash of their id, so the sample does not
    depend on partitioning. The class prior is the share of toxic rows among
    the labels outside fold 0, unless given, and at most MOST_TOXIC: labels are
    often picked, and a text without any sign must not count as toxic. Only hashed features of the
    bounded sample reach the driver.
    """
    usable = labels.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(MOST_TOXIC, max(0.005, share if share is not None else 0.05))
    place = F.xxhash64(F.col("doc_id").cast("string"))
    toxic = usable.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(place, "doc_id").limit(positives)
    other = docs.where(fold(F.col("doc_id"), FOLDS) != 0).select("doc_id").join(usable.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", F.lit(False).alias("positive")).orderBy(place, "doc_id").limit(unlabelled)
    chosen = toxic.unionByName(other)  # at most positives + unlabelled ids
    found: dict[bool, list] = {True: [], False: []}
    # Of rows with equal ids the smallest text is taken, so the bound on ids is one on rows.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    for row in _features(texts).collect():
        found[row.positive].append((np.frombuffer(row.feature, np.int32), np.frombuffer(row.value, np.float32)))
    order = lambda rows: sorted(rows, key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes()))  # noqa: E731  the same model whatever the order of tasks
    return train(order(found[True]), order(found[False]), prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """Add column ``name`` (0 to 1) to the rows of ``docs``; the model is a vector of fixed size.

    Null and empty texts get the score of a text without features; very long
    ones are scored whole; equal rows get equal scores. A column of that name is
    replaced; other columns stay as they are. An empty table stays empty.
    """
    weights, intercept = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        feature, value, first = hashed_words(part.column("text"))
        f = _dot(shared.value, feature, value, first) + intercept
        return [pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))), pa.float64())]

    return with_columns(docs.drop(name), work, T.StructType([T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a null id is never held out.

    Null, empty, long and repeated texts are as in ``score``; without labels
    every score is the prior. Extra columns, whatever their names, are ignored.
    """
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

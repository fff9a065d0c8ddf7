"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is a position of the chain. Its features are hashed
character trigrams with word boundaries, a prefix and a suffix of three
characters, and the word itself (the lexicon); transitions between languages
are learned from training sequences that switch language. Forward-backward
gives each word's distribution, and a document takes the language with the
highest mean over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches_of, fold, mix, text_bytes, word_hashes

#: Sizes of the hashed feature tables.
TRIGRAMS, AFFIXES, LEXICON = 15, 13, 16
#: Bounds of the training sample: documents of each language, words of a document.
DOCUMENTS, WORDS = 200, 2_000
#: With more languages than MANY each has fewer documents, FEW at least, and weights are of single precision.
MANY, FEW = 64, 20
SEQUENCE = 48
FOLDS = 5
#: Bytes that end a word: everything in ASCII but letters.
NOT_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
_TRI, _PRE, _SUF, _LEX = 0, 1 << TRIGRAMS, (1 << TRIGRAMS) + (1 << AFFIXES), (1 << TRIGRAMS) + (2 << AFFIXES)
FEATURES = _LEX + (1 << LEXICON)


@dataclass(frozen=True)
class Crf:
    languages: tuple[str, ...]
    weights: np.ndarray  # (FEATURES, languages)
    transitions: np.ndarray  # (languages, languages), log scale


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram features of all bytes in words, the first of each word, prefix, suffix and lexicon feature, and row offsets."""
    data, offsets = text_bytes(column)
    hashes, starts, ends, rows = word_hashes(data, offsets, NOT_LETTER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 3), np.int64), rows, ends
    low = LOWER[data].astype(np.uint32)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(size.sum()) + np.repeat(starts - first, size)
    before, after = np.roll(low[at], 1), np.roll(low[at], -1)
    before[first] = 0
    after[first + size - 1] = 0
    tri = before | (low[at] << np.uint32(8)) | (after << np.uint32(16))
    tri = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAMS)).astype(np.int64)
    part = lambda k, where: np.where(size > k, low[np.clip(where, 0, len(low) - 1)], 0)
    head = part(0, starts) | (part(1, starts + 1) << np.uint32(8)) | (part(2, starts + 2) << np.uint32(16))
    tail = part(0, ends - 1) | (part(1, ends - 2) << np.uint32(8)) | (part(2, ends - 3) << np.uint32(16))
    fixed = np.empty((len(starts), 3), np.int64)
    fixed[:, 0] = _PRE + ((head.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - AFFIXES))
    fixed[:, 1] = _SUF + ((tail.astype(np.uint32) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - AFFIXES))
    fixed[:, 2] = _LEX + (mix(hashes) >> np.uint64(64 - LEXICON)).astype(np.int64)
    return tri, first, fixed, rows, size


def emissions(weights: np.ndarray, tri: np.ndarray, first: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Score of each language for each word; sums run in double precision."""
    if not len(first):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = np.add.reduceat(weights[tri], first, axis=0)
    for k in range(3):
        out += weights[fixed[:, k]]
    return out


def marginals(scores: np.ndarray, transitions: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Forward-backward over all rows at once: each word's distribution over languages.

    Rows are ordered by length, so step t works on those that have a t-th word.
    """
    n, k = scores.shape
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)) if n else scores
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    length = np.diff(rows)
    order = np.argsort(-length, kind="stable")
    start, sorted_length = rows[:-1][order], length[order]
    alive = np.searchsorted(-sorted_length, -np.arange(1, (sorted_length[0] if len(order) else 0) + 1), "right")
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    now = None
    for t, m in enumerate(alive):
        at = start[:m] + t
        now = psi[at] if now is None else (now[:m] @ step) * psi[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    later = np.zeros((0, k), psi.dtype)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = start[:m] + t
        now = np.full((m, k), 1.0 / k, psi.dtype)
        if len(later):
            x = (later * psi[start[: len(later)] + t + 1]) @ step.T
            now[: len(later)] = x / x.sum(axis=1, keepdims=True)
        beta[at] = now
        later = now
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma


def train(texts: list[tuple[str, str]], languages: list[str], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> Crf:
    """Maximum-likelihood training (Adagrad) on sequences that switch language.

    Sequences of a fixed number of words are made of runs of 4 to 20 words of
    one document, in random order, so that transitions are seen.
    """
    k = len(languages)
    index = {x: i for i, x in enumerate(languages)}
    tri, first, fixed, rows, size = features(pa.array([t for _, t in texts], pa.string()))
    label = np.repeat(np.array([index[x] for x, _ in texts], np.int64), np.diff(rows))
    real = np.float64 if k <= MANY else np.float32
    weights, squares = np.zeros((FEATURES, k), real), np.full((FEATURES, k), 1e-2, real)
    trans, trans_squares = np.zeros((k, k)), np.full((k, k), 1e-2)
    if not len(label) or k == 1:
        return Crf(tuple(languages), weights.astype(np.float32), trans)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        cuts = []
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            while a < b:
                c = min(b, a + int(rng.integers(4, 21)))
                cuts.append((a, c))
                a = c
        runs = [cuts[i] for i in rng.permutation(len(cuts))]
        words = np.concatenate([np.arange(a, b) for a, b in runs])
        words = words[: len(words) // SEQUENCE * SEQUENCE].reshape(-1, SEQUENCE)
        for block in np.array_split(words, max(1, len(words) // max(1, min(128, 128 * MANY // k)))):
            ids = block.ravel()
            if not len(ids):
                continue
            sizes = size[ids]
            lead = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = tri[np.arange(sizes.sum()) + np.repeat(first[ids] - lead, sizes)]
            psi = emissions(weights, own, lead, fixed[ids]).reshape(len(block), SEQUENCE, k)
            psi = np.exp(psi - psi.max(axis=2, keepdims=True))
            step = np.exp(trans)
            alpha, beta = np.empty_like(psi), np.empty_like(psi)
            alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
            beta[:, -1] = 1.0
            for t in range(1, SEQUENCE):
                x = (alpha[:, t - 1] @ step) * psi[:, t]
                alpha[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(SEQUENCE - 2, -1, -1):
                x = (beta[:, t + 1] * psi[:, t + 1]) @ step.T
                beta[:, t] = x / x.sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            y = label[block]
            right = psi[:, 1:] * beta[:, 1:]
            before, right = alpha[:, :-1].reshape(-1, k), right.reshape(-1, k)
            g_trans = step * ((before / ((before @ step) * right).sum(axis=1, keepdims=True)).T @ right)
            np.subtract.at(g_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            error = gamma.reshape(-1, k)
            error[np.arange(len(ids)), y.ravel()] -= 1.0
            used, code = np.unique(np.concatenate([own, fixed[ids].T.ravel()]), return_inverse=True)
            for j in range(k):
                spread = np.concatenate([np.repeat(error[:, j], sizes), np.tile(error[:, j], 3)])
                g = np.bincount(code, weights=spread, minlength=len(used)) / len(block)
                squares[used, j] += g * g
                weights[used, j] -= rate * g / np.sqrt(squares[used, j])
            g_trans /= len(block)
            trans_squares += g_trans * g_trans
            trans -= rate * g_trans / np.sqrt(trans_squares)
    return Crf(tuple(languages), weights.astype(np.float32), trans)


def fit(docs: DataFrame, documents: int = DOCUMENTS, words: int = WORDS) -> Crf:
    """Train on at most ``documents`` texts of every language outside fold 0, fewer of each where there are more than MANY.

    Of a long training text a run of ``words`` words is taken; the sample is
    that of the smallest id hashes, so it does not depend on partitioning.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    counts = usable.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return Crf(("und",), np.zeros((FEATURES, 1), np.float32), np.zeros((1, 1)))
    documents = min(documents, max(FEW, documents * MANY // len(counts)))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    unit = F.pmod(place, F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2.0 * documents + 50) / r["count"]))])
    tokens = F.split("text", "\\s+")
    start = F.pmod(place, F.greatest(F.lit(1), F.size("tokens") - words)).cast("int") + 1
    near = usable.where(unit < share[F.col("lang")]).select("lang", "doc_id", place.alias("place"), tokens.alias("tokens"))
    sample = near.select("lang", "place", "doc_id", F.array_join(F.slice("tokens", start, F.lit(words)), " ").alias("text"))
    sample = sample.selectExpr("*", "row_number() over (partition by lang order by place, doc_id, text) as n").where(F.col("n") <= documents)
    texts = sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").collect())
    return train(texts, sorted(r["lang"] for r in counts))


def label_words(crf: Crf, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of all words of the rows of a text column, and row offsets."""
    scores, counts = [], []
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part in batches_of(batch, "text", 1 << 20):
        tri, first, fixed, rows, _ = features(part.column(0))
        scores.append(emissions(crf.weights, tri, first, fixed))
        counts.append(np.diff(rows))
    rows = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    scores = np.concatenate(scores) if scores else np.zeros((0, len(crf.languages)), np.float32)
    return marginals(scores, crf.transitions, rows), rows


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; extra columns, whatever their names, are ignored.

    Score is the mean probability of the predicted language over all words.
    Null texts and those without a letter get ``und`` and 0; texts whose only
    letters stand in no word of the chain do not exist, since every letter
    belongs to one. Very long texts are labelled whole; equal rows get equal
    results; ties go to the first language in order; an empty table gives an
    empty one. The model has 115,000 weights for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            for part in batches_of(batch, "text", (24 << 20) * 4 // max(4, len(names))):
                gamma, rows = label_words(model, part.column("text"))
                count = np.diff(rows)
                sums = np.zeros((len(gamma) + 1, gamma.shape[1]))
                np.cumsum(gamma, axis=0, dtype=np.float64, out=sums[1:])
                mean = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(count, 1)[:, None]
                best = mean.argmax(axis=1)
                data, offsets = text_bytes(part.column("text"))
                plain = (LOWER[data] >= 97) & (LOWER[data] <= 122)
                seen = np.concatenate([[0], np.cumsum(plain)])
                letters = seen[offsets[1:]] > seen[offsets[:-1]]
                for i in np.flatnonzero(~letters & (count > 0)):
                    letters[i] = any(c.isalpha() for c in part.column("text")[int(i)].as_py())
                lang = np.where(letters, names[best], "und")
                score = np.where(letters, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

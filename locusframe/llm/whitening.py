"""Whitening of embedding vectors by merged covariances.

Each task sums up its vectors as a count, exact sums and a scatter about its
own mean; the pairwise formula of Chan, Golub and LeVeque merges two such
sums, in a tree over the tasks. The eigenvectors are found on the driver, whose
share follows the dimensions and not the rows. A second pass sums up the
whitened vectors in the same way, which must give the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of a block that is multiplied at once.
BLOCK = 1 << 21
#: Larger entries are no numbers of this kind: 64 of them would not be whole in double precision.
LARGEST = 2.0**46


@dataclass(frozen=True)
class Summed:
    """Count, sums and scatter about the mean of some vectors."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summed:
        """``x`` has a vector in each row, of whole numbers or of doubles."""
        if not len(x):
            return Summed(0, np.zeros(x.shape[1], x.dtype), np.zeros((x.shape[1],) * 2))
        near = np.rint(x.mean(axis=0)).astype(x.dtype) if x.dtype == np.int64 else x.mean(axis=0)
        z = (x - near).astype(np.float64)
        rest = z.sum(axis=0)
        return Summed(len(x), x.sum(axis=0), z.T @ z - np.outer(rest, rest) / len(x))

    def merge(self, other: Summed) -> Summed:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.total / other.n - self.total / self.n
        return Summed(n, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass(frozen=True)
class Whitening:
    """Sums of the vectors (as multiples of 1 / SCALE, less SHIFT), and the components by falling eigenvalue."""

    n: int
    total: np.ndarray  # of whole numbers without SHIFT
    vectors: np.ndarray  # (dimensions, components)
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dims`` finite entries, and floor(SCALE * entry) of them."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)))
    flat = column.take(pa.array(rows)).flatten()
    c = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), np.float64).reshape(len(rows), dims)
    good = (np.abs(c) < LARGEST).all(axis=1)  # not so for NaN
    return rows[good], np.floor(SCALE * c[good]).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of about BLOCK entries, their good rows and whole numbers."""
    most = max(1, BLOCK // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part, *whole(part.column(column), dims)


def dimensions(table: DataFrame, column: str) -> int:
    """Length of most of the whole vectors; of equally many the longest; 0 without any."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0))
            many = {int(d): len(whole(batch.column(column), int(d))[0]) for d in np.unique(sizes[sizes > 0])}
            yield pa.RecordBatch.from_arrays([pa.array(many.keys(), pa.int64()), pa.array(many.values(), pa.int64())], ["dims", "n"])

    counts = table.select(F.col(column)).mapInArrow(lengths, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n"))
    found = counts.where("n > 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return found[0]["dims"] if found else 0


def merged(table: DataFrame, column: str, dims: int, view: Callable[[np.ndarray], np.ndarray], width: int, dtype: type) -> Summed:
    """Summed ``view`` of all whole vectors; one row leaves each task, and a tree of tasks merges them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Summed.of(np.zeros((0, width), dtype))
        for _, _, x in blocks(batches, column, dims):
            now = now.merge(Summed.of(view(x)))
        yield pa.RecordBatch.from_arrays([pa.array([now.n]), pa.array([now.total.tobytes()]), pa.array([now.scatter.tobytes()])], ["n", "total", "scatter"])

    rows = table.select(F.col(column)).mapInArrow(summarise, "n long, total binary, scatter binary").rdd
    if not rows.getNumPartitions():
        return Summed.of(np.zeros((0, width), dtype))
    sums = rows.map(lambda r: Summed(r["n"], np.frombuffer(r["total"], dtype), np.frombuffer(r["scatter"]).reshape(width, width)))
    return sums.treeReduce(Summed.merge)


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of the whole vectors of a column of arrays.

    Null vectors, those with a null, non-finite or huge entry (2 ** 46) and
    those of another length than most are left out. Components whose
    eigenvalue is nothing but rounding are none, so constant vectors, a single
    vector and an empty table have no component.
    """
    dims = dimensions(table, column)
    summed = merged(table, column, dims, lambda x: x, dims, np.int64)
    if not summed.n:
        return Whitening(0, np.zeros(dims, np.int64), np.zeros((dims, 0)), np.zeros(0), 0.0)
    covariance = summed.scatter / summed.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0.0) * dims * np.finfo(float).eps][:components]
    return Whitening(summed.n, summed.total, vectors[:, order], values[order], float(np.trace(covariance)))


def projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates of whole numbers ``x``."""
    apart = (x - model.total // model.n).astype(np.float64) - (model.total % model.n) / model.n
    return apart @ (model.vectors / np.sqrt(model.values))


def identity_error(table: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    found = merged(table, column, len(model.total), lambda x: projected(model, x), k, np.float64)
    return float(np.abs(found.scatter / found.n - np.eye(k)).max())


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum) ** 2, exact; null where it does not fit in 64 bits."""
    if len(x) and model.n * (np.abs(x).max() + np.abs(model.total).max() / model.n + 1.0) < 2.0**31 / len(model.total) ** 0.5:
        apart = model.n * x - model.total
        return (apart * apart).sum(axis=1).tolist()
    total = [int(s) for s in model.total]
    found = (sum((model.n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in found]


def transform(table: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Rows of ``table`` with a whole vector, with ``whitened array<double>`` and ``deviation``; columns of these names are replaced, others stay."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kept = table.drop("whitened", "deviation")
    schema = T.StructType([*kept.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k = len(known.values)
        for part, rows, x in blocks(batches, column, len(known.total)):
            good = part.take(pa.array(rows))
            flat = projected(known, x).ravel() if len(rows) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*good.columns, lists, pa.array(deviations(known, x), pa.int64())], schema=pa.schema([*good.schema, pa.field("whitened", lists.type), pa.field("deviation", pa.int64())]))

    return kept.mapInArrow(run, schema)


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every whole vector and component.

    Vectors are left out as in ``fit``; repeated rows and equal or null ids
    have rows of their own; a table without components has none; extra
    columns, whatever their names, are ignored.
    """
    table = vectors.select("vec_id", "embedding")
    model = fit(table)
    error = identity_error(table, model)
    explained = F.array(*(F.lit(e) for e in model.explained)).cast("array<double>")
    rows = transform(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, whose driver is its executor, may go without one: a
    temporary folder then takes its place. On a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later table is computed from."""
    for df in tables:
        if df is not None:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Ask for what past queries have left behind to be removed.

    Spark deletes the shuffles of past queries when the driver collects its
    garbage, which it may not do for long.
    """
    spark.sparkContext._jvm.System.gc()


def named(c: str) -> Column:
    """The column of that name, dots and backticks being part of it."""
    return F.col("`" + c.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not: ``name``, with more underscores if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], added: T.StructType, most: int = 8 << 20) -> DataFrame:
    """Rows of ``df`` with columns ``added`` that ``work`` computes from parts of batches with about ``most`` bytes of text.

    Columns may have any names: those that are no plain identifiers have
    others while ``work`` sees them, and get theirs back by position.
    """
    names: list[str] = []
    for i, c in enumerate([*df.columns, *added.names]):
        name = c if c.isidentifier() else f"c{i}"
        while name.lower() in {x.lower() for x in [*names, *df.columns[i + 1 :]]}:
            name += "_"
        names.append(name)
    plain = df.toDF(*names[: len(df.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", most):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names)

    schema = T.StructType([*plain.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names[len(df.columns) :], added.fields, strict=True))])
    return plain.mapInArrow(run, schema).toDF(*df.columns, *added.names)


#: Operations that give the same rows in the same order to the same task whenever they run.
_STEADY = frozenset("Project Filter Relation LogicalRDD LocalRelation SubqueryAlias".split())


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself if a second run deals the same rows to the same tasks, or else a stored copy.

    Scans of files do, as long as their splits do not follow the number of
    cores, which changes when executors are lost: so that number is pinned for
    the session, unless it is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    random = any(x in plan for x in ("rand(", "randn(", "uuid(", "shuffle("))
    return df if steps <= _STEADY and not random else stored(df, "rows")


def with_row(df: DataFrame, name: str = ROW) -> DataFrame:
    """Add a row number that a second run gives again; ``df`` must be ``steady``."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: A key with more than 1 / HEAVY of all rows is heavy, so there are fewer than HEAVY of them.
HEAVY = 4096


def join_counted(many: DataFrame, one: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key and in column ``n`` how many rows of ``many`` have it.

    Fewer than HEAVY keys can hold more than 1 / HEAVY of the rows. Those are
    broadcast, so their rows stay where they are; all others are shuffled,
    and no task gets a group larger than that share. ``one`` should be stored.
    """
    keys = [key] if isinstance(key, str) else key
    total = one.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(one.where(F.col(n) > max(1024, total // HEAVY)))
    light = one.where(F.col(n) <= max(1024, total // HEAVY)).hint("shuffle_hash")
    alone = many.join(heavy.select(*keys), keys, "left_anti")
    return many.join(heavy, keys).unionByName(alone.join(light, keys))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def key_text(c: Column) -> Column:
    """A non-null text key: null gets a value that no text has."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


# --- vectorised work on Arrow text columns --------------------------------

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits; bytes of longer characters count as letters.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SLICE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over uint64 values (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_P, _PINV):
            row = np.full(_SLICE + 1, base, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows of a text column, ASCII in lower case.

    Returns their 64-bit hashes, first bytes, ends, and for each row the
    number of its first word (one more at the end). Works in slices of one
    MB, so memory follows the words and not eight times the bytes.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables()
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        to = max(done + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        stop = ends[to - 1]
        if stop - base > _SLICE:  # one word longer than a slice
            value = 0
            for b in LOWER[data[base:stop]].tolist():
                value = (value * 1099511628211 + b + 1) & 0xFFFFFFFFFFFFFFFF
            out[done] = value
        else:
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum((LOWER[data[base:stop]].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
            s, e = starts[done:to] - base, ends[done:to] - base
            out[done:to] = (sums[e] - sums[s]) * down[s]
        done = to
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out), starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each row, and for each row the first one.

    A row of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(rows)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.zeros(len(rows), np.int64)
    np.cumsum(runs, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(rows[:-1] - first[:-1], runs)
    width = np.repeat(np.minimum(counts, n), runs)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = width.astype(np.uint64)
    for j in range(n):
        term = padded[at + j]
        if j:
            term = np.where(width > j, term, np.uint64(0))
        out = (out ^ term) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out), first


def distinct_pairs(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one each of the distinct pairs of row and hash, an order that puts equal pairs together, and where in it they begin.

    Pairs are sorted by 64 bits of both, which takes a fraction of the time of a sort by two keys.
    """
    key = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return order[start], order, start


#: Rows of a part of a batch; their numbers fit in 16 bits.
ROWS = 1 << 15


def batches_of(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of a record batch with about ``most`` bytes of text, and at most ROWS rows, each."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, at + ROWS)
        yield batch.slice(at, to - at)
        at = to

"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, key_text, unused

#: Largest mean drawn at once; a larger one is a sum of independent draws.
PIECE = 32.0
#: Uniform numbers have this many hexadecimal digits of an MD5.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, equal on any engine."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def poisson(mean: Column, u: Column) -> Column:
    """Inverse Poisson distribution at u for a mean of at most ``PIECE``.

    Walks the distribution function until it passes u; at this mean fewer than
    1 in 1e17 numbers would need a step beyond the last one.
    """
    start = F.struct(F.lit(0).alias("n"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))
    step = lambda a, k: F.when(
        a["cdf"] <= u, F.struct((a["n"] + 1).alias("n"), (a["p"] * mean / k).alias("p"), (a["cdf"] + a["p"] * mean / k).alias("cdf"))
    ).otherwise(a)
    steps = F.sequence(F.lit(1), (F.ceil(mean + 9 * F.sqrt(mean)) + 24).cast("int"))
    return F.aggregate(steps, start, step, lambda a: a["n"])


def copies(mean: Column, key: Column, seed: int) -> Column:
    """How often to repeat a document: Poisson with this mean, fixed by its key and seed."""
    pieces = F.greatest(F.lit(1), F.ceil(mean / F.lit(PIECE)).cast("int"))
    draw = lambda j: poisson(mean / pieces, uniform(F.lit(str(seed)), key, j.cast("string")))
    return F.when(mean > 0, F.aggregate(F.transform(F.sequence(F.lit(1), pieces), draw), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, epoch: float = 1.0) -> DataFrame:
    """Mean repetition rate of each source: (source_key, n_docs, rate).

    The target weight of a source is given in ``weights`` (sources that it
    leaves out get 0), or else its document count to the power
    ``temperature``. Rates make the expected mix equal the weights and its
    expected size ``epoch`` times the table. A null source is a source of its own.
    """
    counted = docs.groupBy(key_text(F.col("source")).alias("source_key")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighted = counted.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("n" if k is None else f"v{k}", float(v))]) if weights else F.lit(None).cast("map<string,double>")
        weighted = counted.withColumn("w", F.coalesce(pairs[F.col("source_key")], F.lit(0.0)))
    total = weighted.agg(F.sum("w").alias("all_w"), F.sum("n_docs").alias("all_docs"))
    # One row of totals meets the sources, of which there are far fewer than documents.
    rate = F.when(F.col("all_w") > 0, F.lit(epoch) * F.col("all_docs") * F.col("w") / F.col("all_w") / F.col("n_docs")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(total)).select("source_key", "n_docs", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, epoch: float = 1.0, seed: int = 17, broadcast_rows: int = 10_000, salts: int = 64) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle globally.

    Returns all columns of ``docs`` with rate, copy (from 1) and shuffle_key;
    rows are dealt to partitions and ordered there by the MD5-based key, which
    puts any copy at any place of the output with equal chance. Documents with
    a null id are drawn by their text; equal rows get equal counts. Null, empty
    and very long texts are rows like any other. An empty table gives an empty
    result. Columns named rate, copy or shuffle_key are replaced; others may
    have any name. Rates are broadcast only up to
    ``broadcast_rows`` sources; beyond that they are joined by salted keys, as
    one source may hold a third of all rows.
    """
    docs = docs.drop("rate", "copy", "shuffle_key")
    own_key, salt, drawn = (unused(docs, x) for x in ("source_key", "salt", "drawn"))
    rates = source_rates(docs, weights, temperature, epoch).select(F.col("source_key").alias(own_key), "rate")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    keyed = docs.withColumn(own_key, key_text(F.col("source")))
    if bounded(docs.select("source").distinct(), broadcast_rows):
        rated = keyed.join(F.broadcast(rates), own_key)
    else:
        keyed = keyed.withColumn(salt, F.pmod(F.hash(key), F.lit(salts)))
        rated = keyed.join(rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [own_key, salt]).drop(salt)
    n = copies(F.col("rate"), key, seed)
    taken = rated.withColumn(drawn, n).where(F.col(drawn) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(drawn)))).drop(drawn, own_key)
    placed = taken.withColumn("shuffle_key", uniform(F.lit(str(seed)), F.lit("place"), key, F.col("copy").cast("string")))
    return placed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")


MIX_COLUMNS = "doc_id, text, lang, source, n_chars"


def mix_sql(documents: str = "documents", temperature: float = 0.5, seed: int = 17) -> str:
    """The same rows in SQL, for a table of distinct non-null ids and rates up to ``PIECE``."""
    u = lambda text: f"(('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)!r}::DOUBLE)"
    return f"""
WITH counted AS (SELECT coalesce('v' || source, 'n') AS source_key, count(*) AS n_docs FROM {documents} GROUP BY 1),
weighted AS (SELECT *, pow(n_docs::DOUBLE, {temperature}) AS w FROM counted),
rates AS (SELECT source_key, sum(n_docs) OVER () * w / sum(w) OVER () / n_docs AS rate FROM weighted),
pmf AS (SELECT source_key, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM rates, range(0, 120) AS r(k)),
cdf AS (SELECT source_key, rate, k, sum(p) OVER (PARTITION BY source_key ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf),
drawn AS (SELECT d.*, coalesce('v' || d.source, 'n') AS source_key, {u(f"'{seed}|' || d.doc_id::VARCHAR || '|1'")} AS u FROM {documents} d),
counts AS (SELECT d.doc_id, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.c <= d.u) AS n FROM drawn d JOIN cdf c USING (source_key) GROUP BY d.doc_id)
SELECT {', '.join('d.' + c.strip() for c in MIX_COLUMNS.split(','))}, i.copy::INT AS copy, {u(f"'{seed}|place|' || d.doc_id::VARCHAR || '|' || i.copy::VARCHAR")} AS shuffle_key
FROM {documents} d JOIN counts USING (doc_id), range(1, counts.n + 1) AS i(copy)
"""

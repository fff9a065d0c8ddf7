"""Gaussian mixtures of one coordinate, fitted to all groups at once, and the periods read from them.

Values are summed up by group and value. A round of expectation and
maximisation is one aggregate over them that gives the sums of every
component; only these, one row for each fit, go from round to round. A fit
that has converged leaves the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored

#: Fixed values of the model: smallest variance that is added, least weight of a dominant component, points of the grid of the main peak.
FLOOR, DOMINANT, GRID = 1e-6, 0.05, 4096
#: Values that count.
COUNTED = "grp is not null and z is not null and not isnan(z) and abs(z) < double('infinity')"


def _start(values: DataFrame, counts: list[int]) -> DataFrame:
    """A fit of each group and number of components: means at equally spaced quantiles, the group's spread, equal weights."""
    most = max(counts)
    q = lambda k: [(2 * j + 1) / (2 * k) for j in range(k)]
    every = sorted({p for k in counts for p in q(k)})
    one = values.groupBy("grp").agg(F.sum("n").alias("n"), F.percentile("z", F.array(*map(F.lit, every)), F.col("n")).alias("q"), (F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("mean"), F.count("*").alias("distinct"))
    spread = values.join(one.select("grp", "mean"), "grp").groupBy("grp").agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("mean"), 2) * F.col("n")) / F.sum("n") + FLOOR).alias("sd"))
    rows = one.join(spread, "grp").select("grp", "n", "q", "sd", F.explode(F.array(*map(F.lit, counts))).alias("k")).where("k <= n")
    picked = lambda k, j: F.element_at("q", every.index(q(k)[j]) + 1) if j < k else F.lit(0.0)
    pick = lambda j: F.coalesce(*(F.when(F.col("k") == k, picked(k, j)) for k in counts))
    return rows.select("grp", "k", "n", *(x for j in range(most) for x in (F.when(F.lit(j) < F.col("k"), 1 / F.col("k")).otherwise(0.0).alias(f"w{j}"), pick(j).alias(f"m{j}"), F.when(F.lit(j) < F.col("k"), F.col("sd")).otherwise(1.0).alias(f"s{j}"))))


def _log_density(j: int, z: Column) -> Column:
    """Log of weight times density of a component, less the constant; null for one without weight."""
    u = (z - F.col(f"m{j}")) / F.col(f"s{j}")
    return F.when(F.col(f"w{j}") > 0, F.log(f"w{j}") - F.log(f"s{j}") - 0.5 * u * u)


def _round(values: DataFrame, fits: DataFrame, most: int) -> DataFrame:
    """One round: the new fits with ``loglik``, the log-likelihood of the ones before, and ``last``, theirs."""
    rows = values.join(fits.drop("n").withColumnRenamed("loglik", "last"), "grp")
    logs = rows.select("grp", "k", "z", F.col("n").alias("c"), "last", *(_log_density(j, F.col("z")).alias(f"l{j}") for j in range(most)), *(F.col(f"m{j}").alias(f"o{j}") for j in range(most)))
    logs = logs.withColumn("top", F.greatest(*(f"l{j}" for j in range(most))) if most > 1 else F.col("l0"))
    terms = logs.select("*", *(F.coalesce(F.exp(F.col(f"l{j}") - F.col("top")), F.lit(0.0)).alias(f"e{j}") for j in range(most)))
    terms = terms.withColumn("whole", sum((F.col(f"e{j}") for j in range(1, most)), F.col("e0")))
    share = lambda j: F.col("c") * F.col(f"e{j}") / F.col("whole")
    away = lambda j: F.col("z") - F.col(f"o{j}")  # noqa: E731  about the old mean, which loses no digits
    sums = [x for j in range(most) for x in (F.sum(share(j)).alias(f"r{j}"), F.sum(share(j) * away(j)).alias(f"x{j}"), F.sum(share(j) * away(j) * away(j)).alias(f"xx{j}"), F.first(f"o{j}").alias(f"o{j}"))]
    got = terms.groupBy("grp", "k").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("top") + F.log("whole") - 0.9189385332046727)).alias("loglik"), F.first("last").alias("last"), *sums)
    new = []
    for j in range(most):
        r, shift = F.col(f"r{j}"), F.col(f"x{j}") / F.col(f"r{j}")
        alive = r > 1e-10
        new += [F.when(alive, r / F.col("n")).otherwise(0.0).alias(f"w{j}"), F.when(alive, F.col(f"o{j}") + shift).otherwise(F.col(f"o{j}")).alias(f"m{j}"), F.when(alive, F.sqrt(F.greatest(F.col(f"xx{j}") / r - shift * shift, F.lit(0.0)) + FLOOR)).otherwise(1.0).alias(f"s{j}")]
    return got.select("grp", "k", "n", "loglik", "last", *new)


def fit(values: DataFrame, counts: list[int], tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """(grp, k, n, loglik, bic, rounds, converged, w0, m0, s0, w1, ...), stored, of ``values(grp, z)`` for each number of components in ``counts``.

    Starts are deterministic. A fit ends when its mean log-likelihood rises by
    less than ``tolerance`` in a round, or after ``rounds``. Null groups and
    values that are null or not finite don't count; a group with fewer values
    than components has no such fit. Fits of a group are one row each, so a
    group of any size is summed up within its tasks.
    """
    most = max(counts)
    summed = stored(values.where(COUNTED).groupBy("grp", "z").agg(F.count("*").alias("n")), "mixture-values")
    columns = ["grp", "k", "n", "loglik", *(f"{c}{j}" for j in range(most) for c in "wms")]
    open_fits = _start(summed, counts).withColumn("loglik", F.lit(None).cast("double")).select(*columns)
    ended, tables = None, [stored(open_fits, "mixture-fits")]
    open_fits = tables[0]
    for done in range(1, rounds + 1):
        now = _round(summed, open_fits, most)
        # The likelihood is that of the fit before, so its rise is one round old.
        converged = F.coalesce((F.col("loglik") - F.col("last")) / F.col("n") < tolerance, F.lit(False))
        tables.append(stored(now.select(*columns, converged.alias("converged"), F.lit(done).alias("rounds")), "mixture-fits"))
        over = F.col("converged") | F.lit(done == rounds)
        found = tables[-1].where(over)
        ended = found if ended is None else ended.unionByName(found)
        open_fits = tables[-1].where(~over).select(*columns)
        if not open_fits.limit(1).count():
            break
    ended = stored(ended, "mixture-fits")
    last = _round(summed, ended.select(*columns), most).select("grp", "k", F.col("loglik").alias("final"))
    final = ended.join(last, ["grp", "k"]).withColumn("loglik", F.col("final")).withColumn("bic", -2 * F.col("final") + (3 * F.col("k") - 1) * F.log("n"))
    out = stored(final.select(*columns[:4], "bic", "rounds", "converged", *columns[4:]), "mixtures")
    discard(summed, ended, *tables)
    return out


def best_by_bic(fits: DataFrame) -> DataFrame:
    """The fit of each group with the lowest BIC; of equal ones that of fewer components."""
    best = fits.groupBy("grp").agg(F.min(F.struct("bic", "k")).alias("best")).select("grp", "best.k")
    return fits.join(best, ["grp", "k"])


def parts_of(fits: DataFrame, least: float = DOMINANT) -> DataFrame:
    """(grp, part, weight, mean, sd): the components of a fit of each group that weigh more than ``least``, by mean; the heaviest where none does."""
    most = sum(c[0] == "w" and c[1:].isdigit() for c in fits.columns)
    rows = fits.select("grp", F.explode(F.array(*(F.struct(F.col(f"w{j}").alias("weight"), F.col(f"m{j}").alias("mean"), F.col(f"s{j}").alias("sd")) for j in range(most)))).alias("p")).select("grp", "p.*").where("weight > 0")
    rows = rows.join(rows.groupBy("grp").agg(F.max("weight").alias("top")), "grp").where((F.col("weight") > least) | ((F.col("top") <= least) & (F.col("weight") == F.col("top"))))
    return rows.selectExpr("grp", "cast(row_number() over (partition by grp order by mean, sd) as int) as part", "weight", "mean", "sd")


def periods(parts: DataFrame) -> DataFrame:
    """(grp, n_parts, mean_step, se_step): distances of neighbouring components; the error from two steps on, both null where there are fewer."""
    steps = parts.selectExpr("grp", "mean - lag(mean) over (partition by grp order by part) as step")
    return steps.groupBy("grp").agg(F.count("*").alias("n_parts"), F.avg("step").alias("mean_step"), (F.stddev_samp("step") / F.sqrt(F.count("step"))).alias("se_step"))


def density(fits: DataFrame, at: DataFrame) -> DataFrame:
    """(grp, z, density) of the whole mixture of each group at ``at(grp, z)``."""
    most = sum(c[0] == "w" and c[1:].isdigit() for c in fits.columns)
    total = sum((F.coalesce(F.exp(_log_density(j, F.col("z"))), F.lit(0.0)) for j in range(most)), F.lit(0.0))
    return at.join(fits.drop("n"), "grp").select("grp", "z", (total * 0.3989422804014327).alias("density"))


def main_peaks(fits: DataFrame, values: DataFrame, parts: DataFrame) -> DataFrame:
    """(grp, by_density, by_weight): where the mixture is densest on GRID points between the least and the largest value, and the mean of the heaviest component."""
    ends = values.where(COUNTED).groupBy("grp").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    grid = ends.select("grp", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i")).select("grp", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (GRID - 1)).alias("z"))
    dense = density(fits, grid).groupBy("grp").agg(F.min(F.struct((-F.col("density")).alias("d"), "z")).alias("best")).select("grp", F.col("best.z").alias("by_density"))
    heavy = parts.groupBy("grp").agg(F.min(F.struct((-F.col("weight")).alias("w"), "mean")).alias("best")).select("grp", F.col("best.mean").alias("by_weight"))
    return dense.join(heavy, "grp")


def valleys(fits: DataFrame, parts: DataFrame, points: int = 512) -> DataFrame:
    """(grp, part, z, density, depth): the lowest place of the mixture between each component and the next, and its share of the lower of the two means' densities."""
    pairs = parts.selectExpr("grp", "part", "mean as lo", "lead(mean) over (partition by grp order by part) as hi").where("hi is not null")
    grid = pairs.select("grp", "part", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")).withColumn("z", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / points)
    dense = density(fits, grid.select("grp", "z").distinct())
    rows = grid.join(dense, ["grp", "z"])
    found = rows.groupBy("grp", "part").agg(F.min(F.struct("density", "z")).alias("low"), F.least(F.max(F.when(F.col("i") == 0, F.col("density"))), F.max(F.when(F.col("i") == points, F.col("density")))).alias("side"))
    return found.select("grp", "part", F.col("low.z").alias("z"), F.col("low.density").alias("density"), (F.col("low.density") / F.col("side")).alias("depth"))

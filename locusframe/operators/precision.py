"""Localization precision from distances between next-frame neighbours (NeNA).

The distances of each group are summed up in a histogram of fixed length; the
likelihood of its bins is all that the fit needs, so a group of any size is
BINS rows when it gets there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paint import next_frame

#: Bins of the histogram, fewest pairs of a fit, and fixed values of the model: least share of the same molecule, least width of the nearby term in
#: precisions, 95 % point of chi-squared with one degree of freedom.
BINS, LEAST_PAIRS = 480, 100
LEAST_SHARE, LEAST_WIDTH, CHI2 = 0.05, math.sqrt(2.0), 3.841458820694124
_erf = np.frompyfunc(math.erf, 1, 1)


def distance_histogram(distances: DataFrame, reach: float) -> DataFrame:
    """(grp, bin, n) of ``distances(grp, d)`` below ``reach`` in BINS bins of equal width; empty bins have no row."""
    used = distances.where((F.col("d") >= 0) & (F.col("d") < reach))
    return used.groupBy("grp", F.least(F.floor(F.col("d") * (BINS / reach)), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def same_mass(edges: np.ndarray, s: float) -> np.ndarray:
    """Probabilities of the bins for two sightings of a molecule, each off by s on an axis, given that they are within the last edge."""
    below = -np.expm1(-(edges**2) / (4 * s * s))
    return np.diff(below) / max(below[-1], 1e-300)


def nearby_mass(edges: np.ndarray, centre: float, width: float) -> np.ndarray:
    """Probabilities of the bins for a normal law cut off at 0 and at the last edge."""
    below = _erf((edges - centre) / (width * math.sqrt(2.0))).astype(float)
    return np.diff(below) / max(below[-1] - below[0], 1e-300)


def _shares(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bin probabilities of parameters without bounds: log s, logit of the share, log of the centre, log of the width's excess."""
    s, centre = math.exp(v[0]), math.exp(v[2])
    share = LEAST_SHARE + (1 - LEAST_SHARE) / (1 + math.exp(-v[1]))
    return share * same_mass(edges, s) + (1 - share) * nearby_mass(edges, centre, s * LEAST_WIDTH + math.exp(v[3]))


def _scored(edges: np.ndarray, n: np.ndarray, v: np.ndarray, free: list[int], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, parameters and Fisher information at the end of damped scoring steps from ``v``."""
    low, high = np.array([math.log(edges[-1] * 1e-3), -12, math.log(edges[-1] * 1e-3), math.log(edges[-1] * 1e-4)]), np.array([math.log(edges[-1] / 2), 12, math.log(3 * edges[-1]), math.log(3 * edges[-1])])
    loss = lambda x: -float((n * np.log(np.maximum(_shares(edges, x), 1e-300))).sum())
    v = np.clip(v, low, high)
    now, damp, info = loss(v), 1e-3, np.eye(len(free))
    for _ in range(rounds):
        p = np.maximum(_shares(edges, v), 1e-300)
        slope = np.stack([(_shares(edges, v + e) - _shares(edges, v - e)) / 2e-5 for k in free for e in [np.eye(4)[k] * 1e-5]], axis=1)
        info = n.sum() * (slope / p[:, None]).T @ slope
        push = (n / p) @ slope
        moved = False
        while damp < 1e8:
            step = v.copy()
            step[free] += np.linalg.solve(info + damp * np.diag(np.diag(info) + 1e-9), push)
            step = np.clip(step, low, high)
            then = loss(step)
            if then < now:
                moved = now - then > 1e-10 * abs(now)
                v, now, damp = step, then, max(damp / 5, 1e-9)
                break
            damp *= 4
        if not moved:
            break
    return now, v, info


def fitted(n: np.ndarray, reach: float) -> dict[str, float]:
    """Precision by maximum likelihood on one histogram, with the nearby term where BIC wants it."""
    edges, total = np.linspace(0, reach, len(n) + 1), n.sum()
    middle = edges[1 + int(np.searchsorted(np.cumsum(n), total / 2))] / 1.665
    starts = [np.log([a * middle, 1.0, c, w]) for a in (0.6, 1.0, 1.4) for c, w in ((3 * a * middle, 0.5 * a * middle), (reach / 2, reach / 4), (reach, reach / 3))]
    for v in starts:
        v[1] = 1.5
    first = [-(n * np.log(np.maximum(_shares(edges, v), 1e-300))).sum() for v in starts]
    best = min((_scored(edges, n, starts[i], [0, 1, 2, 3]) for i in np.argsort(first)[:4]), key=lambda x: x[0])
    alone = lambda s: -float((n * np.log(np.maximum(same_mass(edges, s), 1e-300))).sum())
    a, b = reach * 1e-3, reach / 2
    for _ in range(80):  # golden section
        x, y = b - (b - a) * 0.618033988749895, a + (b - a) * 0.618033988749895
        a, b = (a, y) if alone(x) < alone(y) else (x, b)
    single = (a + b) / 2
    nearby = 2 * (alone(single) - best[0]) > 3 * math.log(total)
    if nearby:
        s, share = math.exp(best[1][0]), LEAST_SHARE + (1 - LEAST_SHARE) / (1 + math.exp(-best[1][1]))
        error = math.sqrt(max(np.linalg.pinv(best[2])[0, 0], 0.0)) * s
    else:
        h = single * 1e-3
        curve = (alone(single + h) - 2 * alone(single) + alone(single - h)) / (h * h)
        s, share, error = single, 1.0, 1 / math.sqrt(curve) if curve > 0 else math.nan
    half = math.sqrt(CHI2) * error
    return {"precision": s, "low": s - half, "high": s + half, "share": share, "nearby": bool(nearby), "peak": bool(s < 0.99 * reach / 2)}


def nena(histogram: DataFrame, reach: float) -> DataFrame:
    """(grp, n_pairs, precision, low, high, share, nearby, peak) of ``histogram(grp, bin, n)``.

    ``share`` is that of pairs of one molecule, ``nearby`` says whether other
    molecules close by are modelled, ``low`` and ``high`` are 95 % bounds, and
    without a ``peak`` the fit has run to its limit. Groups of fewer than
    LEAST_PAIRS pairs have nulls.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BINS)
        n[part["bin"].to_numpy()] = part["n"].to_numpy()
        found = fitted(n, reach) if n.sum() >= LEAST_PAIRS else dict.fromkeys(("precision", "low", "high", "share", "nearby", "peak"))
        return pd.DataFrame({"grp": part["grp"].iloc[:1], "n_pairs": [int(n.sum())], **{k: [v] for k, v in found.items()}})

    kind = histogram.schema["grp"].dataType.simpleString()
    return histogram.groupBy("grp").applyInPandas(one, f"grp {kind}, n_pairs long, precision double, low double, high double, share double, nearby boolean, peak boolean")


def next_frame_distances(locs: DataFrame, reach: float) -> DataFrame:
    """(grp, d) of localizations ``locs(id, grp, frame, x, y)``: to the nearest one of the next frame, if that is within ``reach``; ids tell rows of a group apart."""
    near = next_frame(locs.withColumn("id", F.struct("grp", "id")), reach)
    return near.select(F.col("id.grp").alias("grp"), F.col("d1").alias("d"))


def movie_precision(locs: DataFrame, reach: float) -> DataFrame:
    """``nena`` of the next-frame distances of each group of ``locs(id, grp, frame, x, y)``."""
    return nena(distance_histogram(next_frame_distances(locs, reach), reach), reach)

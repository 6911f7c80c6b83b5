"""Umbrella samples to a profile by weighted histograms: counts are one aggregation, the equations small and in logarithms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import R, bin_index
from terrane.operators import reweight, timeseries


def inefficiencies(samples: DataFrame, window: str, time: str, x: str, windows: int) -> list[float]:
    """Statistical inefficiency of each window's series, 1 where there is none."""
    found = {r[window]: r["g"] for r in timeseries.effective_samples(samples, window, [time], x).select(window, "g").collect()}  # one row a window
    return [max(1.0, float(found.get(k) or 1.0)) for k in range(windows)]


def wham(samples: DataFrame, x: str, window: str, centers: list[float], kappas: list[float], bins: int = 100, temperature: float = 300.0, period: float | None = None, bounds: tuple[float, float] | None = None, inefficiency: list[float] | None = None, tolerance: float = 1e-8, most: int = 100_000) -> tuple[DataFrame, list[float]]:
    """((bin, x, count, probability, free_energy), free energies of the windows in units of kT): samples (window from 0, x) binned over `bounds` or their range.

    `inefficiency`, a number for each window, lets correlated samples count for less.
    """
    kt = R * temperature
    if bounds is None:
        lo, hi = samples.agg(F.min(x), F.max(x)).first()
        if lo is None:
            raise ValueError("no samples")
        bounds = (float(lo), float(hi)) if hi > lo else (float(lo) - 0.5, float(hi) + 0.5)
    lo, hi = bounds
    placed = samples.select(F.col(window).alias("w"), bin_index(F.col(x).cast("double"), F.lit(lo), F.lit(hi), bins).alias("bin")).where("bin is not null")
    counts = np.zeros((len(centers), bins))
    for r in placed.groupBy("w", "bin").agg(F.count("*").alias("n")).collect():  # at most windows x bins
        counts[r["w"], r["bin"]] = r["n"]
    at = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
    d = at[None] - np.array(centers)[:, None]
    if period:
        d -= period * np.rint(d / period)
    p, f = reweight.wham(counts, counts.sum(1), 0.5 * np.array(kappas)[:, None] * d * d / kt, tolerance, most, None if inefficiency is None else np.array(inefficiency))
    with np.errstate(divide="ignore"):
        g = -kt * np.log(p / p.max())
    rows = [(k, float(at[k]), int(counts[:, k].sum()), float(p[k]), float(g[k]) if p[k] > 0 else None) for k in range(bins)]
    return samples.sparkSession.createDataFrame(rows, "bin int, x double, count long, probability double, free_energy double"), [float(v) for v in f]

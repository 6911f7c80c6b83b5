"""Comparison of systems on a shared grid: populations, energies, overlaps and tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import R


def difference_map(grid: DataFrame, system: str, reference: str) -> DataFrame:
    """(system, ix, iy, g_ref, g_sys, ddg) for cells that either sampled; null unless both did."""
    ref = grid.where(F.col(system) == reference).select("ix", "iy", F.col("free_energy").alias("g_ref"))
    rest = grid.where(F.col(system) != reference)
    cells = rest.select(system).distinct().crossJoin(F.broadcast(ref))
    out = cells.join(rest.select(system, "ix", "iy", F.col("free_energy").alias("g_sys")), [system, "ix", "iy"], "full")
    return out.withColumn("ddg", F.col("g_sys") - F.col("g_ref"))


def overlaps(grid: DataFrame, system: str, temperature: float = 300.0) -> DataFrame:
    """(a, b, bhattacharyya, hellinger, js_bits, jaccard) of every two systems, from probabilities renormalised from free energies."""
    p = grid.where("free_energy is not null").select(system, "ix", "iy", F.exp(-F.col("free_energy") / (R * temperature)).alias("e"))
    p = p.select(system, "ix", "iy", (F.col("e") / F.sum("e").over(Window.partitionBy(system))).alias("p"))
    names = p.select(system).distinct()
    pairs = names.select(F.col(system).alias("a")).crossJoin(F.broadcast(names.select(F.col(system).alias("b")))).where("a < b")
    left = F.broadcast(pairs).join(p.withColumnRenamed(system, "a"), "a").withColumnRenamed("p", "p")
    right = F.broadcast(pairs).join(p.withColumnRenamed(system, "b").withColumnRenamed("p", "q"), "b")
    cells = left.join(right, ["a", "b", "ix", "iy"], "full").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2

    def half(x: Column) -> Column:
        return F.sum(F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)) / 2

    out = cells.groupBy("a", "b").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("bc"), (half(F.col("p")) + half(F.col("q"))).alias("js_bits"), (F.count(F.when((F.col("p") > 0) & (F.col("q") > 0), 1)) / F.count("*")).alias("jaccard"))
    return out.select("a", "b", F.col("bc").alias("bhattacharyya"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("bc"))).alias("hellinger"), "js_bits", "jaccard")


def population_table(df: DataFrame, system: str, replicate: str, state: str) -> DataFrame:
    """(system, state, population, replicate_mean, replicate_sd, n_replicates); a replicate without the state counts with 0."""
    n = df.groupBy(system, replicate).agg(F.count("*").alias("total"))
    hits = df.groupBy(system, replicate, state).agg(F.count("*").alias("k"))
    full = n.join(df.select(system, state).distinct(), system).join(hits, [system, replicate, state], "left").fillna(0, ["k"])
    share = 100 * F.col("k") / F.col("total")
    return full.groupBy(system, state).agg((100 * F.sum("k") / F.sum("total")).alias("population"), F.avg(share).alias("replicate_mean"), F.stddev_samp(share).alias("replicate_sd"), F.count("*").alias("n_replicates"))


def against(table: DataFrame, system: str, state: str, reference: str) -> DataFrame:
    """Differences from the reference system, with Welch's statistic and degrees of freedom where both have two replicates or more."""
    ref = table.where(F.col(system) == reference).select(state, *(F.col(c).alias(f"r_{c}") for c in ("population", "replicate_mean", "replicate_sd", "n_replicates")))
    out = table.where(F.col(system) != reference).join(F.broadcast(ref), state)
    va, vb = (F.pow(F.col(f"{p}replicate_sd"), 2) / F.col(f"{p}n_replicates") for p in ("", "r_"))
    enough = (F.col("n_replicates") >= 2) & (F.col("r_n_replicates") >= 2) & (va + vb > 0)
    t = F.when(enough, (F.col("replicate_mean") - F.col("r_replicate_mean")) / F.sqrt(va + vb))
    dof = F.when(enough, F.pow(va + vb, 2) / (va * va / (F.col("n_replicates") - 1) + vb * vb / (F.col("r_n_replicates") - 1)))
    return out.select(system, state, (F.col("population") - F.col("r_population")).alias("difference"), t.alias("welch_t"), dof.alias("welch_dof"))


def pairs_of(df: DataFrame, system: str) -> DataFrame:
    names = df.select(system).distinct()
    return names.select(F.col(system).alias("a")).crossJoin(F.broadcast(names.select(F.col(system).alias("b")))).where("a < b")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_cdf(t: float, dof: float) -> float:
    half = incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) / 2
    return 1 - half if t > 0 else half


def t_quantile(p: float, dof: float) -> float:
    lo, hi = -1.0, 1.0
    while t_cdf(lo, dof) > p:
        lo *= 2
    while t_cdf(hi, dof) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def replicate_intervals(stats: DataFrame, mean: str, sem: str, n: str) -> DataFrame:
    """95 % intervals by Student's t clipped to [0, 100]; the quantile of each count of replicates is computed where it stands, and one replicate has none."""

    @F.pandas_udf("double")
    def quantile(counts):
        known = {k: t_quantile(0.975, k - 1) for k in counts.dropna().unique() if k > 1}
        return counts.map(known).astype(float)

    q = F.nanvl(quantile(F.col(n).cast("double")), F.lit(None).cast("double"))
    return stats.withColumn("_q", q).withColumn("ci_low", F.greatest(F.lit(0.0), F.col(mean) - F.col("_q") * F.col(sem))).withColumn("ci_high", F.least(F.lit(100.0), F.col(mean) + F.col("_q") * F.col(sem))).withColumn("ci_low", F.when(F.col("_q").isNotNull() & F.col(sem).isNotNull(), F.col("ci_low"))).withColumn("ci_high", F.when(F.col("_q").isNotNull() & F.col(sem).isNotNull(), F.col("ci_high"))).drop("_q")


def differences_by_bootstrap(samples: DataFrame, system: str, state: str, reference: str) -> DataFrame:
    """(system, state, lo, hi, p) of population differences from the reference, from resamples (system, b, state, population): 95 % interval and two-sided p, one over the resamples at least."""
    ref = samples.where(F.col(system) == reference).select("b", state, F.col("population").alias("_r"))
    d = samples.where(F.col(system) != reference).join(ref, ["b", state]).withColumn("_d", F.col("population") - F.col("_r"))
    below, above, n = F.count(F.when(F.col("_d") <= 0, 1)), F.count(F.when(F.col("_d") >= 0, 1)), F.count("*")
    p = F.least(F.lit(1.0), F.greatest(2 * F.least(below, above) / n, 1 / n))
    return d.groupBy(system, state).agg(F.percentile("_d", F.lit(0.025)).alias("lo"), F.percentile("_d", F.lit(0.975)).alias("hi"), p.alias("p"))


def hellinger(p: np.ndarray, q: np.ndarray) -> float:
    return math.sqrt(max(0.0, 1 - float(np.sqrt(p * q).sum())))

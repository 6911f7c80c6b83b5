"""Reweighting of biased samples: deposited hills, time-dependent constants, histogram and multistate reweighting."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import R, wrapped

CUTOFF = 6.25


def hill_kernel(dp2: np.ndarray, stretched: bool = True) -> np.ndarray:
    """A Gaussian in half squared distances, stretched so that it reaches zero at the cut-off."""
    if not stretched:
        return np.exp(-dp2)
    a = 1 / (1 - math.exp(-CUTOFF))
    return np.where(dp2 < CUTOFF, a * np.exp(-dp2) + 1 - a, 0.0)


def bias(points: np.ndarray, times: np.ndarray | None, centers: np.ndarray, sigmas: np.ndarray, heights: np.ndarray, hill_times: np.ndarray, periods: list[float | None] | None = None, stretched: bool = True) -> np.ndarray:
    """Bias at each point from the hills strictly before its time (all of them without times), in slices of hills."""
    out = np.zeros(len(points))
    for s in range(0, len(heights), 2000):
        d = points[:, None, :] - centers[None, s : s + 2000]
        for k, p in enumerate(periods or []):
            if p:
                d[..., k] -= p * np.round(d[..., k] / p)
        v = heights[s : s + 2000] * hill_kernel(0.5 * ((d / sigmas[s : s + 2000]) ** 2).sum(2), stretched)
        out += v.sum(1) if times is None else np.where(hill_times[None, s : s + 2000] < times[:, None], v, 0).sum(1)
    return out


#: Hills (some 40 bytes each) that go with every task; one variable's bias from more of them is `bias_by_join`.
MOST_HILLS = 2_000_000


def in_time(hills: dict) -> dict:
    """Hills by time, since restarts and several walkers write them in any order."""
    order = np.argsort(hills["times"], kind="stable")
    return hills | {k: np.asarray(hills[k])[order] for k in ("times", "centers", "sigmas", "heights")}


def with_bias(frames: DataFrame, columns: list[str], time: str | None, hills: dict, periods: list[float | None] | None = None, stretched: bool = True, constants: np.ndarray | None = None) -> DataFrame:
    """Frames with `bias`, less the constant of the last hill before the frame if `constants` has one for each hill; at most `MOST_HILLS` hills go with the tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    if len(hills["heights"]) > MOST_HILLS:
        raise ValueError(f"more than {MOST_HILLS} hills; use bias_by_join")
    schema = StructType([*frames.schema.fields, StructField("bias", DoubleType())])
    arrow, at = to_arrow_schema(schema), [frames.columns.index(c) for c in columns]
    t = frames.columns.index(time) if time else None
    since = None if constants is None else np.append(0.0, constants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                x = np.column_stack([np.asarray(part.column(i), float) for i in at])
                when = None if t is None else np.asarray(part.column(t), float)
                v = bias(x, when, hills["centers"], hills["sigmas"], hills["heights"], hills["times"], periods, stretched)
                if since is not None:
                    v = v - since[np.searchsorted(hills["times"], when, "left")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(v)], schema=arrow)

    return frames.mapInArrow(run, schema)


def untempered(height, factor):
    """Deposited height of a hill written in the rescaled form h * g / (g - 1)."""
    return F.when(factor > 1, height * (factor - 1) / factor).otherwise(height)


def bias_by_join(frames: DataFrame, hills: DataFrame, key: str, x: str | list[str], time: str | None, period: float | None | list[float | None] = None, centers: list[str] | None = None, sigmas: list[str] | None = None) -> DataFrame:
    """(key, bias) from a table of hills of any size; see `hills.bias`."""
    from terrane.operators.hills import bias as of_hills

    names = [x] if isinstance(x, str) else x
    return of_hills(frames, hills, key, names, time, period if isinstance(period, list) else [period] * len(names), centers, sigmas)


def log_weights(df: DataFrame, log_weight: str, kept: str | None = None) -> DataFrame:
    """`df` with `weight` = exp(lw - logsumexp) * n over kept rows, so the mean is one; 0 for others. The shift by the maximum keeps sums finite."""
    lw = F.when(F.col(kept), F.col(log_weight)) if kept else F.col(log_weight)
    top = df.agg(F.max(lw).alias("_top"))
    rows = df.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(lw - F.col("_top")))
    total = rows.agg(F.sum("_e").alias("_sum"), F.count("_e").alias("_n"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce(F.col("_e") / F.col("_sum") * F.col("_n"), F.lit(0.0))).drop("_top", "_e", "_sum", "_n")


def _lse(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def default_grid(centers: np.ndarray, sigmas: np.ndarray, points: int = 200, periods: list[tuple[float, float] | None] | None = None) -> list[np.ndarray]:
    """Points of each variable: four of the largest widths beyond the hills, or the period without its end."""
    out = []
    for k in range(centers.shape[1]):
        span = (periods or [None] * centers.shape[1])[k]
        pad = 4 * sigmas[:, k].max()
        out.append(np.linspace(*span, points, endpoint=False) if span else np.linspace(centers[:, k].min() - pad, centers[:, k].max() + pad, points))
    return out


def reweighting_constant(centers: np.ndarray, sigmas: np.ndarray, heights: np.ndarray, grid: np.ndarray, temperature: float, factor: float | None, stretched: bool = True, periods: list[float | None] | None = None) -> np.ndarray:
    """c(t) after each hill, in the order given, from the running bias at the points of a grid: for hills that fit the driver; `hills.constants` is for tables."""
    kt = R * temperature
    v, out = np.zeros(len(grid)), np.zeros(len(heights))
    for i in range(len(heights)):
        v += bias(grid, None, centers[i : i + 1], sigmas[i : i + 1], heights[i : i + 1], np.zeros(1), periods, stretched)
        out[i] = kt * (_lse(factor * v / kt / (factor - 1)) - _lse(v / kt / (factor - 1))) if factor and factor > 1 else kt * (_lse(v / kt) - math.log(len(grid)))
    return out


def metad_weights(frames: DataFrame, columns: list[str], time: str, hills: dict, temperature: float = 300.0, mode: str = "final", factor: float | None = None, skip: float = 0.0, stretched: bool = True) -> DataFrame:
    """Frames with weights of mean one over kept frames: by the final bias, or by the bias at each time less c(t). Periodic variables (`periods`, `spans` of the hills) wrap."""
    kt, hills, periods = R * temperature, in_time(hills), hills.get("periods")
    kept = frames.withColumn("_kept", F.col(time) >= skip)
    if mode == "final":
        v = with_bias(kept, columns, None, hills, periods, stretched)
    else:
        axes = default_grid(hills["centers"], hills["sigmas"], periods=hills.get("spans"))
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))
        c = reweighting_constant(hills["centers"], hills["sigmas"], hills["heights"], grid, temperature, factor, stretched, periods)
        v = with_bias(kept, columns, time, hills, periods, stretched, c)
    return log_weights(v.withColumn("_lw", F.col("bias") / kt), "_lw", "_kept").drop("_lw", "_kept")


def umbrella_energies(df: DataFrame, x: str, centers: list[float], kappas: list[float], kt: float, period: float | None = None) -> DataFrame:
    """`df` with `u`, the reduced bias of every window at every sample."""
    def one(c: float, k: float):
        d = F.col(x) - F.lit(c)
        d = wrapped(d, period) if period else d
        return F.lit(0.5 * k / kt) * d * d

    return df.withColumn("u", F.array(*(one(c, k) for c, k in zip(centers, kappas, strict=True))))


def wham(histogram: np.ndarray, totals: np.ndarray, reduced_bias: np.ndarray, tolerance: float = 1e-8, most: int = 100_000, inefficiency: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each bin and free energies of the windows, from counts[window, bin] or counts over bins, samples of each window and reduced bias[window, bin].

    In logarithms throughout, so that stiff windows far apart stay finite. A window whose samples are correlated counts its samples over its statistical
    `inefficiency`; for that, counts must be given by window. A bin without samples has probability 0; a warning tells if `most` rounds were not enough.
    """
    histogram, totals, u = np.asarray(histogram, float), np.asarray(totals, float), np.asarray(reduced_bias, float)
    if inefficiency is not None:
        g = np.maximum(1.0, np.asarray(inefficiency, float))
        if histogram.ndim < 2:
            raise ValueError("an inefficiency for each window needs counts by window")
        histogram, totals = histogram / g[:, None], totals / g
    counts = histogram.sum(0) if histogram.ndim == 2 else histogram
    with np.errstate(divide="ignore"):
        log_counts, log_totals = np.log(counts), np.log(totals)
    seen, own = counts > 0, totals > 0
    if not seen.any() or not own.any():
        raise ValueError("no samples")
    f = np.zeros(len(totals))
    for _ in range(most):
        log_p = log_counts[seen] - _lse((log_totals[own] + f[own])[:, None] - u[np.ix_(own, seen)], axis=0)
        new = -_lse(log_p[None, :] - u[:, seen], axis=1)
        new -= new[0]
        done = np.abs(new - f).max() < tolerance
        f = new
        if done:
            break
    else:
        warnings.warn(f"WHAM did not settle to {tolerance} in {most} rounds", stacklevel=2)
    p = np.zeros(len(counts))
    p[seen] = np.exp(log_p - _lse(log_p))
    return p, f


def mbar_step(energies: DataFrame, f: list[float], totals: list[int]) -> DataFrame:
    """One self-consistent step over all samples: (k, f) from an aggregation of K log-sum-exps, whose shift is fixed beforehand."""
    k = len(f)
    logs = F.array(*(F.lit(math.log(n) + x) if n else F.lit(float("-inf")) for n, x in zip(totals, f, strict=True)))
    terms = F.zip_with(logs, F.col("u"), lambda a, u: a - u)
    top = F.array_max(terms)
    lse = top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.exp(t - top)))
    rows = energies.select(lse.alias("d"), "u")
    return rows.agg(*(F.sum(F.exp(-F.col("u")[i] - F.col("d"))).alias(f"s{i}") for i in range(k))).selectExpr(f"stack({k}, {', '.join(f'{i}, -ln(s{i})' for i in range(k))}) as (k, f)")


def occupations(energies: DataFrame, f: list[float], totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows with samples: sums over all samples of each window's share of the sample, and of the products of every two shares; one pass."""
    own = [k for k, n in enumerate(totals) if n]
    terms = [F.lit(math.log(totals[k]) + f[k]) - F.col("u")[k] for k in own]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    rows = energies.select(F.array(*terms).alias("_t"), top.alias("_top")).select(F.transform("_t", lambda t: F.exp(t - F.col("_top"))).alias("_e"))
    rows = rows.select(F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda x, y: x + y)).alias("p"))
    m = len(own)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = rows.agg(*(F.sum(F.col("p")[i]) for i in range(m)), *(F.sum(F.col("p")[i] * F.col("p")[j]) for i, j in pairs)).first()
    products = np.zeros((m, m))
    for (i, j), x in zip(pairs, row[m:], strict=True):
        products[i, j] = products[j, i] = x
    return np.array(row[:m]), products


#: Windows up to which Newton's steps, whose sums grow with the square of their number, take over from self-consistent ones.
NEWTON_WINDOWS = 60


def mbar(energies: DataFrame, totals: list[int], steps: int = 200, tolerance: float = 1e-8, newton: bool = True) -> list[float]:
    """Free energies of the windows, the first one 0. Ten self-consistent steps, then Newton's on the windows with samples, each of which must bring
    the shares nearer to the samples of the windows, else a self-consistent one takes its place. Every step is one pass that returns K or K * K numbers."""

    def consistent(g: list[float]) -> list[float]:
        new = [r["f"] for r in mbar_step(energies, g, totals).orderBy("k").collect()]
        return [x - new[0] for x in new]

    f, own = [0.0] * len(totals), [k for k, n in enumerate(totals) if n]
    newton = newton and 1 < len(own) <= NEWTON_WINDOWS
    wanted, nearest = np.array([totals[k] for k in own], float), math.inf
    for step in range(steps):
        if newton and step >= 10:
            shares, products = occupations(energies, f, totals)
            off = float(np.abs(shares / wanted - 1).max())
            if off < tolerance:
                return consistent(f)
            move = np.zeros(len(own))
            move[1:] = np.linalg.lstsq((np.diag(shares) - products)[1:, 1:], (wanted - shares)[1:], rcond=None)[0]
            if off < nearest and np.isfinite(move).all():
                nearest = off
                f = list(f)
                for k, x in zip(own, move, strict=True):
                    f[k] += float(x)
                continue
        new = consistent(f)
        done = max(abs(a - b) for a, b in zip(new, f, strict=True)) < tolerance
        f = new
        if done:
            break
    return f


def unbiased_weights(energies: DataFrame, f: list[float], totals: list[int]) -> DataFrame:
    """Samples with weights that sum to one: exp(-logsumexp over windows of ln N + f - u)."""
    logs = F.array(*(F.lit(math.log(n) + x) if n else F.lit(float("-inf")) for n, x in zip(totals, f, strict=True)))
    terms = F.zip_with(logs, F.col("u"), lambda a, u: a - u)
    top = F.array_max(terms)
    lse = top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.exp(t - top)))
    out = log_weights(energies.withColumn("_lw", -lse), "_lw")
    n = out.agg(F.count("*").alias("_n"))
    return out.crossJoin(F.broadcast(n)).withColumn("weight", F.col("weight") / F.col("_n")).drop("_n", "_lw")

"""Bias of deposited hills in any number of variables, for tables of hills and of frames of any size. One variable is the work of `fields`, two are that of `planes`.

In three and more a hill ends at a cut-off, so with cells as wide as the farthest hill reaches a frame meets the hills of its own cell and of the cells
around it. A cell with many frames or hills is dealt in blocks of both, by hash, so that every pair of blocks is a task of its own; inside, frames and hills
are in order of time, and a slice of frames is worked against the hills that can count for it in one array expression.

The constant c(t) needs the bias of all hills so far on a grid: hills in order are cut in blocks, a block's bias on the grid is one
array, running sums of arrays give each block its start, and blocks then go through their hills side by side. A hill touches a box of the grid only.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import fields, planes
from terrane.operators.ranges import dealt
from terrane.operators.reweight import CUTOFF, hill_kernel

#: Frames and hills of a cell that meet in one task, at most about; hills of a block of `constants`.
FRAMES, HILLS, BLOCK = 8192, 8192, 4096
#: Points of a grid (8 bytes each) of which every block gets a copy.
MOST_POINTS = 5_000_000
_SLICE = 512


def _around(x: Column, reach: float, period: float | None, around: bool) -> Column:
    """Numbers of the cells of one variable, as texts: a point's own, or also those on both sides, which wrap in a periodic variable."""
    if period:
        n = max(1, int(period // reach))
        at = F.pmod(F.floor(x * (n / period)), F.lit(n))
        own = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(at + k, F.lit(n)))) if around else F.array(at)
    else:
        at = F.floor(x / reach)
        own = F.sequence(at - 1, at + 1) if around else F.array(at)
    return F.transform(own, lambda c: c.cast("string"))


def _crossed(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws(",", x, y))))


def _cells(values: list[Column], reach: list[float], periods: list[float | None], around: bool) -> Column:
    """The cell of a point as text, or the cells around it as an array of texts."""
    out = reduce(_crossed, (_around(x, r, p, around) for x, r, p in zip(values, reach, periods, strict=True)))
    return out if around else out[0]


def bias(frames: DataFrame, hills: DataFrame, key: str, x: list[str], time: str | None, periods: list[float | None] | None = None, centers: list[str] | None = None, sigmas: list[str] | None = None) -> DataFrame:
    """(key, bias) of every frame from the hills strictly before its time (from all without one).

    Frames have a unique `key`, a number for each variable in `x`, and `time`; hills have `centers`, `sigmas`, height and hill_time. A frame or hill with
    a null among them takes no part: such a frame's bias is 0.
    """
    d = len(x)
    centers, sigmas, periods = centers or ["center"], sigmas or ["sigma"], periods or [None] * d
    if d == 1:
        return fields.bias(frames, hills, key, x[0], time, periods[0], centers[0], sigmas[0])
    if d == 2:
        return planes.bias(frames, hills, key, x, time, periods, centers, sigmas)
    limit = math.sqrt(2 * CUTOFF)
    widest = hills.agg(*(F.max(F.col(s).cast("double")) for s in sigmas)).first()
    reach = [limit * (w or 1.0) for w in widest]
    numbers = lambda names: [F.col(c).cast("double") for c in names]
    when = F.col(time).cast("double") if time else F.lit(0.0)
    at = F.col("hill_time").cast("double") if time else F.lit(-1.0)
    here = frames.select(F.col(key).alias("k"), F.array(*numbers(x)).alias("p"), when.alias("t"), F.explode(_cells(numbers(x), reach, periods, True)).alias("cell")).where(F.col("t").isNotNull())
    there = hills.select(F.array(*numbers(centers)).alias("c"), F.array(*numbers(sigmas)).alias("s"), F.col("height").cast("double").alias("h"), at.alias("t"), _cells(numbers(centers), reach, periods, False).alias("cell"))
    there = there.where("cell is not null and t is not null and h is not null")
    sizes = here.groupBy("cell").agg(F.count("*").alias("n")).join(there.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("n") / FRAMES).cast("int").alias("fb"), F.ceil(F.col("m") / HILLS).cast("int").alias("hb"))
    share = lambda n: F.pmod(F.xxhash64(*n[0]), n[1]).cast("int")
    here = here.join(sizes, "cell").withColumn("i", share((["k"], F.col("fb")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
    there = there.join(sizes, "cell").withColumn("j", share((["c", "t", "h"], F.col("hb")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fb") - 1)))
    wraps = [(k, p) for k, p in enumerate(periods) if p]

    def run(rows: pa.Table, hill: pa.Table) -> pa.Table:
        n, m = rows.num_rows, hill.num_rows
        flat = lambda t, c, k: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(k, -1)
        p, t = flat(rows, "p", n), rows.column("t").to_numpy()
        c, s, h, ht = flat(hill, "c", m), flat(hill, "s", m), hill.column("h").to_numpy(), hill.column("t").to_numpy()
        order, late = np.argsort(ht, kind="stable"), np.argsort(t, kind="stable")
        c, s, h, ht, p, t = c[order], s[order], h[order], ht[order], p[late], t[late]
        v = np.zeros(n)
        counted = np.searchsorted(ht, t, "left")
        for a in range(0, n, _SLICE):
            z = min(n, a + _SLICE)
            most, sure = int(counted[z - 1]), int(counted[a])
            if not most:
                continue
            half = np.zeros((z - a, most))
            for k in range(d):
                delta = p[a:z, None, k] - c[None, :most, k]
                for i, period in wraps:
                    if i == k:
                        delta -= period * np.rint(delta / period)
                delta /= s[None, :most, k]
                half += 0.5 * delta * delta
            near = half < CUTOFF
            worth = np.zeros_like(half)
            worth[near] = np.exp(-half[near])
            scale = 1 / (1 - math.exp(-CUTOFF))
            worth = np.where(near, scale * worth + (1 - scale), 0.0)
            if sure < most:
                worth[:, sure:][np.arange(sure, most)[None, :] >= counted[a:z, None]] = 0.0
            v[a:z] = worth @ h[:most]
        out = np.empty(n)
        out[late] = v
        return pa.table({"k": rows.column("k"), "v": out})

    kind = dict(frames.dtypes)[key]
    here, there = dealt(here.select("cell", "i", "j", "k", "p", "t"), "cell", "i", "j"), dealt(there.select("cell", "i", "j", "c", "s", "h", "t"), "cell", "i", "j")
    sums = here.groupBy("cell", "i", "j").cogroup(there.groupBy("cell", "i", "j")).applyInArrow(run, f"k {kind}, v double")
    sums = sums.groupBy("k").agg(F.sum("v").alias("bias")).withColumnRenamed("k", key)
    return frames.select(key).join(sums, key, "left").fillna(0.0, ["bias"])


class Grid:
    """A product grid on which a hill adds to the box of points within its reach."""

    def __init__(self, axes: list[np.ndarray], periods: list[float | None] | None = None):
        self.axes, self.periods = [np.asarray(a, float) for a in axes], periods or [None] * len(axes)
        self.shape = tuple(map(len, self.axes))

    def box(self, center: np.ndarray, sigma: np.ndarray, height: float, stretched: bool = True) -> tuple[tuple, np.ndarray]:
        """(index of the box, what the hill adds there)."""
        index, halves = [], []
        for axis, period, c, s in zip(self.axes, self.periods, center, sigma, strict=True):
            delta = axis - c
            if period:
                delta = delta - period * np.rint(delta / period)
            half = 0.5 * (delta / s) ** 2
            near = np.flatnonzero(half < CUTOFF) if stretched else np.arange(len(axis))
            index.append(near)
            halves.append(half[near])
        total = halves[0]
        for more in halves[1:]:
            total = total[..., None] + more
        return np.ix_(*index), height * hill_kernel(total, stretched)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(rows["c"]), np.stack(rows["s"]), rows["h"].to_numpy(float)


def constants(hills: DataFrame, order: str, axes: list[np.ndarray], kt: float, factor: float | None = None, periods: list[float | None] | None = None, centers: list[str] | None = None, sigmas: list[str] | None = None, stretched: bool = True, block: int | None = None) -> DataFrame:
    """(order, c): c(t) after each hill, from hills numbered by `order` from 0 or 1 without gaps. `factor` is the bias factor of a tempered run."""
    centers, sigmas, grid = centers or ["center"], sigmas or ["sigma"], Grid(axes, periods)
    block = block or BLOCK
    points = int(np.prod(grid.shape))
    if points > MOST_POINTS:
        raise ValueError(f"a grid of {points} points; at most {MOST_POINTS}")
    strip = 4096
    rows = hills.select(F.col(order).cast("long").alias("o"), F.array(*(F.col(c).cast("double") for c in centers)).alias("c"), F.array(*(F.col(c).cast("double") for c in sigmas)).alias("s"), F.col("height").cast("double").alias("h"))
    rows = rows.withColumn("block", F.floor(F.col("o") / block))

    def total(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(grid.shape)
        for c, s, h in zip(*_arrays(own), strict=True):
            index, more = grid.box(c, s, h, stretched)
            v[index] += more
        flat = v.ravel()
        return pd.DataFrame({"block": int(key[0]), "strip": range(0, points, strip), "v": [flat[k : k + strip] for k in range(0, points, strip)]})

    def running(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block", ignore_index=True)
        v = np.cumsum(np.stack(own["v"]), 0) - np.stack(own["v"])
        return own.assign(v=list(v))

    starts = rows.groupBy("block").applyInPandas(total, "block long, strip long, v array<double>").groupBy("strip").applyInPandas(running, "block long, strip long, v array<double>")

    def walk(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("o", ignore_index=True)
        v = np.concatenate(start.sort_values("strip")["v"].tolist()).reshape(grid.shape) / kt
        tempered = bool(factor and factor > 1)
        above, below = (factor / (factor - 1), 1 / (factor - 1)) if tempered else (1.0, 0.0)
        out = np.empty(len(own))
        parts = (above, below) if below else (above,)
        tops, sums = [], []
        for n, (c, s, h) in enumerate(zip(*_arrays(own), strict=True)):
            index, more = grid.box(c, s, h, stretched)
            if n % 64 == 0:  # sums are taken anew now and then, so that rounding does not add up
                tops = [a * float(v.max()) for a in parts]
                sums = [float(np.exp(a * v - top).sum()) for a, top in zip(parts, tops, strict=True)]
            before = v[index]
            after = before + more / kt
            v[index] = after
            for k, a in enumerate(parts):
                high = a * float(after.max(initial=-math.inf))
                if high > tops[k] + 50 or sums[k] < 1e-3:
                    tops[k] = a * float(v.max())
                    sums[k] = float(np.exp(a * v - tops[k]).sum())
                else:
                    sums[k] += float((np.exp(a * after - tops[k]) - np.exp(a * before - tops[k])).sum())
            logs = [top + math.log(x) for top, x in zip(tops, sums, strict=True)]
            out[n] = kt * (logs[0] - (logs[1] if below else math.log(points)))
        return pd.DataFrame({"o": own["o"], "c": out})

    found = rows.groupBy("block").cogroup(starts.groupBy("block")).applyInPandas(walk, "o long, c double")
    return found.withColumnRenamed("o", order)


def weights(frames: DataFrame, hills: DataFrame, key: str, x: list[str], time: str, temperature: float = 300.0, mode: str = "final", factor: float | None = None, skip: float = 0.0, axes: list[np.ndarray] | None = None, periods: list[float | None] | None = None, centers: list[str] | None = None, sigmas: list[str] | None = None) -> DataFrame:
    """`frames` with weights of mean one over frames from `skip` on, from a table of hills: by the final bias, or (`mode` not "final") by the bias at each frame's time
    less c(t) of the last hill before it, on the grid `axes`. Hills have hill_time."""
    from terrane.functions.columns import R
    from terrane.operators.joins import asof
    from terrane.operators.ranges import ROWS
    from terrane.operators.reweight import log_weights
    from terrane.operators.timeseries import global_ordinals

    kt = R * temperature
    named = bias(frames, hills, key, x, None if mode == "final" else time, periods, centers, sigmas)
    out = frames.join(named, key)
    lw = F.col("bias")
    if mode != "final":
        numbered = global_ordinals(hills, F.col("hill_time").cast("double"), ["hill_time", *(centers or ["center"])], "_o")
        c = constants(numbered, "_o", axes, kt, factor, periods, centers, sigmas)
        timed = numbered.select("_o", F.col("hill_time").cast("double").alias("_t")).join(c, "_o").groupBy("_t").agg(F.max(F.struct("_o", "c"))["c"].alias("_c"))
        since = asof(frames.select(key, F.col(time).cast("double").alias("_t")), timed, [], "_t", "_c", key, strict=True, rows=ROWS).select(key, "_c")
        out = out.join(since, key, "left")
        lw = lw - F.coalesce(F.col("_c"), F.lit(0.0))
    out = out.withColumn("_lw", lw / kt).withColumn("_kept", F.col(time) >= skip)
    return log_weights(out, "_lw", "_kept").drop("_lw", "_kept", "_c", "bias")

"""Correlated series: autocorrelation, statistical inefficiency, equilibration, blocks, convergence diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranges


def autocorrelation(df: DataFrame, replicate: str, order: list[str], value: str, lags: int) -> DataFrame:
    """(replicate, lag, c, n): C(t) = sum dx_i dx_{i+t} / ((n - t) var), population variance."""
    w = Window.partitionBy(replicate)
    v = F.col(value).cast("double")
    rows = df.select(replicate, *order, v.alias("x")).withColumn("n", F.count("*").over(w)).withColumn("d", F.col("x") - F.avg("x").over(w)).withColumn("var", F.var_pop("x").over(w))
    o = Window.partitionBy(replicate).orderBy(*order)
    out = rows.select(replicate, "n", "var", *(F.when(F.lead("d", t).over(o).isNotNull(), F.col("d") * F.lead("d", t).over(o)).alias(f"p{t}") for t in range(1, lags + 1)))
    sums = out.groupBy(replicate, "n", "var").agg(*(F.sum(f"p{t}").alias(f"p{t}") for t in range(1, lags + 1)))
    stacked = sums.selectExpr(replicate, "n", "var", f"stack({lags}, {', '.join(f'{t}, p{t}' for t in range(1, lags + 1))}) as (lag, s)")
    return stacked.where("s is not null and var > 0").select(replicate, "lag", (F.col("s") / ((F.col("n") - F.col("lag")) * F.col("var"))).alias("c"), "n")


def _correlations(d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lags, C) of a centred series for lags 1 to n - 2: the first few by products, the others, if they are asked for, from the power spectrum."""
    n, power, near = len(d), float(d @ d) / len(d), min(16, len(d) - 2)
    lags = np.arange(1, near + 1)
    yield lags, np.array([d[t:] @ d[:-t] for t in lags]) / ((n - lags) * power)
    if near < n - 2:
        padded = np.fft.rfft(d, 2 * n)
        lags = np.arange(near + 1, n - 1)
        yield lags, np.fft.irfft(np.abs(padded) ** 2, 2 * n)[lags] / ((n - lags) * power)


def inefficiency(x: np.ndarray) -> float:
    """g = 1 + 2 sum C(t)(1 - t/n) over lags to n - 2, ending before the first C(t) <= 0 beyond lag 3; 1 for short or constant series."""
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return 1.0
    total = 0.0
    for lags, c in _correlations(np.asarray(x, float) - np.mean(x)):
        crossed = np.flatnonzero((c <= 0) & (lags > 3))
        use = slice(crossed[0] if len(crossed) else None)
        total += float(c[use] @ (1 - lags[use] / n))
        if len(crossed):
            break
    return max(1.0, 1 + 2 * total)


def inefficiencies(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """g of the series from each start on; NaN where it is constant.

    All starts advance together, a lag at a time: sums over what follows a start come from cumulative sums, and a start is done at its first C(t) <= 0 beyond lag 3.
    """
    x = np.asarray(x, float) - np.mean(x)
    n, starts = len(x), np.asarray(starts)
    after = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0.0)  # noqa: E731 sums from each place to the end
    sums, squares, length = after(x), after(x * x), n - starts
    mean = sums[starts] / length
    power = squares[starts] / length - mean * mean
    changed = np.flatnonzero(np.diff(x))
    constant = starts > (changed[-1] if len(changed) else -1)
    g, live = np.ones(len(starts)), np.flatnonzero(~constant & (length >= 4))
    for lag in range(1, n - 1):
        live = live[lag <= length[live] - 2]
        if not len(live):
            break
        s, m, pairs = starts[live], mean[live], length[live] - lag
        heads, tails = sums[s] - sums[n - lag], sums[s + lag]
        c = (after(x[:-lag] * x[lag:])[s] - m * (heads + tails) + pairs * m * m) / (pairs * power[live])
        on = (c > 0) | (lag <= 3)
        live, c = live[on], c[on]
        g[live] += 2 * c * (1 - lag / length[live])
    return np.where(constant, np.nan, np.maximum(g, 1.0))


#: Lags that passes over long replicates reach, one after another.
REACHES = (4096, 65_536, 1_000_000)


def _from_blocks(df: DataFrame, replicate: str, order: list[str], value: str, rows: int) -> list[tuple]:
    """(replicate, n, g) of replicates, by the products of blocks with themselves and the rows behind them up to a reach, through their spectra."""
    about = df.groupBy(replicate).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    out = [(r[replicate], r["n"], 1.0) for r in about if r["n"] < 4 or r["lo"] == r["hi"]]
    open_ = {r[replicate]: r for r in about if r["n"] >= 4 and r["lo"] != r["hi"]}
    for reach in REACHES:
        if not open_:
            break
        reach, width = min(reach, max(r["n"] for r in open_.values())), max(rows, reach)
        means = df.sparkSession.createDataFrame([(k, float(r["m"])) for k, r in open_.items()], f"_key {dict(df.dtypes)[replicate]}, _m double")
        centred = df.join(F.broadcast(means), F.col(replicate).eqNullSafe(F.col("_key"))).select(replicate, *order, (F.col(value).cast("double") - F.col("_m")).alias("_d"))
        placed = ranges.numbered(centred, [replicate], order, rows).withColumn("_block", F.floor(F.col("_ordinal") / width))
        halo = (F.col("_ordinal") % width < reach) & (F.col("_block") > 0)
        spread = placed.withColumn("_home", F.explode(F.when(halo, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block")))).select(replicate, "_home", "_block", "_ordinal", "_d")

        def products(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("_ordinal")
            x = own["_d"].to_numpy(float)
            head = np.where(own["_block"].to_numpy() == key[1], x, 0.0)
            size = 1 << (2 * len(x) - 1).bit_length()
            sums = np.fft.irfft(np.conj(np.fft.rfft(head, size)) * np.fft.rfft(x, size), size)[1 : reach + 1]
            return pd.DataFrame({replicate: [key[0]], "s": [np.pad(sums, (0, reach - len(sums)))]})

        def added(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({replicate: [key[0]], "s": [np.sum(np.stack(own["s"]), 0)]})

        kind = f"`{replicate}` {dict(df.dtypes)[replicate]}, s array<double>"
        for r in spread.groupBy(replicate, "_home").applyInPandas(products, kind).groupBy(replicate).applyInPandas(added, kind).toLocalIterator():
            k, n = open_[r[replicate]], open_[r[replicate]]["n"]
            lags = np.arange(1, min(reach, n - 2) + 1)
            c = np.array(r["s"])[: len(lags)] / ((n - lags) * k["v"])
            crossed = np.flatnonzero((c <= 0) & (lags > 3))
            if len(crossed) or len(lags) == n - 2:
                use = slice(crossed[0] if len(crossed) else None)
                out.append((r[replicate], n, max(1.0, 1 + 2 * float(c[use] @ (1 - lags[use] / n)))))
                del open_[r[replicate]]
    if open_:
        raise ValueError(f"series correlated beyond {REACHES[-1]} frames: {sorted(map(str, open_))[:5]}")
    return out


def effective_samples(df: DataFrame, replicate: str, order: list[str], value: str, rows_each: int | None = None) -> DataFrame:
    """(replicate, n, g, n_eff). A replicate is one ordered series, which the transform needs whole; with `rows_each`, longer ones are cut in blocks."""
    if rows_each:
        some = df.select(replicate, *dict.fromkeys([*order, value]))
        long = some.groupBy(F.col(replicate).alias("_long")).count().where(F.col("count") > rows_each).select("_long")
        same = F.col(replicate).eqNullSafe(F.col("_long"))
        found = _from_blocks(some.join(long, same, "left_semi"), replicate, order, value, rows_each)
        kind = f"`{replicate}` {dict(df.dtypes)[replicate]}, n long, g double, n_eff double"
        table = df.sparkSession.createDataFrame([(r, n, g, n / g) for r, n, g in found], kind)
        return effective_samples(some.join(long, same, "left_anti"), replicate, order, value).unionByName(table)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(float)
        g = inefficiency(x)
        return pd.DataFrame({replicate: [key[0]], "n": [len(x)], "g": [g], "n_eff": [len(x) / g]})

    return ranges.dealt(df.select(replicate, *dict.fromkeys([*order, value])), replicate).groupBy(replicate).applyInPandas(run, f"{replicate} {dict(df.dtypes)[replicate]}, n long, g double, n_eff double")


def starts_of(n: int, step: int = 1) -> np.ndarray:
    """Starts below nine tenths of the series."""
    return np.arange(0, max(1, int(0.9 * n)), step)


def equilibration(x: np.ndarray, step: int = 1) -> tuple[int, float, float]:
    """(t0, g, n_eff) of the start that leaves most effective samples: every `step`-th start is tried, constant ends do not count, the first best wins; t0 is 0 below ten frames."""
    n = len(x)
    if n < 10:
        return 0, (g := inefficiency(x)), n / g
    starts = starts_of(n, step)
    left = (n - starts) / (g := inefficiencies(x, starts))
    if np.isnan(left).all():
        return 0, 1.0, float(n)
    k = int(np.nanargmax(left))
    return int(starts[k]), float(g[k]), float(left[k])


def equilibrated(df: DataFrame, replicate: str, order: list[str], values: list[str], step: int = 1) -> DataFrame:
    """(replicate, observable, t0, g, n_eff): equilibration of each observable; `latest`, the last start among them; `joint`, the start at which the least n_eff of all is greatest.

    A replicate is one ordered series and is scanned in one task, in time of frames by lags until no start correlates.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series = [rows.sort_values(order)[v].to_numpy(float) for v in values]
        n, out = len(rows), [(key[0], v, *equilibration(x, step)) for v, x in zip(values, series, strict=True)]
        last = max(out, key=lambda r: (r[2], r[1]))
        joint = (0, last[3], last[4]) if n < 10 else None
        if joint is None:
            starts = starts_of(n, step)
            g = np.max([np.nan_to_num(inefficiencies(x, starts), nan=np.inf) for x in series], axis=0)
            k = int(np.argmax((n - starts) / g))
            joint = (int(starts[k]), float(g[k]), float((n - starts[k]) / g[k])) if np.isfinite(g[k]) else (0, 1.0, float(n))
        return pd.DataFrame([*out, (key[0], "latest", *last[2:]), (key[0], "joint", *joint)], columns=[replicate, "observable", "t0", "g", "n_eff"])

    return df.groupBy(replicate).applyInPandas(run, f"{replicate} {dict(df.dtypes)[replicate]}, observable string, t0 int, g double, n_eff double")


def block_length(g: Column, n: Column) -> Column:
    """clip(ceil(2g), 1, max(1, n // 5))."""
    return F.greatest(F.lit(1), F.least(F.ceil(2 * g), F.greatest(F.lit(1), F.floor(n / 5)))).cast("long")


def blocks_of(g: Column | None, n: Column) -> Column:
    """How many blocks a series is cut into: n // ceil(10 g), between 3 and 10; 5 where g is not known."""
    if g is None:
        return F.lit(5)
    return F.when(g.isNull(), 5).otherwise(F.greatest(F.lit(3), F.least(F.lit(10), F.floor(n / F.greatest(F.lit(1), F.ceil(10 * g)))))).cast("int")


def in_own_blocks(df: DataFrame, replicate: str, order: list[str], blocks: DataFrame, count: str = "blocks") -> DataFrame:
    """`df` with the number of its block, each replicate cut into as many as `blocks` says; the last one takes the rest."""
    w = Window.partitionBy(replicate)
    rows = df.join(blocks.select(replicate, F.col(count).alias("_k")), replicate)
    rn = F.row_number().over(w.orderBy(*order)) - 1
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / F.col("_k")))
    return rows.withColumn("block", F.least(F.floor(rn / size), F.col("_k") - 1).cast("int")).drop("_k")


def in_blocks(df: DataFrame, replicate: str, order: list[str], blocks: int) -> DataFrame:
    """`df` with the number of its block: blocks of n // blocks frames, the last one takes the rest."""
    w = Window.partitionBy(replicate)
    rn = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("block", F.least(F.floor(rn / F.greatest(F.lit(1), F.floor(F.count("*").over(w) / blocks))), F.lit(blocks - 1)).cast("int"))


def leading_fraction(df: DataFrame, replicate: str, order: list[str], fractions: list[float]) -> DataFrame:
    """`df` once for each fraction whose first max(1, floor(n f)) frames hold the row."""
    w = Window.partitionBy(replicate)
    rows = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    out = rows.withColumn("fraction", F.explode(F.array(*(F.lit(f) for f in fractions))))
    return out.where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("fraction")))).drop("_rn", "_n")


def global_ordinals(df: DataFrame, key: Column, order: list[str], name: str = "ordinal", buckets: int = 200) -> DataFrame:
    """`df` with the place of each row in the order of a whole table, from 0, without one task that sees all rows.

    Rows fall into ranges of a numeric key (the leading part of the order) between approximate quantiles; counts of the ranges, at most `buckets` numbers, give
    each range its offset, and rows are numbered within their range.
    """
    cuts = df.agg(F.percentile_approx(key.cast("double"), F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10_000)).alias("q")).first()["q"] or []
    bounds = F.array(*(F.lit(float(q)) for q in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    rows = df.withColumn("_range", F.coalesce(F.size(F.filter(bounds, lambda q: q <= key.cast("double"))), F.lit(-1)))
    sizes = dict(rows.groupBy("_range").agg(F.count("*")).collect())  # one row a range
    offsets, total = [0] * (buckets + 2), 0
    for i in range(-1, buckets + 1):
        offsets[i + 1], total = total, total + sizes.get(i, 0)
    rn = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return rows.withColumn(name, F.get(F.array(*(F.lit(int(o)).cast("long") for o in offsets)), F.col("_range") + 1) + rn).drop("_range")


def cosine_content(df: DataFrame, order: list[str], value: str, k: int, by: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """(2/N) (sum p cos(k pi t/(N-1)))**2 / sum p**2 of the centred series; 0 below three frames.

    A whole table is numbered by ranges of `key`, a number that leads the order; without one, by one sorted pass.
    """
    if by is None and key is not None:
        about = df.agg(F.count("*").alias("_n"), F.avg(value).alias("_m"))
        rows = global_ordinals(df, key, order, "_t").crossJoin(F.broadcast(about)).withColumn("_p", F.col(value) - F.col("_m"))
    else:
        w = Window.partitionBy(*(by or []))
        rows = df.withColumn("_t", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_p", F.col(value) - F.avg(value).over(w))
    c = F.cos(F.lit(k * math.pi) * F.col("_t") / (F.col("_n") - 1))
    out = rows.groupBy(*(by or [])).agg(F.max("_n").alias("n"), F.sum(F.when(F.col("_n") >= 3, F.col("_p") * c)).alias("a"), F.sum(F.col("_p") * F.col("_p")).alias("b"))
    return out.select(*(by or []), "n", F.when((F.col("n") < 3) | (F.col("b") == 0), 0.0).otherwise(2.0 / F.col("n") * F.col("a") * F.col("a") / F.col("b")).alias("cosine_content"))


def even_subsample(df: DataFrame, key: Column, order: list[str], points: int) -> DataFrame:
    """`points` rows evenly over the order of the whole table, with their place `k`."""
    rows = global_ordinals(df, key, order, "k")
    n = df.agg(F.count("*").alias("n"))
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "n").select(F.floor(F.col("i") * (F.col("n") - 1) / float(points - 1)).alias("k")).distinct()
    return rows.join(F.broadcast(wanted), "k")


def verdict(rmsip: Column, cosine: Column, n_eff: Column) -> Column:
    return F.when(n_eff < 50, "Insufficient").when((rmsip >= 0.7) & (cosine < 0.5), "Good").when((rmsip >= 0.5) & (cosine < 0.7), "Mixed").otherwise("Poor")


def production(df: DataFrame, starts: DataFrame, replicate: str, order: list[str], start: str = "t0") -> DataFrame:
    """Frames from each replicate's start on; replicates without one keep all. Starts are one row a replicate."""
    rn = F.row_number().over(Window.partitionBy(replicate).orderBy(*order)) - 1
    out = df.withColumn("_rn", rn).join(starts.select(replicate, F.col(start).alias("_t0")), replicate, "left")
    return out.where(F.col("_rn") >= F.coalesce("_t0", F.lit(0))).drop("_rn", "_t0")

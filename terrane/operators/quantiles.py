"""Exact quantiles of columns of any size: ranks are narrowed to ranges between approximate quantiles, and only the range that holds a rank is sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may come to the driver as counted values, and the accuracy of the approximate quantiles between which ranks are sought.
MOST, ACCURACY = 100_000, 10_000


def _picked(v: DataFrame, ranks: list[int]) -> dict[int, float]:
    """Values at ranks of a column of few rows, which come to the driver counted."""
    out, at, todo = {}, 0, sorted(ranks)
    for value, count in v.groupBy("v").count().orderBy("v").collect():
        at += count
        while todo and todo[0] < at:
            out[todo.pop(0)] = value
    return out


def _about(v: DataFrame, shares: list[float]) -> tuple[int, float, float, list[float]]:
    """Rows, least and greatest value, and approximate quantiles a little below and above the shares."""
    near = sorted({min(1.0, max(0.0, p + k * 2 / ACCURACY)) for p in shares for k in (-1, 1)})
    n, least, greatest, cuts = v.agg(F.count("v"), F.min("v"), F.max("v"), F.percentile_approx("v", F.array(*map(F.lit, near)), F.lit(ACCURACY))).first()
    return n, least, greatest, sorted(set(cuts or []))


def _at_ranks(v: DataFrame, n: int, least: float, greatest: float, cuts: list[float], ranks: list[int]) -> dict[int, float]:
    """Values of column v at ranks from 0 in sorted order, of n rows."""
    if n <= MOST:
        return _picked(v, ranks)
    if least == greatest:
        return dict.fromkeys(ranks, least)
    # ranges alternate between what lies strictly between cuts and the cuts' own values, so that a range of one value ends the search
    bounds = F.array(*map(F.lit, cuts))
    ranged = v.withColumn("_p", F.size(F.filter(bounds, lambda c: c < F.col("v"))) + F.size(F.filter(bounds, lambda c: c <= F.col("v"))))
    sizes, out, before, open_ = dict(ranged.groupBy("_p").count().collect()), {}, 0, []
    for p in sorted(sizes):
        inside = [r for r in ranks if before <= r < before + sizes[p]]
        if p % 2:
            out |= dict.fromkeys(inside, cuts[p // 2])
        elif inside:
            open_.append((p, before, inside))
        before += sizes[p]
    if open_ and sum(sizes[p] for p, _, _ in open_) <= MOST:
        chosen = ranged.where(F.col("_p").isin([p for p, _, _ in open_])).select("v")
        skipped, moved = 0, {}
        for p, start, inside in open_:
            moved |= {r: r - start + skipped for r in inside}
            skipped += sizes[p]
        found = _picked(chosen, list(moved.values()))
        return out | {r: found[k] for r, k in moved.items()}
    for p, start, inside in open_:
        some = ranged.where(F.col("_p") == p).select("v")
        found = _at_ranks(some, *_about(some, [(r - start) / sizes[p] for r in inside]), [r - start for r in inside])
        out |= {r: found[r - start] for r in inside}
    return out


def exact_quantiles(df: DataFrame, column: str | Column, probabilities: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values; nulls and not-a-numbers are left out, and no values give None."""
    c = F.col(column) if isinstance(column, str) else column
    v = df.select(c.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, least, greatest, cuts = _about(v, probabilities)
    if not n:
        return [None] * len(probabilities)
    at = [p * (n - 1) for p in probabilities]
    found = _at_ranks(v, n, least, greatest, cuts, sorted({k for x in at for k in (math.floor(x), min(n - 1, math.floor(x) + 1))}))
    return [found[k := math.floor(x)] + (x - k) * (found[min(n - 1, k + 1)] - found[k]) for x in at]


def gaps(df: DataFrame, value: str, ranges: int = 200) -> DataFrame:
    """(gap): differences of consecutive distinct values of a whole table, without one task that sees all of them.

    Values fall into ranges; within a range the next value is the next row, and the last value of a range meets the least one of the next range that has any.
    """
    v = df.select(F.col(value).alias("v")).where("v is not null").distinct()
    cuts = sorted(set(v.agg(F.percentile_approx(F.col("v").cast("double"), F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(ACCURACY))).first()[0] or []))
    rows = v.withColumn("_p", F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < F.col("v").cast("double"))))
    starts = rows.groupBy("_p").agg(F.min("v").alias("_start"))  # one row a range
    following = starts.select("_p", F.lead("_start").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("_next"))
    ahead = F.coalesce(F.lead("v").over(Window.partitionBy("_p").orderBy("v")), F.col("_next"))
    return rows.join(F.broadcast(following), "_p").select((ahead - F.col("v")).alias("gap")).where("gap is not null")

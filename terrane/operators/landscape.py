"""Free-energy landscapes: weighted two-dimensional histograms, smoothing, inversion and what is read off them.

A grid is a long table (keys..., ix, iy, x_center, y_center, frames, weight_sum, probability, free_energy): one row a cell, at most bins**2 for each key, so
everything after the histogram is small whatever the size of the frame table. The histogram itself is one partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import bin_center, bin_index, free_energy
from terrane.operators.quantiles import exact_quantiles


def value_range(df: DataFrame, x: str, y: str, pad: float = 0.0) -> DataFrame:
    """One row: xlo, xhi, ylo, yhi, each widened by `pad` times the span."""
    r = df.agg(*(f(F.col(c).cast("double")).alias(n) for n, f, c in (("xlo", F.min, x), ("xhi", F.max, x), ("ylo", F.min, y), ("yhi", F.max, y))))
    if not pad:
        return r
    dx, dy = (F.col("xhi") - F.col("xlo")) * pad, (F.col("yhi") - F.col("ylo")) * pad
    return r.select((F.col("xlo") - dx).alias("xlo"), (F.col("xhi") + dx).alias("xhi"), (F.col("ylo") - dy).alias("ylo"), (F.col("yhi") + dy).alias("yhi"))


def fixed_range(spark, xlo: float, xhi: float, ylo: float, yhi: float) -> DataFrame:
    return spark.range(1).select(*(F.lit(float(v)).alias(n) for n, v in (("xlo", xlo), ("xhi", xhi), ("ylo", ylo), ("yhi", yhi))))


def binned(df: DataFrame, x: str, y: str, bins: int, bounds: DataFrame) -> DataFrame:
    """`df` with ix, iy (null outside the range) and the range."""
    out = df.crossJoin(F.broadcast(bounds))
    return out.withColumn("ix", bin_index(F.col(x), F.col("xlo"), F.col("xhi"), bins)).withColumn("iy", bin_index(F.col(y), F.col("ylo"), F.col("yhi"), bins))


def histogram(df: DataFrame, x: str, y: str, bins: int, bounds: DataFrame | None = None, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and weights by cell, for each key of `by`; frames outside a fixed range are dropped."""
    b = binned(df, x, y, bins, bounds if bounds is not None else value_range(df, x, y)).where("ix is not null and iy is not null")
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    cells = b.groupBy(*(by or []), "ix", "iy", "xlo", "xhi", "ylo", "yhi").agg(F.count("*").alias("frames"), w.alias("weight_sum"))
    return cells.where("weight_sum > 0").select(*(by or []), "ix", "iy", bin_center(F.col("ix"), F.col("xlo"), F.col("xhi"), bins).alias("x_center"), bin_center(F.col("iy"), F.col("ylo"), F.col("yhi"), bins).alias("y_center"), "frames", "weight_sum")


def inverted(cells: DataFrame, temperature: float = 300.0, by: list[str] | None = None) -> DataFrame:
    """Probability and free energy relative to the likeliest cell."""
    w = Window.partitionBy(*(by or []))
    p = cells.withColumn("probability", F.col("weight_sum") / F.sum("weight_sum").over(w))
    return p.withColumn("free_energy", free_energy(F.col("probability"), F.max("probability").over(w), temperature))


def grid(df: DataFrame, x: str, y: str, bins: int, bounds: DataFrame | None = None, weight: str | None = None, temperature: float = 300.0, by: list[str] | None = None) -> DataFrame:
    return inverted(histogram(df, x, y, bins, bounds, weight, by), temperature, by)


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at four standard deviations."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _blur(cells: DataFrame, axis: str, other: str, bins: int, sigma: float) -> DataFrame:
    """One pass along an axis with the border values repeated outside: cell i of the result reads the cells clamp(i + k)."""
    weights = kernel(sigma)
    r = len(weights) // 2
    # a source cell feeds target t wherever clamp(t + k) is the source: inner targets once, border sources also from beyond
    targets = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    spread = cells.select(F.col(axis).alias("s"), other, "p", targets.alias("k"))
    inner = spread.select((F.col("s") - F.col("k")).alias("t"), other, "p", "k").where((F.col("t") >= 0) & (F.col("t") < bins))
    edge = cells.where((F.col(axis) == 0) | (F.col(axis) == bins - 1)).select(F.col(axis).alias("s"), other, "p", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("t"))
    edge = edge.select("t", other, "p", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("k"), "s").where(((F.col("s") == 0) & (F.col("t") + F.col("k") < 0)) | ((F.col("s") == bins - 1) & (F.col("t") + F.col("k") > bins - 1)))
    both = inner.unionByName(edge.drop("s"))
    table = F.array(*(F.lit(v) for v in weights))
    return both.groupBy(F.col("t").alias(axis), other).agg(F.sum(F.col("p") * F.element_at(table, F.col("k") + r + 1)).alias("p"))


def smoothed(cells: DataFrame, bins: int, sigma: float, temperature: float = 300.0) -> DataFrame:
    """(ix, iy, probability, occupied, free_energy) after a Gaussian blur and renormalisation.

    Cells that the blur reached have an energy too if their probability is at least 1e-6 of the largest occupied one.
    """
    total = cells.agg(F.sum("weight_sum").alias("total"))
    p = cells.crossJoin(F.broadcast(total)).select("ix", "iy", (F.col("weight_sum") / F.col("total")).alias("p"))
    out = _blur(_blur(p, "ix", "iy", bins, sigma), "iy", "ix", bins, sigma)
    out = out.join(F.broadcast(cells.select("ix", "iy", F.lit(True).alias("occupied"))), ["ix", "iy"], "left").fillna(False, ["occupied"])
    every = Window.partitionBy()
    out = out.withColumn("probability", F.col("p") / F.sum("p").over(every))
    top = F.max(F.when(F.col("occupied"), F.col("probability"))).over(every)
    out = out.withColumn("top", top)
    return out.select("ix", "iy", "probability", "occupied", F.when(F.col("probability") >= 1e-6 * F.col("top"), free_energy(F.col("probability"), F.col("top"), temperature)).alias("free_energy"))


def automatic_bins(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row `bins`: Freedman-Diaconis on both columns, the larger count, between 16 and 128."""
    n, *ends = df.agg(F.count("*"), *(f(F.col(c).cast("double")) for c in (x, y) for f in (F.min, F.max))).first()
    most = 16
    for c, lo, hi in ((x, *ends[:2]), (y, *ends[2:])):
        quarter, three = exact_quantiles(df, c, [0.25, 0.75]) if n else (None, None)
        width = 2 * (three - quarter) * n ** (-1 / 3) if quarter is not None else 0
        most = max(most, math.ceil((hi - lo) / width) if width > 0 else 16)
    return df.sparkSession.createDataFrame([(min(128, most),)], "bins int")


def marginal(g: DataFrame, axis: str, temperature: float = 300.0) -> DataFrame:
    """Profile along an axis of a grid."""
    p = g.groupBy(f"i{axis}", f"{axis}_center").agg(F.sum("probability").alias("probability"))
    return p.withColumn("free_energy", free_energy(F.col("probability"), F.max("probability").over(Window.partitionBy()), temperature))


def pmf(df: DataFrame, x: str, bins: int, weight: str, temperature: float = 300.0) -> DataFrame:
    """(ix, center, count, weight_sum, probability, pmf) for every bin, empty ones included; the least energy is 0."""
    bounds = df.agg(F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi"))
    b = df.crossJoin(F.broadcast(bounds)).withColumn("ix", bin_index(F.col(x), F.col("lo"), F.col("hi"), bins)).where("ix is not null")
    sums = b.groupBy("ix").agg(F.count("*").alias("count"), F.sum(F.col(weight).cast("double")).alias("weight_sum"))
    every = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("ix"))
    out = every.join(sums, "ix", "left").fillna(0, ["count", "weight_sum"])
    w = Window.partitionBy()
    out = out.withColumn("probability", F.col("weight_sum") / F.sum("weight_sum").over(w))
    return out.select("ix", bin_center(F.col("ix"), F.col("lo"), F.col("hi"), bins).alias("center"), "count", "weight_sum", "probability", free_energy(F.col("probability"), F.max("probability").over(w), temperature).alias("pmf"))


def colour_ceiling(g: DataFrame, value: str = "free_energy", most: float = 35.0) -> float:
    """Where a colour scale ends: the 98th percentile of the energies, at most `most`."""
    (q,) = exact_quantiles(g, value, [0.98])
    return most if q is None else min(q, most)

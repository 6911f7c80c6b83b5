"""States on a landscape: assignment, populations, ranking, minima, saddles and barriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assigned(frames: DataFrame, basins: DataFrame) -> DataFrame:
    """Frames (ix, iy) with the basin of their cell: -1 off the grid, 0 for a cell without one. The grid has at most bins**2 rows."""
    out = frames.join(F.broadcast(basins.select("ix", "iy", "basin_id")), ["ix", "iy"], "left")
    return out.withColumn("basin_id", F.when(F.col("ix").isNull() | F.col("iy").isNull(), -1).otherwise(F.coalesce("basin_id", F.lit(0))))


def populations(frames: DataFrame, basin: str = "basin_id", weight: str | None = None) -> DataFrame:
    """(basin, frames, population): the share of all weight, unassigned frames in the denominator."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    sums = frames.groupBy(basin).agg(F.count("*").alias("frames"), w.alias("w"))
    return sums.withColumn("population", F.col("w") / F.sum("w").over(Window.partitionBy())).where(F.col(basin) > 0).drop("w")


def ranked(pops: DataFrame, basin: str = "basin_id", least: float = 0.05, most: int = 10) -> DataFrame:
    """Major states, most populated first, named A, B, ...; the most populated one if none reaches `least`. Ties go to the lower basin."""
    order = Window.orderBy(F.desc("population"), basin)
    out = pops.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == 1) | ((F.col("population") >= least) & (F.col("rank") <= most)))
    return out.withColumn("state", F.char(F.lit(65) + (F.col("rank") - 1) % 26))


def minima(g: DataFrame, basin: str = "basin_id") -> DataFrame:
    """The cell of least energy of each basin, rows before columns on ties."""
    cell = F.struct("free_energy", "iy", "ix")
    out = g.where(F.col(basin) > 0).where("free_energy is not null").groupBy(basin).agg(F.min(cell).alias("m"))
    return out.select(basin, "m.ix", "m.iy", F.col("m.free_energy").alias("min_free_energy"))


def saddles(g: DataFrame, basin: str = "basin_id") -> DataFrame:
    """(low, high, saddle): the lowest crossing between each two basins that touch; a crossing costs the higher of its two cells."""
    a = g.where(F.col(basin) > 0).where("free_energy is not null").select("ix", "iy", F.col(basin).alias("a"), F.col("free_energy").alias("ga"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    left = a.select("*", step.alias("s")).select((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), "a", "ga")
    right = a.select("ix", "iy", F.col("a").alias("b"), F.col("ga").alias("gb"))
    pairs = left.join(right, ["ix", "iy"]).where("a != b")
    return pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.greatest("ga", "gb")).alias("saddle"))


def barriers(g: DataFrame, basin: str = "basin_id") -> DataFrame:
    """Saddles with the barrier from either side."""
    m = F.broadcast(minima(g, basin).select(F.col(basin).alias("b"), "min_free_energy"))
    out = saddles(g, basin).join(m, F.col("low") == F.col("b")).drop("b").withColumnRenamed("min_free_energy", "m1")
    out = out.join(m, F.col("high") == F.col("b")).drop("b").withColumnRenamed("min_free_energy", "m2")
    return out.select("low", "high", "saddle", (F.col("saddle") - F.col("m1")).alias("barrier_from_low"), (F.col("saddle") - F.col("m2")).alias("barrier_from_high"))


def nearest_frame(frames: DataFrame, centers: DataFrame, key: str, x: str, y: str, ordinal: str) -> DataFrame:
    """The real frame nearest to each centre (key, cx, cy), the first in order on ties."""
    d = F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))
    joined = frames.join(F.broadcast(centers), key)
    return joined.groupBy(key).agg(F.min(F.struct(d.alias("distance"), F.col(ordinal).alias("row"))).alias("m")).select(key, "m.row", "m.distance")


def top_k(frames: DataFrame, key: str, score: str, ordinal: str, k: int) -> DataFrame:
    """The k frames of least score in each group."""
    w = Window.partitionBy(key).orderBy(score, ordinal)
    return frames.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def records(states: DataFrame) -> DataFrame:
    """States as rows of a report: rank, name, percentage with one place, and the place and depth of the minimum."""
    return states.select("rank", "state", F.format_string("%.1f %%", 100 * F.col("population")).alias("share"), "ix", "iy", (F.round("min_free_energy", 4) + 0.0).alias("depth"))

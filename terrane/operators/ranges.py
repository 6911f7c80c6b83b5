"""Ordered series of any length in ranges: lags, runs, as-of matches and running sums without one task that holds a whole replicate.

A replicate of more than a given number of rows is cut at approximate quantiles of its time; rows of one time stay together. What crosses a cut travels
as little as it can: numbers and sums of whole ranges are one row a range, added up and joined back; the last match of the ranges
before is carried the same way; and a lag gets a copy of the next block's first rows, a halo as wide as the lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, at about, and of a block between halos.
ROWS = 1_000_000
_CUTS = 1000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by keys to as many tasks as the cluster has use for: for work that is long though its rows are few, which adaptive execution would put together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def in_ranges(df: DataFrame, by: list[str], time: Column, rows: int = ROWS) -> DataFrame:
    """`df` with `_range`, from 0 in order of time within each replicate: 0 for all rows of a replicate of at most `rows` of them.

    A time with more rows than that makes a range of its own; a replicate has at most 1000 ranges. A null time is in range 0.
    """
    t = time.cast("double")
    sized = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    named = df.withColumn("_time", t)
    if by:
        sized = sized.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "_n")
        same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
        match = same[0]
        for more in same[1:]:
            match = match & more
        long = named.join(sized, match).groupBy(*(f"_by{k}" for k in range(len(by))), "_n")
    else:
        long = named.crossJoin(F.broadcast(sized)).groupBy("_n")
    cuts = long.agg(F.percentile_approx("_time", F.array(*(F.lit(k / _CUTS) for k in range(1, _CUTS))), F.lit(10_000)).alias("_q"))
    pieces = F.least(F.lit(_CUTS), F.ceil(F.col("_n") / rows))
    at = F.transform(F.sequence(F.lit(1), pieces - 1), lambda k: F.get(F.col("_q"), F.floor(k * _CUTS / pieces).cast("int") - 1))
    cuts = cuts.select(*[f"_by{k}" for k in range(len(by))], F.array_distinct(at).alias("_cuts"))
    out = named.join(cuts, match, "left") if by else named.crossJoin(F.broadcast(df.sparkSession.range(1).select().join(cuts, F.lit(True), "left")))
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_time"))), F.lit(0))
    return out.withColumn("_range", F.when(F.col("_cuts").isNull() | F.col("_time").isNull(), 0).otherwise(place)).drop("_time", "_cuts", *[f"_by{k}" for k in range(len(by))])


def _joined(df: DataFrame, small: DataFrame, by: list[str], part: str) -> DataFrame:
    """`df` with the columns of a table of one row a replicate and part."""
    keys = [*by, part]
    named = small
    for k, c in enumerate(keys):
        named = named.withColumnRenamed(c, f"_key{k}")
    match = F.lit(True)
    for k, c in enumerate(keys):
        match = match & df[c].eqNullSafe(named[f"_key{k}"])
    return df.join(named, match, "left").drop(*(f"_key{k}" for k in range(len(keys))))


def numbered(df: DataFrame, by: list[str], order: list[str], rows: int = ROWS, name: str = "_ordinal") -> DataFrame:
    """`df` with each row's place in its replicate, from 0. The first column of `order` is the time."""
    ranged = in_ranges(df, by, F.col(order[0]), rows)
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_start", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return _joined(ranged, before, by, "_range").withColumn(name, (F.col("_start") + own).cast("long")).drop("_start", "_range")


def lagged(df: DataFrame, by: list[str], order: list[str], value: str, lags: list[int], rows: int = ROWS) -> DataFrame:
    """`df` with `_ordinal`, `_block` and an array `_ahead` of the values `lags` rows further on (null beyond the end)."""
    width = max(rows, 4 * max(lags))
    placed = numbered(df, by, order, rows).withColumn("_block", F.floor(F.col("_ordinal") / width))
    halo = (F.col("_ordinal") % width < max(lags)) & (F.col("_block") > 0)
    homes = F.when(halo, F.array(F.col("_block"), F.col("_block") - 1)).otherwise(F.array("_block"))
    spread = placed.withColumn("_home", F.explode(homes))
    w = Window.partitionBy(*by, "_home").orderBy("_ordinal")
    out = spread.withColumn("_ahead", F.array(*(F.lead(value, k).over(w) for k in lags)))
    return out.where("_home = _block").drop("_home")


def running(df: DataFrame, by: list[str], part: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """`df` with the sum of `amount` over all earlier rows of the replicate; parts are in order, and are windows of their own."""
    held = df.withColumn("_amount", amount)
    sums = held.groupBy(*by, part).agg(F.sum("_amount").alias("_s"))
    before = sums.withColumn("_start", F.sum("_s").over(Window.partitionBy(*by).orderBy(part)) - F.col("_s")).drop("_s")
    inside = F.coalesce(F.sum("_amount").over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(held, before, by, part).withColumn(name, F.coalesce("_start", F.lit(0)) + inside).drop("_start", "_amount")


def runs(df: DataFrame, by: list[str], order: list[str], state: str, rows: int = ROWS) -> DataFrame:
    """`df` with `run`, the number of its stretch of one state within the replicate, from 1."""
    ahead = lagged(df, by, order, state, [1], rows)
    ends = F.when(F.col("_ahead")[0].eqNullSafe(F.col(state)), 0).otherwise(1)
    counted = running(ahead, by, "_block", ["_ordinal"], ends, "_ended")
    return counted.withColumn("run", F.col("_ended") + 1).drop("_ended", "_ahead", "_block", "_ordinal")


def carried(df: DataFrame, by: list[str], hit: Column, inside: Column, name: str, backward: bool = True) -> DataFrame:
    """`df`, in ranges, with `inside` (a window's last hit in the own range), or else the last hit of the ranges before (the first one of those behind)."""
    held = df.withColumn("_hit", hit).withColumn(name, inside)
    ends = held.groupBy(*by, "_range").agg((F.max if backward else F.min)("_hit").alias("_end"))
    w = Window.partitionBy(*by).orderBy("_range" if backward else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(w)).drop("_end")
    return _joined(held, ends, by, "_range").withColumn(name, F.coalesce(name, "_carried")).drop("_carried", "_hit")

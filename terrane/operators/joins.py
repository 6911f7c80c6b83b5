"""Joins that relational engines lack: as-of in several flavours, range joins with accumulation, and joins by theta within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranges


def _merged(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, key: str) -> DataFrame:
    """Both sides in one table, ordered by one shuffle: rows of the left carry their key."""
    a = left.select(*by, F.col(time).alias("_t"), F.col(key).alias("_key"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(None).cast(dict(right.dtypes)[time]).alias("_rt"))
    b = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(dict(left.dtypes)[key]).alias("_key"), F.col(value).alias("_v"), F.col(time).alias("_rt"))
    return a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(0)))


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, key: str, direction: str = "backward", strict: bool = False, tolerance: float | None = None, ties: str = "earlier", rows: int | None = None) -> DataFrame:
    """(by, key, time, value): the value of the right row that matches each left row's time, null if none.

    backward: the last right row at or before (before, if strict); forward: the first at or after; nearest: the closer of both, the earlier on ties, or the later with `ties`.
    Rows meet in one sorted pass per group: no row is copied, and no pair is formed. With `rows`, groups of more rows than that are passed range by range.
    """
    both = _merged(left, right, by, time, value, key)
    both = ranges.in_ranges(both, by, F.col("_t"), rows) if rows else both
    parts = [*by, "_range"] if rows else by
    before = F.col("_side") if not strict else -F.col("_side")
    w = Window.partitionBy(*parts).orderBy("_t", before).rowsBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy(*parts).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("_rt").isNotNull(), F.struct("_rt", "_v"))
    out = both
    for side, window, back in (("_b", w, True), ("_f", v, False)):
        if direction in ("backward" if back else "forward", "nearest"):
            own = F.last(hit, ignorenulls=True).over(window)
            out = ranges.carried(out, by, hit, own, side, back) if rows else out.withColumn(side, own)
    if direction == "backward":
        best: Column = F.col("_b")
    elif direction == "forward":
        best = F.col("_f")
    else:
        ahead, behind = F.col("_f._rt") - F.col("_t"), F.col("_t") - F.col("_b._rt")
        nearer = ahead <= behind if ties == "later" else ahead < behind
        best = F.when(F.col("_b").isNull() | nearer, F.coalesce("_f", "_b")).otherwise(F.col("_b"))
    out = out.where("_side = 1").withColumn("_m", best)
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.abs(F.col("_m._rt") - F.col("_t")) <= tolerance, F.col("_m")))
    return out.select(*by, F.col("_key").alias(key), F.col("_t").alias(time), F.col("_m._rt").alias("matched_time"), F.col("_m._v").alias(value))


def accumulated_before(left: DataFrame, right: DataFrame, by: list[str], time: str, amount: str, key: str, rows: int | None = None) -> DataFrame:
    """For each left row, the sum and the count of right rows strictly before it: the separable range join, as a running sum in one sorted pass,
    or, with `rows`, range by range in groups of more rows than that."""
    both = _merged(left, right, by, time, amount, key)
    if rows:
        both = ranges.in_ranges(both, by, F.col("_t"), rows)
        at = ["_t", F.desc("_side")]
        both = ranges.running(both, by, "_range", at, F.coalesce(F.col("_v"), F.lit(0.0)), "_s")
        both = ranges.running(both, by, "_range", at, F.when(F.col("_v").isNotNull(), 1).otherwise(0), "_n")
        return both.where("_side = 1").select(*by, F.col("_key").alias(key), F.coalesce("_s", F.lit(0.0)).alias("total"), F.col("_n").cast("long").alias("n"))
    w = Window.partitionBy(*by).orderBy("_t", F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_s", F.sum("_v").over(w)).withColumn("_n", F.count("_v").over(w))
    return out.where("_side = 1").select(*by, F.col("_key").alias(key), F.coalesce("_s", F.lit(0.0)).alias("total"), F.col("_n").alias("n"))


def common_keys(first: DataFrame, second: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys of both tables once each, the first row of each table standing for its key, in the first table's order."""

    def once(t: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        return t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    return once(first).select(*keys, F.col(order).alias("first_order")).join(once(second).select(*keys, F.col(order).alias("second_order")), keys)


def at_time(frames: DataFrame, by: list[str], time: str, order: list[str], when: float) -> DataFrame:
    """The frame of each group nearest to one time, the first in order on ties."""
    best = F.min(F.struct(F.abs(F.col(time) - when).alias("_d"), *order, F.struct(*(c for c in frames.columns)).alias("_row")))
    return frames.groupBy(*by).agg(best.alias("_best")).select("_best._row.*")


def ends(frames: DataFrame, by: list[str], time: str, order: list[str], values: list[str]) -> DataFrame:
    """(by, first_<value>, last_<value>...): values of the first and last frame of each group."""
    row = F.struct(*(F.col(c) for c in dict.fromkeys([time, *order])), *(F.col(v).alias(f"_{v}") for v in values))
    out = frames.groupBy(*by).agg(F.min(row).alias("_a"), F.max(row).alias("_z"))
    return out.select(*by, *(F.col(f"{s}._{v}").alias(f"{n}_{v}") for v in values for s, n in (("_a", "first"), ("_z", "last"))))


def common_to_all(tables: list[DataFrame], chain: str, residue: str, atom: str, order: str) -> DataFrame:
    """(chain, residue, atom, order_0, order_1, ...) of atoms that all tables have, the first row of each table standing for its key.

    Keys are chain, residue and atom if all tables have the same chains, else residue and atom alone; chain and order are the first table's.
    """
    chains = [sorted(str(r[0]) for r in t.select(chain).distinct().collect()) for t in tables]  # chains are few
    keys = [chain, residue, atom] if all(c == chains[0] for c in chains) else [residue, atom]
    out = None
    for k, t in enumerate(tables):
        w = Window.partitionBy(*keys).orderBy(order)
        one = t.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        one = one.select(*dict.fromkeys([*([chain] if k == 0 else []), *keys]), F.col(order).alias(f"order_{k}"))
        out = one if out is None else out.join(one, keys)
    return out

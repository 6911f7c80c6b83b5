"""Kinetics of labelled, ordered series: transitions, visits, lifetimes and passage times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranges
from terrane.operators.quantiles import exact_quantiles, gaps


def pairs(df: DataFrame, replicate: str, order: list[str], state: str, labels: list[str] | None = None, lag: int = 1, rows_each: int | None = None) -> DataFrame:
    """(replicate, source, target) of frames `lag` apart within a replicate, after frames in other states are taken out. With `rows_each`, replicates
    of more frames than that are cut in ranges with halos."""
    rows = df.where(F.col(state).isin(labels)) if labels else df
    if rows_each:
        ahead = ranges.lagged(rows, [replicate], order, state, [lag], rows_each)
        return ahead.select(replicate, F.col(state).alias("source"), F.col("_ahead")[0].alias("target")).where("target is not null")
    w = Window.partitionBy(replicate).orderBy(*order)
    out = rows.select(replicate, F.col(state).alias("source"), F.lead(state, lag).over(w).alias("target"))
    return out.where("target is not null")


def transition_counts(steps: DataFrame, labels: list[str], by: str | None = None) -> DataFrame:
    """Counts of all ordered pairs of labels, zeros included; for each replicate if named."""
    spark = steps.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "source string")
    frame = names.crossJoin(names.withColumnRenamed("source", "target"))
    counts = steps.groupBy(*([by] if by else []), "source", "target").agg(F.count("*").alias("n"))
    if by:
        frame = steps.select(by).distinct().crossJoin(F.broadcast(frame))
    return frame.join(counts, ([by] if by else []) + ["source", "target"], "left").fillna(0, ["n"])


def grouped_counts(steps: DataFrame, replicate: str) -> DataFrame:
    """Pooled and per-replicate counts in one pass by grouping sets; the pooled rows have a null replicate."""
    return steps.groupingSets([["source", "target"], [replicate, "source", "target"]], replicate, "source", "target").agg(F.count("*").alias("n"))


def transition_matrix(counts: DataFrame) -> DataFrame:
    """Row-normalised counts; null rows for states without a way out."""
    out = F.sum("n").over(Window.partitionBy("source"))
    return counts.withColumn("probability", F.when(out > 0, F.col("n") / out))


def visits(df: DataFrame, replicate: str, order: list[str], state: str, time: str, labels: list[str] | None = None, dt: float = 1.0, rows_each: int | None = None) -> DataFrame:
    """Runs of one state: start, end, frames, dwell, and whether the run is the first or last of its replicate and so cut off. With `rows_each`,
    replicates of more frames than that are cut in ranges, whose runs are stitched."""
    rows = df.where(F.col(state).isin(labels)) if labels else df
    if rows_each:
        out = ranges.runs(rows, [replicate], order, state, rows_each).groupBy(replicate, "run").agg(F.first(state).alias("state"), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("frames"))
        last = out.groupBy(F.col(replicate).alias("_key")).agg(F.max("run").alias("_last"))
        out = out.join(last, F.col(replicate).eqNullSafe(F.col("_key"))).drop("_key")
        return out.withColumn("dwell", F.col("frames") * dt).withColumn("censored", (F.col("run") == 1) | (F.col("run") == F.col("_last"))).drop("_last")
    w = Window.partitionBy(replicate).orderBy(*order)
    new = F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(replicate, "run").agg(F.first(state).alias("state"), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("frames"))
    every = Window.partitionBy(replicate)
    censored = (F.col("run") == F.min("run").over(every)) | (F.col("run") == F.max("run").over(every))
    return out.withColumn("dwell", F.col("frames") * dt).withColumn("censored", censored)


def visit_summary(v: DataFrame, steps: DataFrame) -> DataFrame:
    """By state: visits, mean and median of whole ones, longest, total, transitions out and in, and lifetime total/out (infinite without a way out)."""
    whole = F.when(~F.col("censored"), F.col("dwell"))
    lengths = v.where("not censored").groupBy("state", "dwell").agg(F.count("*").alias("_n"))  # few lengths, multiples of the frame spacing
    median = lengths.groupBy("state").agg(F.percentile("dwell", F.lit(0.5), F.col("_n")).alias("median_dwell"))
    s = v.groupBy("state").agg(F.count("*").alias("visits"), F.count(whole).alias("visits_uncensored"), F.avg(whole).alias("mean_dwell"), F.max("dwell").alias("max_dwell"), F.sum("dwell").alias("total_time"))
    s = s.join(F.broadcast(median), "state", "left")
    moved = steps.where("source != target")
    out, in_ = moved.groupBy(F.col("source").alias("state")).agg(F.count("*").alias("transitions_out")), moved.groupBy(F.col("target").alias("state")).agg(F.count("*").alias("transitions_in"))
    s = s.join(out, "state", "left").join(in_, "state", "left").fillna(0, ["transitions_out", "transitions_in"])
    return s.withColumn("lifetime", F.when(F.col("transitions_out") > 0, F.col("total_time") / F.col("transitions_out")).otherwise(F.lit(float("inf"))))


def mean_first_passage(matrix: np.ndarray, dt: float = 1.0) -> np.ndarray:
    """Mean first passage times between the states of a transition matrix; not-a-number where they do not exist."""
    n = len(matrix)
    p = np.nan_to_num(matrix)
    out = np.zeros((n, n))
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        try:
            out[rest, j] = np.linalg.solve(np.eye(n - 1) - p[np.ix_(rest, rest)], np.ones(n - 1)) * dt
        except np.linalg.LinAlgError:
            out[rest, j] = np.nan
    out[(out < 0) | ~np.isfinite(out) | ((out == 0) & ~np.eye(n, dtype=bool))] = np.nan
    return out


def frame_spacing(df: DataFrame, time: str, replicate: str | None = None) -> DataFrame:
    """One row `dt`: the median positive gap, within replicates if one is named, else of the pooled distinct times; null without a gap."""
    if replicate:
        w = Window.partitionBy(replicate).orderBy(time)
        between = df.select((F.lead(time).over(w) - F.col(time)).alias("gap"))
    else:
        between = gaps(df, time)
    return df.sparkSession.createDataFrame([tuple(exact_quantiles(between.where("gap > 0"), "gap", [0.5]))], "dt double")

"""Streams of frames: landscapes and moments that grow with the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import bin_index


def streaming_histogram(frames: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], bins: int) -> DataFrame:
    """(ix, iy, frames) over fixed edges; a plain aggregation of bounded state (bins**2 cells) for complete or update mode."""
    xlo, xhi, ylo, yhi = (F.lit(float(v)) for v in bounds)
    b = frames.select(bin_index(F.col(x), xlo, xhi, bins).alias("ix"), bin_index(F.col(y), ylo, yhi, bins).alias("iy"))
    return b.where("ix is not null and iy is not null").groupBy("ix", "iy").agg(F.count("*").alias("frames"))


def windowed_states(events: DataFrame, time: str, state: str, width: str, late: str) -> DataFrame:
    """(window, state, frames) with a watermark, for append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), state).agg(F.count("*").alias("frames"))


def moments_sink(folder: str, vector: str, by: str):
    """A function for `foreachBatch` that adds each micro-batch's moments to a Parquet table, one folder a batch so that a repeated batch replaces itself."""
    from terrane.operators import decompose

    def add(batch: DataFrame, epoch: int) -> None:
        decompose.moments(batch, vector, by).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return add


def merged_moments(spark, folder: str, by: str) -> dict:
    """All batches' moments by key, merged on the executors."""
    from terrane.operators import decompose

    return decompose.collected(decompose.merged_tables(spark.read.parquet(folder), by), by)

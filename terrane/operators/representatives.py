"""Exact medoids without all pairs: by sorted running sums in one variable, by bounds from pivots in several."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import ranges

#: Rows whose sums of distances one pass finds.
BATCH = 64


def distance_sums(df: DataFrame, by: list[str], value: str, key: str, rows: int = ranges.ROWS) -> DataFrame:
    """(by, key, total, n): each row's sum of distances |x - y| to all rows of its group.

    With r rows and a sum of p before a row in sorted order, the sum is x (2 r - n) + T - 2 p: two running sums instead of pairs, range by range in groups of more than `rows` rows.
    """
    some = df.select(*by, key, F.col(value).cast("double").alias("_x")).where("_x is not null")
    ranged = ranges.in_ranges(some, by, F.col("_x"), rows)
    order = ["_x", key]
    counted = ranges.running(ranged, by, "_range", order, F.lit(1), "_r")
    summed = ranges.running(counted, by, "_range", order, F.col("_x"), "_p")
    whole = some.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.count("*").alias("n"), F.sum("_x").alias("_t"))
    match = F.lit(True)
    for k, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    out = summed.join(whole, match)
    return out.select(*by, key, (F.col("_x") * (2 * F.col("_r") - F.col("n")) + F.col("_t") - 2 * F.col("_p")).alias("total"), "n")


def medoid(df: DataFrame, columns: list[str], key: str, most_passes: int = 200) -> tuple[object, float, int]:
    """(key, mean distance, passes) of the row whose summed Euclidean distance to all rows is least; the least key on ties.

    A row's sum is at least n times its distance from the mean, and at least |S - n d| for a row at distance d whose sum S is known. Each pass finds the exact sums of the `BATCH`
    rows of least bound, whose sums sharpen all bounds; it ends when no bound is below the best sum. Few passes do in few dimensions; where distances are all alike bounds
    rule nothing out, and passes are as many as rows over `BATCH`: beyond `most_passes` that is an error.
    """
    names = [f"_x{k}" for k in range(len(columns))]
    rows = df.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).na.drop(subset=names)
    n, *mean = rows.agg(F.count("*"), *(F.avg(c) for c in names)).first()
    if not n:
        raise ValueError("no rows")
    center, pivots, sums, keys = np.array(mean), np.zeros((0, len(columns))), np.zeros(0), []

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([np.asarray(b.column(c), float) for c in names])

    def away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(2))

    for step in range(most_passes):
        best = float(sums.min()) if len(sums) else np.inf

        def bounded(batches: Iterator[pa.RecordBatch], pivots: np.ndarray = pivots, sums: np.ndarray = sums, best: float = best) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 4000):
                    b = whole.slice(s, 4000)
                    x = matrix(b)
                    low = n * np.sqrt(((x - center) ** 2).sum(1))
                    if len(pivots):
                        low = np.maximum(low, np.abs(sums[None] - n * away(x, pivots)).max(1))
                    keep = low <= best * (1 + 1e-12)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=[*b.schema.names, "_low"]).filter(pa.array(keep))

        kind = dict(rows.dtypes)["_key"]
        schema = f"_key {kind}, {', '.join(f'{c} double' for c in names)}, _low double"
        left = rows.mapInArrow(bounded, schema)
        left = left.where(~F.col("_key").isin(keys)) if keys else left
        some = left.orderBy("_low", "_key").limit(BATCH).collect()
        if not some:
            at = min((float(s), k) for s, k in zip(sums, keys, strict=True))
            return at[1], at[0] / n, step
        batch = np.array([[r[c] for c in names] for r in some])

        def totals(batches: Iterator[pa.RecordBatch], batch: np.ndarray = batch) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(batch))
            for b in batches:
                for s in range(0, b.num_rows, 4000):
                    total += away(matrix(b.slice(s, 4000)), batch).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch), dtype=np.int32)), pa.array(total)], names=["i", "s"])

        found = {r["i"]: r["s"] for r in rows.mapInArrow(totals, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        pivots, sums, keys = np.vstack([pivots, batch]), np.append(sums, [found[i] for i in range(len(batch))]), keys + [r["_key"] for r in some]
    raise ValueError(f"{most_passes} passes were not enough: distances from these rows are too much alike")

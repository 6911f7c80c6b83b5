"""Clustering of frames of any number: regular-space covers and k-means with seeds from all rows.

Centres are few (thousands at most) and go with the tasks; every pass works Arrow batches against all of them by matrix products and returns sums, or a bounded
number of rows. Passes: regular space takes one for each round of new centres, k-means one for each round of seeding and of moving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Uncovered frames that come to the driver in a round of the regular-space cover.
ROUND = 20_000


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).cast(pa.float64()), float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def distances2(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances; exactly 0 for equal points, unlike the expanded product."""
    out = np.empty((len(x), len(centers)))
    step = max(1, 2_000_000 // max(1, centers.size))
    for s in range(0, len(x), step):
        out[s : s + step] = ((x[s : s + step, None, :] - centers[None]) ** 2).sum(2)
    return out


def assigned(df: DataFrame, columns: list[str], centers: np.ndarray, name: str = "microstate") -> DataFrame:
    """`df` with the index of the nearest centre (the first on ties; null with a null coordinate) and `distance2`, its squared distance."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, IntegerType()), StructField("distance2", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, columns)
            known = np.isfinite(x).all(1)
            d = distances2(np.where(known[:, None], x, 0.0), centers)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32), mask=~known), pa.array(d[np.arange(len(x)), at], mask=~known)], schema=arrow)

    return df.mapInArrow(run, schema)


def regular_space(df: DataFrame, columns: list[str], distance: float, order: list[str], most: int = 2000, stride: int = 1) -> np.ndarray:
    """Centres in the order of frames: a frame becomes one if it is farther than `distance` from all before it. So centres are farther apart than that, and cover all frames.

    As if frame after frame were visited: each round takes the first `ROUND` frames (by `order`, which must be total) that no centre covers yet, visits them in order, and
    leaves out what the new centres cover. With `stride`, only every stride-th frame may become a centre. More than `most` centres are an error.
    """
    if distance <= 0:
        raise ValueError("the distance must be positive")
    rows = df.select(*order, *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)))
    names = [f"_x{k}" for k in range(len(columns))]
    if stride > 1:
        from terrane.operators.ranges import numbered

        rows = numbered(rows, [], order).where(F.col("_ordinal") % stride == 0).drop("_ordinal")
    rows = rows.na.drop(subset=names)
    centers = np.zeros((0, len(columns)))
    while True:
        left = rows
        if len(centers):
            left = assigned(rows, names, centers, "_at").where(F.col("distance2") > distance * distance)
        first = left.orderBy(*order).limit(ROUND).select(*names).collect()
        if not first:
            return centers
        found: list[np.ndarray] = []
        for x in np.array([list(r) for r in first], float):
            if not found or distances2(x[None], np.array(found)).min() > distance * distance:
                if len(centers) + len(found) >= most:
                    raise ValueError(f"more than {most} centres: raise the distance")
                found.append(x)
        centers = np.vstack([centers, found])
        if len(first) < ROUND:
            return centers


def _sums(df: DataFrame, columns: list[str], centers: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(rows of each centre, their sums, sum of squared distances, the `far` rows farthest from their centres, farthest first) of one pass."""
    names = [f"_x{k}" for k in range(len(columns))]
    rows = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, spread = np.zeros(len(centers)), np.zeros(centers.shape), 0.0
        top_d, top = np.zeros(0), np.zeros((0, len(names)))
        for b in batches:
            x = _matrix(b, names)
            d = distances2(x, centers)
            at = d.argmin(1)
            d = d[np.arange(len(x)), at]
            n += np.bincount(at, minlength=len(centers))
            np.add.at(total, at, x)
            spread += float(d.sum())
            if far:
                top_d, top = np.append(top_d, d), np.vstack([top, x])
                keep = np.lexsort((*top.T[::-1], -top_d))[:far]
                top_d, top = top_d[keep], top[keep]
        hit = np.flatnonzero(n)
        kinds = np.concatenate([hit, np.full(len(top), -1), [-2]])
        size = np.concatenate([n[hit], top_d, [spread]])
        where = np.vstack([total[hit], top, np.zeros((1, len(names)))])
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(size), *(pa.array(c) for c in where.T)], names=["kind", "size", *names])

    out = rows.mapInArrow(run, "kind int, size double, " + ", ".join(f"{c} double" for c in names))
    sums = {r["kind"]: r for r in out.where("kind != -1").groupBy("kind").agg(F.sum("size").alias("size"), *(F.sum(c).alias(c) for c in names)).collect()}
    n, total = np.zeros(len(centers)), np.zeros(centers.shape)
    for k, r in sums.items():
        if k >= 0:
            n[k], total[k] = r["size"], [r[c] for c in names]
    farthest = out.where("kind = -1").orderBy(F.desc("size"), *names).limit(far).collect() if far else []
    return n, total, float(sums[-2]["size"]) if -2 in sums else 0.0, np.array([[r[c] for c in names] for r in farthest]).reshape(-1, len(names))


def _uniform(seed: int, *parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**40)) / float(2**40)


def seeds(df: DataFrame, columns: list[str], k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """`k` starting centres by oversampled seeding over all rows: in each round a row is drawn with a probability of 2 k times its share of the summed squared distances;
    the drawn ones, some 10 k, are weighed by the rows nearest to them and thinned out on the driver. Equal rows are drawn together."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    first = rows.orderBy(_uniform(seed, *columns), *columns).first()
    if first is None:
        raise ValueError("no rows to cluster")
    centers = np.array([list(first)], float)
    for n in range(rounds):
        _, _, spread, _ = _sums(rows, columns, centers, 0)
        if spread <= 0:
            break
        drawn = assigned(rows, columns, centers, "_at").where(_uniform(seed + 1 + n, *columns) < F.col("distance2") * (2 * k / spread)).select(*columns).distinct().collect()
        if drawn:
            centers = np.unique(np.vstack([centers, np.array([list(r) for r in drawn], float)]), axis=0)
    weight, rng = _sums(rows, columns, centers, 0)[0], np.random.default_rng(seed)
    chosen = centers[[rng.choice(len(centers), p=weight / weight.sum())]]
    while len(chosen) < min(k, len(centers)):
        p = weight * distances2(centers, chosen).min(1)
        if p.sum() <= 0:
            break
        chosen = np.vstack([chosen, centers[rng.choice(len(centers), p=p / p.sum())]])
    return chosen


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 0, rounds: int = 300, tolerance: float = 1e-8, n_init: int = 5, init: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(centres, sum of squared distances) of the best of `n_init` starts, or from `init`. An empty cluster moves to the row farthest from its centre, of all rows.
    Fewer distinct rows than `k` give as many centres as there are."""
    best: tuple[np.ndarray, float] | None = None
    for start in range(1 if init is not None else max(1, n_init)):
        centers = np.array(init, float) if init is not None else seeds(df, columns, k, seed + 1000 * start)
        for _ in range(rounds):
            n, total, spread, far = _sums(df, columns, centers, len(centers))
            new, empty = centers.copy(), np.flatnonzero(n == 0)
            new[n > 0] = total[n > 0] / n[n > 0, None]
            for at, row in zip(empty, far, strict=False):
                new[at] = row
            moved = float(np.abs(new - centers).max())
            centers = new
            if moved <= tolerance:
                break
        spread = _sums(df, columns, centers, 0)[2]
        if best is None or spread < best[1]:
            best = centers, spread
    return best

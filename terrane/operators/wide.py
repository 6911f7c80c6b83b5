"""Modes of vectors of any number of dimensions: nothing of D x D is made anywhere.

Two routes. Fewer vectors than `MOST_ROWS` (and than dimensions) are taken through their Gram matrix, summed over strips of dimensions. Otherwise a block
Krylov range finder: each pass multiplies the covariance with a block of directions, as a sum over rows, and Rayleigh-Ritz on all
blocks so far gives modes with certified errors (the norm of the residual bounds an eigenvalue's). The last pass is a tree QR: every task
reduces its rows' coordinates to one triangle, triangles are stacked and reduced again, and the singular values of the last are those of
the vectors, without squaring.

Partial sums and triangles are folded in two levels, neighbouring partitions first, in strips of dimensions, so no task gets all of
a large state. D x `block` numbers go with the tasks and come back to the driver; their size is checked (`MOST_NUMBERS`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.decompose import NEIGHBOURS, canonical

MOST_ROWS = 4096
#: Numbers (8 bytes each) of the directions that go with every task.
MOST_NUMBERS = 60_000_000
STRIP = 8192
_PARTIAL = "kind string, strip int, part int, rows int, data binary"


def _state(kind: str, strip: int, part: int, x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([kind]), pa.array([strip], pa.int32()), pa.array([part], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "strip", "part", "rows", "data"])


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def _folded(states: DataFrame) -> dict[str, np.ndarray]:
    """The states of each kind as one on the driver: sums, or triangles (kinds that begin with `r`) of stacked triangles."""

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, strip, part = (k.as_py() for k in key)
        total = None
        for b in batches:
            for rows, data in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                x = np.frombuffer(data.as_buffer(), "<f8").reshape(rows, -1)
                if total is None:
                    total = x.copy()
                elif kind.startswith("r"):
                    total = _triangle(np.concatenate([total, x]))
                else:
                    total += x
        yield _state(kind, strip, part, total)

    half = states.withColumn("part", (F.col("part") / NEIGHBOURS).cast("int")).groupBy("kind", "strip", "part").applyInArrow(fold, _PARTIAL)
    whole = half.withColumn("part", F.lit(0)).groupBy("kind", "strip", "part").applyInArrow(fold, _PARTIAL)
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in whole.toLocalIterator():
        found.setdefault(r["kind"], {})[r["strip"]] = np.frombuffer(r["data"], "<f8").reshape(r["rows"], -1)
    return {kind: np.concatenate([x[k] for k in sorted(x)]) for kind, x in found.items()}


def _pass(rows: DataFrame, add: Callable[[dict, np.ndarray, np.ndarray], None]) -> dict[str, np.ndarray]:
    """One pass over (weight, vector): `add` works a batch's weights and vectors into a task's states by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), {}
        for whole in batches:
            width = max(1, len(whole.column(1).flatten()) // max(whole.num_rows, 1))
            for s in range(0, whole.num_rows, step := max(1, 4_000_000 // width)):
                b = whole.slice(s, step)
                add(state, np.asarray(b.column(0), float), np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
        for kind, x in state.items():
            for s in range(0, len(x), STRIP) if not kind.startswith("r") else [0]:
                yield _state(kind, s // STRIP, part, x[s : s + STRIP] if not kind.startswith("r") else x)

    return _folded(rows.mapInArrow(run, _PARTIAL))


def _add(state: dict, kind: str, x: np.ndarray) -> None:
    state[kind] = state[kind] + x if kind in state else x


def weighed(df: DataFrame, vector: str, replicate: str | None = None) -> DataFrame:
    """(w, v): vectors with weights that add up to one, equal for all replicates, or for all rows without one."""
    rows = df.where(F.col(vector).isNotNull())
    v = F.col(vector).cast("array<double>").alias("v")
    if replicate is None:
        n = rows.count()
        return rows.select(F.lit(1.0 / n if n else 0.0).alias("w"), v)
    sizes = rows.groupBy(replicate).agg(F.count("*").alias("_n"))
    many = sizes.count()
    return rows.join(sizes.withColumnRenamed(replicate, "_key"), F.col(replicate).eqNullSafe(F.col("_key"))).select((1.0 / (F.col("_n") * many)).alias("w"), v)


def centre(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weighted mean, and the trace of the covariance."""

    def first(state: dict, w: np.ndarray, x: np.ndarray) -> None:
        _add(state, "mean", (w @ x)[:, None])

    mean = _pass(rows, first)["mean"][:, 0]

    def second(state: dict, w: np.ndarray, x: np.ndarray) -> None:
        _add(state, "trace", np.array([[float(w @ ((x - mean) ** 2).sum(1))]]))

    return mean, float(_pass(rows, second)["trace"][0, 0])


def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `x` has beyond `against`; directions that are only rounding go."""
    size = np.linalg.norm(x, axis=0).max(initial=0)
    for _ in range(2):
        x = x - against @ (against.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-10 * max(size, 1e-300)]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def by_range(rows: DataFrame, mean: np.ndarray, k: int, block: int | None = None, tolerance: float = 1e-9, most_passes: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, largest residual) of the k largest modes by a block Krylov range finder; a residual above `tolerance`
    times the largest eigenvalue means that `most_passes` were not enough."""
    d = len(mean)
    block = min(d, block or k + 10)
    most = min(d, max(6 * block, 2 * k + block))
    if d * most > MOST_NUMBERS:
        raise ValueError(f"{d} dimensions times {most} directions are more than {MOST_NUMBERS} numbers")
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(np.random.default_rng(seed).standard_normal((d, block)), basis)
    for _ in range(most_passes):

        def multiply(state: dict, w: np.ndarray, x: np.ndarray, new: np.ndarray = new) -> None:
            c = x - mean
            _add(state, "image", c.T @ (w[:, None] * (c @ new)))

        image = _pass(rows, multiply)["image"]
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turned = values[order], turned[:, order]
        modes = basis @ turned[:, :k]
        rest = images @ turned - (basis @ turned) * values
        residual = float(np.linalg.norm(rest[:, :k], axis=0).max(initial=0))
        if residual <= tolerance * max(values[0], 1e-300):
            break
        new = _orthonormal(image, basis)
        if basis.shape[1] + new.shape[1] > most:  # begin again from the best directions so far
            keep = min(basis.shape[1], k + block // 2)
            basis, images = basis @ turned[:, :keep], images @ turned[:, :keep]
            new = _orthonormal(rest[:, :block], basis)
        if not new.shape[1]:
            break
    modes = np.linalg.qr(modes)[0]

    def triangle(state: dict, w: np.ndarray, x: np.ndarray) -> None:
        r = np.sqrt(w)[:, None] * ((x - mean) @ modes)
        state["r"] = _triangle(np.concatenate([state["r"], r]) if "r" in state else r)

    _, s, vt = np.linalg.svd(_pass(rows, triangle)["r"])
    return s**2, canonical(modes @ vt.T), residual


def pca(df: DataFrame, vector: str, replicate: str | None = None, k: int = 10, key: str | None = None, **how: object) -> dict[str, np.ndarray]:
    """Mean, eigenvalues, shares of the variance in percent, their running sum and vectors (columns) of the k largest modes, with equal weight
    for each replicate (for each row without one). `key`, unique, allows the Gram route for few rows."""
    rows = weighed(df, vector, replicate)
    mean, trace = centre(rows)
    many = df.where(F.col(vector).isNotNull()).count() if key else 0
    if key and 0 < many <= min(MOST_ROWS, len(mean)):
        values, vectors, residual = gram_modes(df, vector, replicate, key, mean, k)
    else:
        values, vectors, residual = by_range(rows, mean, min(k, len(mean)), **how)
    share = 100 * values / (trace if trace > 0 else 1)
    return {"mean": mean, "eigenvalues": values, "explained": share, "cumulative": np.cumsum(share), "vectors": vectors, "residual": residual, "trace": trace}


def gram_modes(df: DataFrame, vector: str, replicate: str | None, key: str, mean: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, 0) by the Gram matrix of the rows, of which there are at most `MOST_ROWS`, named by a unique key.

    A strip of dimensions, as wide as there are rows, is one group; its products are folded like other sums.
    """
    some = df.where(F.col(vector).isNotNull())
    per = {r["k"]: r["n"] for r in some.groupBy((F.col(replicate) if replicate else F.lit(0)).alias("k")).agg(F.count("*").alias("n")).collect()}
    listed = some.select(F.col(key).alias("k"), (F.col(replicate) if replicate else F.lit(0)).alias("r")).orderBy("k").collect()  # at most MOST_ROWS
    number = {r["k"]: i for i, r in enumerate(listed)}
    w = np.array([1 / (per[r["r"]] * len(per)) for r in listed])
    n = len(listed)
    if n > MOST_ROWS or len(number) < n:
        raise ValueError(f"the Gram route needs unique keys and at most {MOST_ROWS} rows")
    width = max(n, 256)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) - mean
            for s in range(0, x.shape[1], width):
                columns = [pa.array(np.full(len(x), s // width, np.int32)), pa.array([number[i] for i in names], pa.int32()), pa.array([row.tobytes() for row in np.ascontiguousarray(x[:, s : s + width])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["strip", "i", "data"])

    def products(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, strip = None, key[0].as_py()
        for b in batches:
            for i, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                row = np.frombuffer(data.as_buffer(), np.float64)
                if block is None:
                    block = np.zeros((n, len(row)))
                block[i] = row
        gram = block @ block.T
        for s in range(0, n, 512):
            yield _state("gram", s // 512, strip, gram[s : s + 512])

    strips = some.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(cut, "strip int, i int, data binary")
    gram = _folded(strips.groupBy("strip").applyInArrow(products, _PARTIAL))["gram"]
    root = np.sqrt(w)
    values, u = np.linalg.eigh(root[:, None] * gram * root)
    order = np.argsort(values)[::-1][: min(k, n)]
    values, u = np.maximum(values[order], 0), u[:, order]
    keep = values > 1e-14 * max(values[0], 1e-300)
    values, u = values[keep], u[:, keep]
    weights = root[:, None] * u / np.sqrt(values)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), None
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) - mean
            more = x.T @ weights[[number[i] for i in b.column(0).to_pylist()]]
            total = more if total is None else total + more
        for s in range(0, 0 if total is None else len(total), STRIP):
            yield _state("vectors", s // STRIP, part, total[s : s + STRIP])

    vectors = _folded(some.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(back, _PARTIAL))["vectors"]
    return values, canonical(vectors / np.linalg.norm(vectors, axis=0)), 0.0

"""Nearest points and contacts by cell lists, in open space, in orthorhombic boxes and in triclinic ones.

Space is cut in cells at least as wide as the distance looked for, so a point meets only points of its own cell and of those around it: an equal join on
frame and cell, whose pairs shrink to minima before they travel. Groups that have nobody near are looked for again with wider cells, so exact
distances come out for all, and the far ones cost no more than the pairs of the width at which they are found.

A triclinic box is reduced first (its vectors made as short as they get), which makes the nearest image one of the 27 around the rounded
one; cells are slices between lattice planes.
"""

from __future__ import annotations

import itertools
import math
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of one frame that are simply joined.
PAIRS = 20_000_000
#: By what cells widen from one search to the next.
WIDEN = 4.0


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder of the session, which a local session without one gets."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
    elif not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def lattice(box: list) -> np.ndarray:
    """Box vectors as rows, from lengths, from lengths and angles in degrees (alpha, beta, gamma), or from vectors."""
    b = np.asarray(box, float)
    if b.ndim == 2:
        return b
    if len(b) != 6:
        return np.diag(b)
    x, y, z = b[:3]
    ca, cb, cg = np.cos(np.radians(b[3:]))
    sg = math.sqrt(1 - cg * cg)
    if max(abs(ca), abs(cb), abs(cg)) < 1e-12:
        return np.diag(b[:3])
    cy = (ca - cb * cg) / sg
    return np.array([[x, 0, 0], [y * cg, y * sg, 0], [z * cb, z * cy, z * math.sqrt(1 - cb * cb - cy * cy)]])


def reduced(vectors: np.ndarray) -> np.ndarray:
    """A basis of the same lattice of the shortest vectors (Minkowski, by repeated exact reduction of the longest against the others)."""
    b = np.array(vectors, float)
    if abs(np.linalg.det(b)) < 1e-12:
        raise ValueError("the box has no volume")
    while True:
        b = b[np.argsort((b * b).sum(1), kind="stable")]
        best, size = b[-1], float(b[-1] @ b[-1])
        at = np.rint(np.linalg.lstsq(b[:-1].T, b[-1], rcond=None)[0]) if len(b) > 1 else np.zeros(0)
        for step in itertools.product((-1, 0, 1), repeat=len(b) - 1):
            candidate = b[-1] - (at + np.array(step)) @ b[:-1]
            if candidate @ candidate < size * (1 - 1e-12):
                best, size = candidate, float(candidate @ candidate)
        second = b[1] - np.rint(b[1] @ b[0] / (b[0] @ b[0])) * b[0] if len(b) > 2 else None
        if second is not None and second @ second < (b[1] @ b[1]) * (1 - 1e-12):
            b[1] = second
        elif best is b[-1] or np.array_equal(best, b[-1]):
            return b
        else:
            b[-1] = best


def image_distance2(delta: list[Column], box: np.ndarray | None) -> Column:
    """Squared length of a difference, or of its nearest image in a box of reduced vectors."""
    if box is None:
        return sum((d * d for d in delta), F.lit(0.0))
    inverse, dims = np.linalg.inv(box), range(len(box))
    if np.count_nonzero(box - np.diag(np.diag(box))) == 0:
        return sum(((d - float(box[k, k]) * F.rint(d / float(box[k, k]))) ** 2 for k, d in enumerate(delta)), F.lit(0.0))
    shares = [sum((delta[i] * float(inverse[i, k]) for i in dims), F.lit(0.0)) for k in dims]
    rest = F.array(*(s - F.rint(s) for s in shares))
    shifts = F.array(*(F.array(*map(float_lit, s)) for s in itertools.product((-1.0, 0.0, 1.0), repeat=len(box))))

    def square(f: Column, shift: Column) -> Column:
        return sum((sum(((F.get(f, F.lit(k)) + F.get(shift, F.lit(k))) * float(box[k, c]) for k in dims), F.lit(0.0)) ** 2 for c in dims), F.lit(0.0))

    return F.array_min(F.transform(shifts, lambda s: square(rest, s)))


def float_lit(x: float) -> Column:
    return F.lit(float(x))


class _Cells:
    """Cells at least `width` wide."""

    def __init__(self, width: float, dims: int, box: np.ndarray | None):
        self.width, self.box, self.dims = width, box, dims
        if box is not None:
            self.inverse = np.linalg.inv(box)
            planes = 1 / np.linalg.norm(self.inverse, axis=0)  # between lattice planes
            self.many = [max(1, int(p // width)) for p in planes]

    def whole(self, extent: float) -> bool:
        """Whether every two points are in neighbouring cells."""
        return max(self.many) <= 3 if self.box is not None else self.width >= extent

    def numbers(self, x: list[Column]) -> list[Column]:
        if self.box is None:
            return [F.floor(c / self.width) for c in x]
        shares = [sum((x[i] * float(self.inverse[i, k]) for i in range(self.dims)), F.lit(0.0)) for k in range(self.dims)]
        return [F.pmod(F.floor(s * n), F.lit(n)) for s, n in zip(shares, self.many, strict=True)]

    def own(self, x: list[Column]) -> Column:
        return F.array(*(c.cast("long") for c in self.numbers(x)))

    def around(self, x: list[Column]) -> Column:
        numbers = self.numbers(x)
        cells = []
        for shift in itertools.product((-1, 0, 1), repeat=self.dims):
            near = [c + s for c, s in zip(numbers, shift, strict=True)]
            if self.box is not None:
                near = [F.pmod(c, F.lit(n)) for c, n in zip(near, self.many, strict=True)]
            cells.append(F.array(*(c.cast("long") for c in near)))
        return F.array_distinct(F.array(*cells))


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str], cells: _Cells | None, box: np.ndarray | None, by: list[str]) -> DataFrame:
    """(by, d2): the nearest of `right` to each group of `left` among points of neighbouring cells, or among all of a frame."""
    a = left.select(*dict.fromkeys([*by, *keys]), *(F.col(c).cast("double").alias(f"a_{c}") for c in axes))
    b = right.select(*keys, *(F.col(c).cast("double").alias(f"b_{c}") for c in axes))
    if cells is not None:
        a = a.withColumn("_cell", cells.own([F.col(f"a_{c}") for c in axes]))
        b = b.withColumn("_cell", F.explode(cells.around([F.col(f"b_{c}") for c in axes])))
        keys = [*keys, "_cell"]
    pairs = a.join(b, keys) if keys else a.crossJoin(b)
    return pairs.groupBy(*by).agg(F.min(image_distance2([F.col(f"a_{c}") - F.col(f"b_{c}") for c in axes], box)).alias("d2"))


def contacts(a: DataFrame, b: DataFrame, frame: str, group: str, axes: list[str], cutoff: float, box: list | None = None, distances: bool = True) -> DataFrame:
    """(frame, group, min_distance, in_contact): the nearest of `b`'s points to each group of `a`'s in every frame, strictly below the cut-off.

    Without `distances`, only groups in contact have a row. A frame without points of `b` has none.
    """
    vectors = None if box is None else reduced(lattice(box))
    keys, by = [frame], [frame, group]

    def done(found: DataFrame) -> DataFrame:
        return found.select(*by, F.sqrt("d2").alias("min_distance")).withColumn("in_contact", F.col("min_distance") < cutoff)

    sizes = a.groupBy(frame).agg(F.count("*").alias("n")).join(b.groupBy(frame).agg(F.count("*").alias("m")), frame)
    if distances and (sizes.agg(F.max(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) <= PAIRS:
        return done(_nearest(a, b, keys, axes, None, vectors, by))
    extent = 0.0
    if box is None:
        ends = a.select(*axes).unionByName(b.select(*axes)).agg(*(F.max(c) - F.min(c) for c in axes)).first()
        extent = max((float(x) for x in ends if x is not None), default=0.0)
    width, todo, out = cutoff, a, None
    while True:
        cells = _Cells(width * (1 + 1e-9), len(axes), vectors)
        whole = cells.whole(extent)
        found = _nearest(todo, b, keys, axes, cells, vectors, by)
        found = found if whole and distances else found.where(F.col("d2") < width * width)
        if not distances:
            return done(found)
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        if whole:
            return done(out)
        todo = todo.join(found.select(*by), by, "left_anti")
        if todo.isEmpty():
            return done(out)
        width *= WIDEN


def within(atoms: DataFrame, of: DataFrame, distance: float, axes: list[str], key: list[str], frame: list[str] | None = None, box: list | None = None) -> DataFrame:
    """Keys of `atoms` at most `distance` from a point of `of` (in the same frame)."""
    vectors = None if box is None else reduced(lattice(box))
    cells = _Cells(distance * (1 + 1e-9), len(axes), vectors)
    found = _nearest(atoms, of, frame or [], axes, cells, vectors, key)
    return found.where(F.col("d2") <= distance * distance).select(*key)

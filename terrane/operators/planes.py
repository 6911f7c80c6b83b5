"""Bias of hills in two variables, in time that grows far slower than frames times hills.

Hills go by octaves of their widths. A plane is cut into tiles, four widths of an octave wide; a task holds a tile's frames and the hills that reach it, both in order
of time. Inside, cells are halved for as long as many frames lie in one (`field`). A hill that misses a cell is left out. In a cell that it covers, at most one width wide,
its Gaussian is a product of two polynomials, exact to the rounding of doubles: such products are added up in order of time, and a frame reads the sum so far (`_covered`).
Only hills whose end crosses a cell go on to its quarters, and meet frames one by one in the last. With cells that hold a given number of frames, those
are some square root of all pairs' share: work grows as frames plus hills to the power 1.5. The kernel is 0 where a hill ends, so rounding there is harmless.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.ranges import dealt
from terrane.operators.reweight import CUTOFF

#: Frames and hills of a tile that meet in one task, at most about.
FRAMES, HILLS = 250_000, 250_000
#: Frames that meet all hills at once, and those that meet the hills that end in their cell; pairs that are not worth a cell; halvings of a tile.
FEW, LEAF, PAIRS, DEEPEST = 48, 96, 60_000, 24
_TILE = 4
_SCALE = 1 / (1 - math.exp(-CUTOFF))
_CENTER, _SIGMA, _HEIGHT, _TIME = 0, 2, 4, 5


def _tiles(octave: int, period: float | None) -> tuple[float, int]:
    """The width of an octave's tiles, and how many a period has."""
    width = _TILE * 2.0**octave
    n = math.ceil(period / width) if period else 0
    return (period / n, n) if period else (width, 0)


@cache
def _nodes(half: float) -> tuple[np.ndarray, np.ndarray]:
    """Points in [-1, 1], enough for a Gaussian on a cell of so many widths to each side, and what turns Chebyshev polynomials into weights of theirs."""
    n = 3
    while 2 * (half / 2) ** n / math.sqrt(math.factorial(n)) > 1e-16:
        n += 1
    at = np.cos((np.arange(n) + 0.5) * np.pi / n)
    return at, np.polynomial.chebyshev.chebvander(at, n - 1).T * np.where(np.arange(n) > 0, 2 / n, 1 / n)[:, None]


def direct(p: np.ndarray, counted: np.ndarray, own: np.ndarray, periods: list[float | None] | None = None) -> np.ndarray:
    """Bias at each place from the first `counted` hills, which rises from place to place."""
    out, root = np.zeros(p.shape[1]), 1 / (math.sqrt(2) * own[_SIGMA : _SIGMA + 2])
    for a in range(0, len(out), 16):
        z = min(len(out), a + 16)
        most, sure = int(counted[z - 1]), int(counted[a])
        for b in range(0, most, 4096):
            e = min(most, b + 4096)
            half = 0.0
            for k in range(2):
                delta = p[k, a:z, None] - own[_CENTER + k, None, b:e]
                if periods and periods[k]:
                    delta -= periods[k] * np.rint(delta / periods[k])
                delta *= root[k, None, b:e]
                delta *= delta
                half = delta if k == 0 else half + delta
            np.exp(np.negative(half, out=half), out=half)
            half *= _SCALE
            half += 1 - _SCALE
            np.maximum(half, 0, out=half)  # positive just inside the cut-off
            if e > sure:
                half *= np.arange(b, e)[None, :] < counted[a:z, None]
            out[a:z] += half @ own[_HEIGHT, b:e]
    return out


def _covered(p: np.ndarray, counted: np.ndarray, own: np.ndarray, middle: tuple, width: tuple, base: tuple) -> np.ndarray:
    """Bias at each place of a cell from the first `counted` of hills that cover it."""
    n, m = p.shape[1], own.shape[1]
    (at, turn) = _nodes(max(w / b for w, b in zip(width, base, strict=True)) / 2)
    weights = [np.polynomial.chebyshev.chebvander(np.clip((p[k] - middle[k]) * 2 / width[k], -1, 1), len(at) - 1) @ turn for k in range(2)]
    level = np.concatenate([[0.0], np.cumsum(own[_HEIGHT])])
    out, sums, done = (1 - _SCALE) * level[counted], np.zeros((len(at), len(at))), 0
    some = int(min(max(math.sqrt(12_000 * n / m), 8), 512))  # frames that share a sum; they meet the hills between the first and the last of them

    def values(k: int, a: int, z: int) -> np.ndarray:
        x = (at[:, None] * (width[k] / 2) - (own[_CENTER + k, None, a:z] - middle[k])) / own[_SIGMA + k, None, a:z]
        return np.exp(-0.5 * x * x)

    for a in range(0, n, some):
        z = min(n, a + some)
        until, most = int(counted[a]), int(counted[z - 1])
        for b in range(done, until, 8192):
            e = min(until, b + 8192)
            sums += values(0, b, e) @ (values(1, b, e) * own[_HEIGHT, b:e]).T
        done = until
        got = ((weights[0][a:z] @ sums) * weights[1][a:z]).sum(1)
        if most > until:
            root = 1 / (math.sqrt(2) * own[_SIGMA : _SIGMA + 2, until:most])
            half = sum(((p[k, a:z, None] - own[_CENTER + k, None, until:most]) * root[k]) ** 2 for k in range(2))
            got += (np.exp(-half) * (np.arange(until, most)[None, :] < counted[a:z, None])) @ own[_HEIGHT, until:most]
        out[a:z] += _SCALE * got
    return out


def field(p: np.ndarray, t: np.ndarray, hills: np.ndarray, middle: tuple, width: tuple, base: tuple, periods: list[float | None]) -> np.ndarray:
    """Bias at places p of a tile at times t from earlier hills (rows: centers, sigmas, height, time); both are in order of time.

    Sigmas are at least `base` and less than twice that."""
    out = np.zeros(p.shape[1])
    todo = [(np.arange(len(out)), hills, middle, width, 0)]
    while todo:
        who, own, mid, w, depth = todo.pop()
        own = own[:, : np.searchsorted(own[_TIME], t[who[-1]], "left")]
        nearest, farthest, turns, bent = 0.0, 0.0, [], np.zeros(own.shape[1], bool)
        for k, period in enumerate(periods):
            delta = mid[k] - own[_CENTER + k]
            turns.append(period * np.rint(delta / period) if period else None)
            size = np.abs(delta - turns[k] if period else delta)
            nearest = nearest + (np.maximum(size - w[k] / 2, 0) / own[_SIGMA + k]) ** 2
            farthest = farthest + ((size + w[k] / 2) / own[_SIGMA + k]) ** 2
            if period:  # the other side of the hill is nearer in a part of the cell
                bent |= size + w[k] / 2 > period / 2
        within = np.flatnonzero(nearest < 2 * CUTOFF)
        if not len(within):
            continue
        own, bent = own[:, within], bent[within]
        covers = (farthest[within] < 2 * CUTOFF) & ~bent
        for k, turn in enumerate(turns):
            if turn is not None:
                own[_CENTER + k] += turn[within]
        folds = periods if bent.any() else None
        place, n = p[:, who], len(who)
        counted = lambda h: np.searchsorted(h[_TIME], t[who], "left")  # noqa: B023, E731
        if n <= FEW or n * own.shape[1] <= PAIRS:
            out[who] += direct(place, counted(own), own, folds)
            continue
        if all(x <= b for x, b in zip(w, base, strict=True)) and covers.any():
            cover, own = own[:, covers], own[:, ~covers]
            out[who] += _covered(place, counted(cover), cover, mid, w, base)
        if n <= LEAF or n * own.shape[1] <= PAIRS or depth >= DEEPEST:
            if own.shape[1]:
                out[who] += direct(place, counted(own), own, folds)
            continue
        right, up = place[0] >= mid[0], place[1] >= mid[1]
        for x in (False, True):
            for y in (False, True):
                part = who[(right == x) & (up == y)]
                if len(part):
                    todo.append((part, own, tuple(m + (s - 0.5) * v / 2 for m, s, v in zip(mid, (x, y), w, strict=True)), tuple(v / 2 for v in w), depth + 1))
    return out


def _tile(x: Column, width: float, n: int) -> Column:
    at = F.rint(x / width - 0.5) + F.lit(0.0)  # a double, since places may lie beyond whole numbers; no -0.0
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(n - 1.0)) if n else at


def _reached(c: Column, reach: Column, width: float, n: int) -> Column:
    """The tiles that a hill reaches in one variable."""
    low, high = (F.rint(x / width - 0.5) + F.lit(0.0) for x in (c - reach, c + reach))
    some = F.transform(F.sequence(F.lit(0), (F.least(high - low, F.lit(n - 1.0)) if n else high - low).cast("int")), lambda k: low + k)
    return F.array_distinct(F.transform(some, lambda k: F.pmod(k, F.lit(float(n))) + F.lit(0.0)) if n else some)


def bias(frames: DataFrame, hills: DataFrame, key: str, x: list[str], time: str | None, periods: list[float | None], centers: list[str], sigmas: list[str]) -> DataFrame:
    """(key, bias) of every frame from the hills strictly before its time (from all without one); see `hills.bias`."""
    kind = dict(frames.dtypes)[key]
    number = lambda c: F.col(c).cast("double")
    finite = lambda c: F.abs(c) < float("inf")
    home = lambda c, k: F.pmod(number(c), F.lit(float(periods[k]))) if periods[k] else number(c)
    here = frames.select(F.col(key).alias("k"), *(home(x[k], k).alias(f"p{k}") for k in range(2)), (number(time) if time else F.lit(0.0)).alias("t"))
    here = here.where(finite("p0") & finite("p1") & F.col("t").isNotNull() & ~F.isnan("t"))
    there = hills.select(*(home(centers[k], k).alias(f"c{k}") for k in range(2)), *(F.abs(number(sigmas[k])).alias(f"s{k}") for k in range(2)), number("height").alias("h"), (number("hill_time") if time else F.lit(-1.0)).alias("t"))
    there = there.where(" and ".join(f"s{k} > 0 and s{k} < double('infinity') and abs(c{k}) < double('infinity')" for k in range(2)) + " and h is not null and t is not null and not isnan(t)")
    octave = lambda k: F.floor(F.log2(f"s{k}")).cast("int")
    octaves = sorted(tuple(r) for r in there.select(octave(0), octave(1)).distinct().collect())  # a few
    if not octaves:
        return frames.select(key, F.lit(0.0).alias("bias"))
    struct = lambda o, a, b: F.struct(F.lit(o[0]).alias("o0"), F.lit(o[1]).alias("o1"), a.alias("a"), b.alias("b"))
    at = F.array(*(struct(o, *(_tile(F.col(f"p{k}"), *_tiles(o[k], periods[k])) for k in range(2))) for o in octaves))
    here = here.select("k", "p0", "p1", "t", F.inline(at))
    limit, reached = math.sqrt(2 * CUTOFF), None
    for o in octaves:
        both = [_reached(F.col(f"c{k}"), limit * F.col(f"s{k}"), *_tiles(o[k], periods[k])) for k in range(2)]
        tiles = F.flatten(F.transform(both[0], lambda a: F.transform(both[1], lambda b: struct(o, a, b))))  # noqa: B023
        same = (octave(0) == o[0]) & (octave(1) == o[1])
        reached = F.when(same, tiles) if reached is None else reached.when(same, tiles)
    there = there.select("c0", "c1", "s0", "s1", "h", "t", F.inline(reached))
    tile = ["o0", "o1", "a", "b"]
    sizes = here.groupBy(*tile).agg(F.count("*").alias("n")).join(there.groupBy(*tile).agg(F.count("*").alias("m")), tile)
    sizes = sizes.select(*tile, F.ceil(F.col("n") / FRAMES).cast("int").alias("fb"), F.ceil(F.col("m") / HILLS).cast("int").alias("hb"))
    share = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    here = here.join(sizes, tile).withColumn("i", share("fb", "k")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
    there = there.join(sizes, tile).withColumn("j", share("hb", "c0", "c1", "t", "h")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fb") - 1)))

    def run(rows: pa.Table, hill: pa.Table) -> pa.Table:
        if not rows.num_rows or not hill.num_rows:
            return pa.table({"k": rows.column("k"), "v": pa.array(np.zeros(rows.num_rows))})
        p, t = np.stack([rows.column(c).to_numpy() for c in ("p0", "p1")]), rows.column("t").to_numpy()
        own = np.stack([hill.column(c).to_numpy() for c in ("c0", "c1", "s0", "s1", "h", "t")])
        o, place = ([rows.column(c)[0].as_py() for c in cs] for cs in (("o0", "o1"), ("a", "b")))
        width = tuple(_tiles(o[k], periods[k])[0] for k in range(2))
        late, order = np.argsort(t, kind="stable"), np.argsort(own[_TIME], kind="stable")
        v = np.empty(len(t))
        v[late] = field(p[:, late], t[late], own[:, order], tuple((a + 0.5) * w for a, w in zip(place, width, strict=True)), width, tuple(2.0**k for k in o), periods)
        return pa.table({"k": rows.column("k"), "v": v})

    by = [*tile, "i", "j"]
    here, there = dealt(here.select(*by, "k", "p0", "p1", "t"), *by), dealt(there.select(*by, "c0", "c1", "s0", "s1", "h", "t"), *by)
    sums = here.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(run, f"k {kind}, v double")
    sums = sums.groupBy("k").agg(F.sum("v").alias("bias")).withColumnRenamed("k", key)
    return frames.select(key).join(sums, key, "left").fillna(0.0, ["bias"])

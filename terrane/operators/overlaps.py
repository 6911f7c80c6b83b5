"""Convergence of modes: overlaps of halves, of leading parts with the whole, and of replicates, from one pass of moments.

Every replicate is cut where a half or a leading part ends; moments of the pieces are merged to those of any part, so frames are read once, whatever the number of parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import decompose

FRACTIONS = (0.25, 0.5, 0.75, 1.0)


def pieces(df: DataFrame, vector: str, replicate: str, order: list[str], fractions: tuple[float, ...] = FRACTIONS) -> dict:
    """{(replicate, first, last): moments} of the pieces between cuts, and {replicate: frames}. Of n frames the first half is n // 2, a part of f the nearest to n f, at least two."""
    w = Window.partitionBy(replicate)
    n = F.count("*").over(w)
    ends = F.array_sort(F.array_distinct(F.array(F.floor(n / 2), *(F.least(n, F.greatest(F.lit(2), F.bround(n * f))).cast("long") for f in fractions))))
    rows = df.where(F.col(vector).isNotNull()).select(replicate, vector, (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), n.alias("_n"), ends.alias("_ends"))
    at = F.size(F.filter("_ends", lambda e: e <= F.col("_i")))
    first = F.when(at > 0, F.get(F.col("_ends"), at - 1)).otherwise(F.lit(0).cast("long"))
    last = F.coalesce(F.get(F.col("_ends"), at), F.col("_n"))
    keyed = rows.select(F.to_json(F.struct(F.col(replicate).alias("r"), first.alias("a"), last.alias("z"), F.col("_n").alias("n"))).alias("_key"), vector)
    import json

    found, sizes = {}, {}
    for key, m in decompose.collected(decompose.moments(keyed, vector, "_key"), "_key").items():
        k = json.loads(key)
        found[k.get("r"), k["a"], k["z"]] = m
        sizes[k.get("r")] = k["n"]
    return {"moments": found, "frames": sizes}


def _part(found: dict, start: dict, stop: dict) -> dict:
    """Moments by replicate of the frames from start to stop, where each has any."""
    out: dict = {}
    for (r, a, z), m in found["moments"].items():
        if r in start and start[r] <= a and z <= stop[r]:
            out[r] = decompose.merged(out[r], m) if r in out else m
    return out


def _modes(states: dict, k: int, weighting: str) -> np.ndarray:
    return decompose.eigen(decompose.covariance(states, weighting)[1], k)[2]


def convergence(df: DataFrame, vector: str, replicate: str, order: list[str], k: int = 10, fractions: tuple[float, ...] = FRACTIONS, weighting: str = "equal-replicate") -> dict[str, list[tuple]]:
    """halves: (replicate, overlap), the pooled one first, under no name, replicates of four frames or more; progressive: (fraction, overlap) with all frames;
    pairs: (replicate, replicate, overlap)."""
    found = pieces(df, vector, replicate, order, fractions)
    n = found["frames"]
    names = sorted(n, key=lambda r: (r is not None, str(r)))
    zero = dict.fromkeys(n, 0)
    long = {r: c for r, c in n.items() if c >= 4}
    halves: list[tuple] = []
    if long:
        a = _part(found, dict.fromkeys(long, 0), {r: c // 2 for r, c in long.items()})
        b = _part(found, {r: c // 2 for r, c in long.items()}, long)
        halves.append((None, decompose.rmsip(_modes(a, k, weighting), _modes(b, k, weighting))))
        halves += [(r, decompose.rmsip(_modes({r: a[r]}, k, weighting), _modes({r: b[r]}, k, weighting))) for r in names if r in long]
    each = _part(found, zero, n)
    whole = _modes(each, k, weighting)
    progressive = []
    for f in fractions:
        stop = {r: min(c, max(2, round(c * f))) for r, c in n.items()}
        progressive.append((f, decompose.rmsip(_modes(_part(found, zero, stop), k, weighting), whole)))
    own = {r: _modes({r: each[r]}, k, weighting) for r in names}
    pairs = [(a, b, decompose.rmsip(own[a], own[b])) for i, a in enumerate(names) for b in names[i + 1 :]]
    return {"halves": halves, "progressive": progressive, "pairs": pairs}

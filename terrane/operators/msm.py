"""Markov state models: clustering and lagged counts on the cluster, estimation on the driver.

Assignments and counts are joins and aggregations over frames; what reaches the driver is a count matrix of as many rows as there are microstates.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import ranges
from terrane.operators.decompose import squared_distance, timescales


def nearest_center(df: DataFrame, vector: Column, centers: list[list[float]], name: str = "microstate") -> DataFrame:
    """`df` with the index of the nearest centre, the first on ties. Centres are few and become literals."""
    at = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centers))
    d = F.transform(at, lambda c: squared_distance(vector, c))
    return df.withColumn("_d", d).withColumn(name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def lloyd(df: DataFrame, columns: list[str], centers: list[list[float]]) -> DataFrame:
    """One step of k-means: (microstate, n, new coordinates)."""
    vector = F.array(*(F.col(c).cast("double") for c in columns))
    return nearest_center(df, vector, centers).groupBy("microstate").agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(c) for c in columns))


def lagged_counts(df: DataFrame, replicate: str, order: list[str], state: str, lags: list[int], sliding: bool = True, rows_each: int | None = None) -> DataFrame:
    """(lag, i, j, c): pairs `lag` frames apart within a replicate for all lags in one sorted pass; negative labels take no part. Without
    `sliding`, only every lag-th frame starts a pair. With `rows_each`, replicates of more frames than that are cut in ranges with halos."""
    if rows_each:
        ahead = ranges.lagged(df.select(replicate, *order, state), [replicate], order, state, lags, rows_each)
        rows = ahead.select(F.col(state).alias("i"), F.col("_ordinal").alias("rn"), F.array(*(F.struct(F.lit(t).alias("lag"), F.col("_ahead")[k].alias("j")) for k, t in enumerate(lags))).alias("p"))
    else:
        w = Window.partitionBy(replicate).orderBy(*order)
        rows = df.select(F.col(state).alias("i"), (F.row_number().over(w) - 1).alias("rn"), F.array(*(F.struct(F.lit(t).alias("lag"), F.lead(state, t).over(w).alias("j")) for t in lags)).alias("p"))
    out = rows.select("i", "rn", F.explode("p").alias("p")).select("p.lag", "i", "p.j", "rn").where("j is not null")
    if dict(df.dtypes)[state] != "string":
        out = out.where("i >= 0 and j >= 0")
    if not sliding:
        out = out.where(F.col("rn") % F.col("lag") == 0)
    return out.groupBy("lag", "i", "j").agg(F.count("*").alias("c"))


def matrix(counts: pd.DataFrame, labels: list) -> np.ndarray:
    at = {v: k for k, v in enumerate(labels)}
    c = np.zeros((len(labels), len(labels)))
    for i, j, n in counts[["i", "j", "c"]].itertuples(index=False):
        c[at[i], at[j]] = n
    return c


def connected(counts: np.ndarray) -> list[list[int]]:
    """Strongly connected sets: most counts first, then largest, then lowest index."""
    n = len(counts)
    reach = (counts > 0) | np.eye(n, dtype=bool)
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    both = reach & reach.T
    sets = list({tuple(np.flatnonzero(r)): None for r in both})
    return [list(s) for s in sorted(sets, key=lambda s: (-counts[np.ix_(s, s)].sum(), -len(s), s[0]))]


def row_stochastic(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1)
    if (total == 0).any():
        raise ValueError("a state has no way out")
    return counts / total[:, None]


def reversible(counts: np.ndarray, tolerance: float = 1e-12, most: int = 1_000_000) -> np.ndarray:
    """Maximum-likelihood reversible matrix by fixed-point iteration."""
    both, total = counts + counts.T, counts.sum(1)
    if not both.sum() > 0:
        raise ValueError("no transitions at this lag")
    x = both / both.sum()
    for _ in range(most):
        q = total / x.sum(1)
        new = both / (q[:, None] + q[None, :])
        new /= new.sum()
        change = np.abs(new / new.sum(1)[:, None] - x / x.sum(1)[:, None]).max()
        x = new
        if change < tolerance:
            break
    else:
        warnings.warn(f"the reversible matrix still changed by {change:.1e} after {most} steps", stacklevel=2)
    return x / x.sum(1)[:, None]


def stationary(t: np.ndarray) -> np.ndarray:
    n = len(t)
    a = np.vstack([t.T - np.eye(n), np.ones(n)])
    pi = np.clip(np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0], 0, None)
    return pi / pi.sum()


def is_reversible(t: np.ndarray, pi: np.ndarray, tolerance: float = 1e-8) -> bool:
    flow = pi[:, None] * t
    return bool(np.abs(flow - flow.T).max() < tolerance)


def eigensystem(t: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and right eigenvectors; by the symmetric form when the matrix is reversible."""
    if is_reversible(t, pi) and (pi > 0).all():
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh(root[:, None] * t / root[None, :])
        vectors = vectors / root[:, None]
    else:
        values, vectors = np.linalg.eig(t)
        values, vectors = values.real, vectors.real
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return values[order], vectors * np.where(vectors.sum(0) < 0, -1.0, 1.0)


def estimate(counts: np.ndarray, lag: int, dt: float = 1.0, reversible_: bool = True) -> dict:
    active = connected(counts)[0]
    c = counts[np.ix_(active, active)]
    t = reversible(c) if reversible_ else row_stochastic(c)
    pi = stationary(t)
    values, right = eigensystem(t, pi)
    return {"active": active, "counts": c, "T": t, "pi": pi, "eigenvalues": values, "right": right, "timescales": timescales(values[1:], lag * dt), "lag": lag}


def plateau(lags: list[int], scales: list[np.ndarray], least: float = 0.1) -> int | None:
    """The first lag after which the resolved timescales change by less than `least` to the next."""
    for a, b, lag in zip(scales, scales[1:], lags, strict=False):
        k = min(len(a), len(b))
        with np.errstate(invalid="ignore", divide="ignore"):
            change = np.abs(b[:k] - a[:k]) / np.abs(a[:k])
        change = change[np.isfinite(change) & (b[:k] > lag)]
        if len(change) and change.max() < least:
            return lag
    return None


def scan(counts: pd.DataFrame, lags: list[int], n: int, dt: float = 1.0, reversible_: bool = True) -> tuple[pd.DataFrame, int | None]:
    """Implied timescales (lag, mode, timescale, active) at every lag that has an estimate, and the lag at which they stop changing; lags without one are left out."""
    rows, kept, scales = [], [], []
    for lag in lags:
        try:
            e = estimate(matrix(counts[counts.lag == lag], list(range(n))), lag, dt, reversible_)
        except (ValueError, IndexError, np.linalg.LinAlgError):
            continue
        kept.append(lag)
        scales.append(e["timescales"] / dt)
        rows += [(lag, k + 1, float(x), len(e["active"])) for k, x in enumerate(e["timescales"])]
    return pd.DataFrame(rows, columns=["lag", "mode", "timescale", "active"]), plateau(kept, scales)


def pcca(t: np.ndarray, m: int, rounds: int = 2000) -> np.ndarray:
    """Memberships of m metastable sets by the inner simplex of the slow eigenvectors, improved by Nelder-Mead."""
    n = len(t)
    if m == n:
        return np.eye(n)
    if len(connected(t)) > 1:
        raise ValueError("the matrix is reducible")
    pi = stationary(t)
    x = eigensystem(t, pi)[1][:, :m].copy()
    x[:, 0] = 1.0
    corners = [int(np.argmax((x**2).sum(1)))]
    rest = x - x[corners[0]]
    for _ in range(1, m):
        corners.append(int(np.argmax((rest**2).sum(1))))
        axis = rest[corners[-1]] / np.linalg.norm(rest[corners[-1]])
        rest = rest - np.outer(rest @ axis, axis)
    a = np.linalg.inv(x[corners])

    def feasible(free: np.ndarray) -> np.ndarray:
        full = np.zeros((m, m))
        full[1:, 1:] = free.reshape(m - 1, m - 1)
        full[1:, 0] = -full[1:, 1:].sum(1)
        full[0] = -(x[:, 1:] @ full[1:]).min(0)
        return full / full[0].sum()

    def cost(free: np.ndarray) -> float:
        full = feasible(free)
        return float(-sum((full[:, j] ** 2).sum() / full[0, j] for j in range(m) if full[0, j] > 0)) if (full[0] > 0).all() else 0.0

    best = nelder_mead(cost, a[1:, 1:].ravel(), rounds * max(1, (m - 1) * m)) if m > 1 else a[1:, 1:].ravel()
    chi = np.clip(x @ feasible(best), 0, None)
    return chi / chi.sum(1)[:, None]


def nelder_mead(f, x0: np.ndarray, most: int, xtol: float = 1e-8, ftol: float = 1e-10) -> np.ndarray:
    """Simplex minimisation with the usual coefficients."""
    n = len(x0)
    points = [np.array(x0, float)] + [np.array(x0, float) for _ in range(n)]
    for i in range(n):
        points[i + 1][i] = points[i + 1][i] * 1.05 if points[i + 1][i] else 0.00025
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= xtol and max(abs(v - values[0]) for v in values[1:]) <= ftol:
            break
        mid = np.mean(points[:-1], axis=0)
        r = mid + (mid - points[-1])
        fr = f(r)
        if fr < values[0]:
            e = mid + 2 * (mid - points[-1])
            fe = f(e)
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < values[-1] else points[-1]) - mid)
            fc = f(c)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def coarse_grained(t: np.ndarray, chi: np.ndarray, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and stationary distribution between metastable sets: the projection (chi' chi)^-1 chi' T chi, whose fluxes are made symmetric."""
    pi = stationary(t) if pi is None else pi
    flux = (chi.T @ pi)[:, None] * np.linalg.solve(chi.T @ chi, chi.T @ t @ chi)
    flux = (flux + flux.T) / 2
    return flux / flux.sum(1, keepdims=True), flux.sum(1)


def coarse(t: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Transition matrix between metastable sets."""
    return coarse_grained(t, chi)[0]


def chapman_kolmogorov(counts_at: dict[int, np.ndarray], lag: int, sets: np.ndarray, k_max: int = 5, reversible_: bool = True) -> pd.DataFrame:
    """T(lag)**k against T(k lag) between sets of microstates, with a tolerance of three standard errors or 0.05."""
    base = estimate(counts_at[lag], lag, reversible_=reversible_)
    names = [int(s) for s in np.unique(sets[base["active"]])]
    rows = []
    for k in range(1, k_max + 1):
        if k * lag not in counts_at:
            continue
        direct = estimate(counts_at[k * lag], k * lag, reversible_=reversible_)
        power = np.linalg.matrix_power(base["T"], k)
        for a in names:
            for b in names:
                def prob(t, pi, active):
                    i, j = np.flatnonzero(sets[active] == a), np.flatnonzero(sets[active] == b)
                    w = pi[i]
                    return float((w @ t[np.ix_(i, j)].sum(1)) / w.sum()) if len(i) and w.sum() > 0 else float("nan")

                predicted, found = prob(power, base["pi"], base["active"]), prob(direct["T"], direct["pi"], direct["active"])
                n = direct["counts"][sets[direct["active"]] == a].sum()
                se = float(np.sqrt(max(found * (1 - found), 0) / max(n / (k * lag), 1)))
                rows.append((k, k * lag, a, b, predicted, found, se, abs(predicted - found), abs(predicted - found) <= max(0.05, 3 * se)))
    return pd.DataFrame(rows, columns=["k", "lag_frames", "from_set", "to_set", "predicted", "estimated", "estimated_se", "abs_deviation", "within_tolerance"])


def passage_times(t: np.ndarray, pi: np.ndarray, sets: np.ndarray, lag: float = 1.0) -> np.ndarray:
    """Mean first passage times between sets, averaged over each origin with the stationary distribution."""
    names = np.unique(sets)
    out = np.zeros((len(names), len(names)))
    for y, b in enumerate(names):
        away = np.flatnonzero(sets != b)
        hit = np.zeros(len(t))
        hit[away] = np.linalg.solve(np.eye(len(away)) - t[np.ix_(away, away)], np.full(len(away), lag)) if len(away) else 0
        for x, a in enumerate(names):
            i = sets == a
            out[x, y] = (pi[i] @ hit[i]) / pi[i].sum() if x != y else 0.0
    return out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, fraction of the row, best): overlap of two labellings."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    w = Window.partitionBy(a)
    n = n.withColumn("fraction", F.col("n") / F.sum("n").over(w))
    return n.withColumn("best", F.row_number().over(w.orderBy(F.desc("n"), b)) == 1)

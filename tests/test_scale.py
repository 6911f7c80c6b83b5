"""Operators that split what one task or the driver cannot hold: moments, modes of many dimensions, hills, long series."""

import hashlib
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import decompose, fields, hills, joins, kinetics, msm, planes, ranges, resample, reweight, wide


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 130)) * np.linspace(3, 0.1, 130)
    return x, spark.createDataFrame([(i, i % 3, row.tolist()) for i, row in enumerate(x)], "id long, rep long, v array<double>")


def test_moments_merge_in_strips_and_by_neighbours(spark, frames, monkeypatch):
    x, df = frames
    seen = []
    fold = decompose._folded

    def counted(states, by, schema):
        seen.append(states.groupBy(by, "strip", "part").count().agg(F.max("count"), F.count("*")).first())
        return fold(states, by, schema)

    monkeypatch.setattr(decompose, "_folded", counted)
    one = df.repartition(64).withColumn("all", F.lit(1))
    n, mean, m2 = decompose.collected(decompose.moments(one, "v", "all"), "all")[1]
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(m2, 500 * np.cov(x.T, bias=True))
    assert seen[0][0] <= decompose.NEIGHBOURS and seen[0][1] >= 2 * 3  # two groups of neighbours for each of three strips
    assert seen[1][0] == 2
    by = decompose.collected(decompose.moments(df.repartition(5), "v", "rep"), "rep")
    for k in range(3):
        assert by[k][0] == len(x[k::3]) and np.allclose(by[k][2], len(x[k::3]) * np.cov(x[k::3].T, bias=True))


def test_moments_send_early_when_much_is_held(frames, monkeypatch):
    x, df = frames
    keyed = df.withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id") % 7)).repartition(2)
    states = decompose.collected(decompose.moments(keyed, "v", "k"), "k")
    assert set(states) == {None, 1, 2, 3, 4, 5, 6} and np.allclose(states[None][2], len(x[::7]) * np.cov(x[::7].T, bias=True))
    halves = decompose.moments(keyed.where("id < 250"), "v", "k").unionByName(decompose.moments(keyed.where("id >= 250"), "v", "k"))
    again = decompose.collected(decompose.merged_tables(halves, "k"), "k")
    assert all(np.allclose(again[k][2], states[k][2]) for k in states)


def test_covariances_without_the_driver(frames):
    x, df = frames
    cov = np.cov(x.T, bias=True)
    rows = decompose.entries(decompose.moments(df.withColumn("one", F.lit(0)), "v", "one"), "one").where("i in (0, 64, 129)").collect()
    assert len(rows) == 3 * 130 and all(abs(r["c"] - cov[r["i"], r["j"]]) < 1e-9 for r in rows)


def test_modes_of_many_dimensions_as_dense(frames):
    x, df = frames
    dense = decompose.pca(df, "v", "rep", 10)
    for how in ({}, {"block": 4}):
        some = wide.pca(df.repartition(6), "v", "rep", 10, **how)
        assert np.allclose(some["eigenvalues"], dense["eigenvalues"], rtol=1e-8)
        assert np.abs((some["vectors"] * dense["vectors"]).sum(0)).min() > 1 - 1e-7 and np.allclose(some["explained"], dense["explained"])


def test_embeddings_as_dense(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null")
    dense, some = decompose.pca(v, "embedding", "label", 10), wide.pca(v, "embedding", "label", 10)
    assert np.allclose(some["eigenvalues"], dense["eigenvalues"], rtol=1e-8)


def test_more_dimensions_than_a_matrix_may_have(spark):
    rng = np.random.default_rng(0)
    d, n = decompose.MOST_DIMENSIONS + 900, 60
    x = (rng.standard_normal((n, 8)) * np.array([9, 7, 5, 4, 3, 2, 1.5, 1])) @ rng.standard_normal((8, d)) + 0.01 * rng.standard_normal((n, d)) + 5
    df = spark.createDataFrame([(i, i % 2, row.tolist()) for i, row in enumerate(x)], "id long, rep long, v array<double>").repartition(3)
    values = np.linalg.svd((x - x.mean(0)) / np.sqrt(n), compute_uv=False)[:6] ** 2
    for key in (None, "id"):  # by range finding, and by the Gram matrix of the rows
        p = wide.pca(df, "v", "rep", 6, key=key)
        assert np.allclose(p["eigenvalues"], values, rtol=1e-8) and p["vectors"].shape == (d, 6)
        assert np.allclose(p["trace"], ((x - x.mean(0)) ** 2).sum() / n)
        assert np.allclose(p["vectors"].T @ p["vectors"], np.eye(6), atol=1e-8)
    with pytest.raises(Exception, match="wide.pca"):
        decompose.moments(df, "v", "rep").count()


def plain_bias(f, h, periods, time=True):
    out = []
    for x, t in f:
        d = np.array([c for c, _, _, _ in h]) - x
        for k, p in enumerate(periods):
            if p:
                d[:, k] -= p * np.round(d[:, k] / p)
        q = 0.5 * ((d / np.array([s for _, s, _, _ in h])) ** 2).sum(1)
        v = np.array([a for _, _, a, _ in h]) * reweight.hill_kernel(q)
        out.append(v[np.array([u for _, _, _, u in h]) < t].sum() if time else v.sum())
    return np.array(out)


@pytest.mark.parametrize("periods", [[None, None], [None, 6.0], [4.0, None, 2.0]])
@pytest.mark.parametrize("blocks", [7])
def test_hills_in_several_variables(spark, periods, blocks, monkeypatch):
    monkeypatch.setattr(hills, "FRAMES", blocks)
    monkeypatch.setattr(hills, "HILLS", blocks)
    rng, d = np.random.default_rng(3), len(periods)
    f = [(rng.uniform(-5, 5, d) if i % 4 else np.full(d, 0.25), float(rng.integers(0, 50))) for i in range(90)]
    h = [(rng.uniform(-5, 5, d) if i % 3 else np.full(d, 0.2), rng.uniform(0.2, 0.5, d), float(rng.uniform(0.5, 2)), float(rng.integers(0, 50))) for i in range(80)]
    names = [f"x{k}" for k in range(d)]
    frames = spark.createDataFrame([(i, *map(float, x), t) for i, (x, t) in enumerate(f)], f"id long, {', '.join(f'{n} double' for n in names)}, t double")
    table = spark.createDataFrame([(*map(float, c), *map(float, s), a, t) for c, s, a, t in h], ", ".join([*(f"c{k} double" for k in range(d)), *(f"s{k} double" for k in range(d)), "height double, hill_time double"]))
    for time in ("t", None):
        got = hills.bias(frames, table, "id", names, time, periods, [f"c{k}" for k in range(d)], [f"s{k}" for k in range(d)]).orderBy("id").collect()
        assert np.allclose([r["bias"] for r in got], plain_bias(f, h, periods, bool(time)), atol=1e-9)
    none = hills.bias(frames, table.limit(0), "id", names, "t", periods, [f"c{k}" for k in range(d)], [f"s{k}" for k in range(d)]).collect()
    assert len(none) == 90 and all(r["bias"] == 0 for r in none)


@pytest.mark.parametrize("period", [None, 6.0, 0.7])
def test_hills_in_one_variable(spark, period, monkeypatch):
    """Blocks of a few rows, equal times and places, hills wider than the period, nulls."""
    monkeypatch.setattr(fields, "BLOCK", 16)
    rng = np.random.default_rng(4)
    f = [(np.array([round(rng.uniform(-5, 5), 1)]), float(rng.integers(0, 60))) for i in range(150)]
    h = [(np.array([round(rng.uniform(-5, 5), 1)]), np.array([[0.2, 0.5, 0.55, 3.0][i % 4]]), float(rng.uniform(0.5, 2)), float(rng.integers(0, 60))) for i in range(170)]
    frames = spark.createDataFrame([*((i, float(x[0]), t) for i, (x, t) in enumerate(f)), (150, None, 3.0), (151, 1.0, None)], "id long, x double, t double")
    table = spark.createDataFrame([*((float(c[0]), float(s[0]), a, t) for c, s, a, t in h), (None, 1.0, 1.0, 1.0), (1.0, 1.0, None, 1.0)], "center double, sigma double, height double, hill_time double")
    for time in ("t", None):
        got = [r["bias"] for r in reweight.bias_by_join(frames, table, "id", "x", time, period).orderBy("id").collect()]
        assert np.allclose(got[:150], plain_bias(f, h, [period], bool(time)), atol=1e-10)
        assert got[150] == 0 and len(got) == 152


def test_hills_in_one_place_are_not_paired(spark):
    """Views and hills by turns in one place: 2e10 pairs before their time, which would take minutes."""
    n = 200_000
    frames, table = spark.range(n).selectExpr("id", "0.3 AS x", "2 * id AS t"), spark.range(n).selectExpr("0.3 AS center", "1.0 AS sigma", "1.0 AS height", "2 * id + 1 AS hill_time")
    got = reweight.bias_by_join(frames, table, "id", "x", "t").agg(F.max(F.abs(F.col("bias") - F.col("id"))), F.count("*")).first()
    assert got[0] < 1e-6 and got[1] == n


def test_hills_in_two_variables_in_tiles(spark, monkeypatch):
    """Tiles dealt in blocks, widths of several octaves, equal times, hills wider than the period, nulls, what is not finite."""
    monkeypatch.setattr(planes, "FRAMES", 11)
    monkeypatch.setattr(planes, "HILLS", 9)
    rng = np.random.default_rng(6)
    f = [(rng.uniform(-9, 9, 2).round(1), float(rng.integers(0, 40))) for i in range(120)]
    h = [(rng.uniform(-9, 9, 2).round(1), np.array([[0.3, 0.5, 1.9, 4.0][i % 4], [0.4, 2.0, 0.7][i % 3]]), float(rng.uniform(0.5, 2)), float(rng.integers(0, 40))) for i in range(110)]
    bad = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (1e300, 1.0)]
    frames = spark.createDataFrame([*((i, *map(float, x), t) for i, (x, t) in enumerate(f)), *((200 + i, x, y, 50.0) for i, (x, y) in enumerate(bad)), (210, 1.0, 1.0, None)], "id long, x double, y double, t double")
    for periods in ([None, None], [None, 5.0], [7.0, 1.5]):
        for time in ("t", None):
            table = spark.createDataFrame([*((*map(float, c), *map(float, s), a, t) for c, s, a, t in h), (1.0, None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, None, 1.0), *([(1.0, 1.0, 1.0, 1.0, 1.0, None)] if time else []), (1e300, 1.0, 0.5, 0.5, 2.5, 1.0)], "c1 double, c2 double, s1 double, s2 double, height double, hill_time double")
            got = {r["id"]: r["bias"] for r in hills.bias(frames, table, "id", ["x", "y"], time, periods, ["c1", "c2"], ["s1", "s2"]).collect()}
            if not periods[0]:  # what 1e300 is within a period is rounding only
                assert np.allclose([got[i] for i in range(120)], plain_bias(f, h, periods, bool(time)), atol=1e-10) and got[203] == pytest.approx(2.5)
            else:
                alone = {r["id"]: r["bias"] for r in hills.bias(frames, table.where("c1 < 1e10"), "id", ["x", "y"], time, periods, ["c1", "c2"], ["s1", "s2"]).collect()}
                assert np.allclose([alone[i] for i in range(120)], plain_bias(f, h, periods, bool(time)), atol=1e-10)
            assert len(got) == 125 and got[200] == got[201] == got[202] == 0 and (not time or got[210] == 0)


@pytest.mark.parametrize("period", [None, 24.0, 1.8])
def test_hills_in_two_variables_meet_few_frames(period, monkeypatch):
    """Results of a tile against every pair, and pairs that grow more slowly than frames times hills."""
    rng, direct, met = np.random.default_rng(2), planes.direct, []
    for few in (4, planes.FEW):
        monkeypatch.setattr(planes, "FEW", few)
        monkeypatch.setattr(planes, "PAIRS", 1000 * few)
        pairs = []
        for n in (2000, 8000):
            p = np.stack([rng.uniform(0, 4, n), rng.uniform(0, period if period and period < 2 else 2, n)])
            own = np.stack([rng.uniform(-5, 9, n), rng.uniform(-3, 5, n), rng.uniform(1, 2, n), rng.uniform(0.5, 1, n), rng.uniform(1, 3, n), np.sort(rng.integers(0, 500, n) * 1.0)])
            t, met = np.sort(rng.integers(0, 500, n) * 1.0), []
            monkeypatch.setattr(planes, "direct", lambda q, counted, *more: (met.append(counted.sum()), direct(q, counted, *more))[1])  # noqa: B023
            top = period if period and period < 2 else 2.0
            got = planes.field(p, t, own, (2.0, top / 2), (4.0, top), (1.0, 0.5), [None, period])
            counted = np.searchsorted(own[5], t, "left")
            assert np.allclose(got, direct(p, counted, own, [None, period]), rtol=1e-12, atol=1e-10)
            pairs.append(sum(met))
        if few == 4 and period != 1.8:  # hills wider than half a period fold inside cells
            assert pairs[1] < 10 * pairs[0] and pairs[1] < 0.1 * counted.sum()


def test_hills_in_one_place_of_a_plane_are_not_paired(spark):
    n = 200_000
    frames, table = spark.range(n).selectExpr("id", "0.3 AS x", "23.9 AS y", "2 * id AS t"), spark.range(n).selectExpr("0.3 AS c1", "-0.1 AS c2", "1.0 AS s1", "0.5 AS s2", "1.0 AS height", "2 * id + 1 AS hill_time")
    got = hills.bias(frames, table, "id", ["x", "y"], "t", [None, 24.0], ["c1", "c2"], ["s1", "s2"]).agg(F.max(F.abs(F.col("bias") - F.col("id"))), F.count("*")).first()
    assert got[0] < 1e-6 and got[1] == n


@pytest.mark.parametrize("factor", [None, 8.0])
def test_constants_in_two_variables(spark, factor):
    rng = np.random.default_rng(4)
    n, axes, periods = 150, [np.linspace(-3, 3, 12), np.linspace(-np.pi, np.pi, 9, endpoint=False)], [None, 2 * np.pi]
    c, s, a = rng.uniform(-3, 3, (n, 2)), rng.uniform(0.2, 0.6, (n, 2)), rng.uniform(0.1, 20, n)
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 2)
    plain = reweight.reweighting_constant(c, s, a, grid, 300.0, factor, True, periods)
    table = spark.createDataFrame([(i, *map(float, (*c[i], *s[i], a[i]))) for i in range(n)], "o long, c1 double, c2 double, s1 double, s2 double, height double").repartition(4)
    for block in (1000, 16):
        got = hills.constants(table, "o", axes, reweight.R * 300.0, factor, periods, ["c1", "c2"], ["s1", "s2"], block=block).orderBy("o").collect()
        assert np.allclose([r["c"] for r in got], plain, atol=1e-8)
    frames = spark.createDataFrame([(i, float(x), float(y), float(t)) for i, (x, y, t) in enumerate(zip(rng.uniform(-3, 3, 40), rng.uniform(-3, 3, 40), rng.uniform(0, n, 40), strict=True))], "id long, x double, y double, t double")
    timed = table.withColumn("hill_time", F.col("o").cast("double"))
    kept = {"names": ["x", "y"], "times": np.arange(n, dtype=float), "centers": c, "sigmas": s, "heights": a, "periods": periods, "spans": [None, (-np.pi, np.pi)]}
    axes = reweight.default_grid(c, s, 200, kept["spans"])
    for mode in ("final", "rct"):
        plain = {r["id"]: r["weight"] for r in reweight.metad_weights(frames, ["x", "y"], "t", kept, 300.0, mode, factor, 5.0).collect()}
        got = {r["id"]: r["weight"] for r in hills.weights(frames, timed, "id", ["x", "y"], "t", 300.0, mode, factor, 5.0, axes, periods, ["c1", "c2"], ["s1", "s2"]).collect()}
        assert plain.keys() == got.keys() and np.allclose([plain[k] for k in plain], [got[k] for k in plain], rtol=1e-6, atol=1e-12)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(t), i, str(rng.choice(list("abc"), p=[0.8, 0.15, 0.05])), float(rng.integers(0, 9))) for k, n in (("long", 700), ("short", 20), (None, 90)) for i, t in enumerate(np.sort(rng.integers(0, 400, n)))]
    return pd.DataFrame(rows, columns=["rep", "t", "i", "state", "x"]), spark.createDataFrame(rows, "rep string, t long, i long, state string, x double").repartition(3)


@pytest.mark.parametrize("rows", [30, 10_000])
def test_ranges_number_and_lag(series, rows):
    plain, df = series
    got = ranges.lagged(df, ["rep"], ["t", "i"], "state", [1, 5, 90], rows).toPandas()
    for rep, own in plain.groupby("rep", dropna=False):
        own = own.sort_values(["t", "i"])
        mine = got[got["rep"].isna()] if pd.isna(rep) else got[got["rep"] == rep]
        mine = mine.sort_values("_ordinal")
        assert mine["_ordinal"].tolist() == list(range(len(own))) and mine["i"].tolist() == own["i"].tolist()
        ahead = pd.DataFrame(mine["_ahead"].tolist())
        for c, lag in enumerate((1, 5, 90)):
            expected = own["state"].shift(-lag)
            assert [None if pd.isna(x) else x for x in ahead[c]] == [None if pd.isna(x) else x for x in expected]
    assert ranges.in_ranges(df, ["rep"], F.col("t"), rows).groupBy("rep", "_range").count().agg(F.max("count")).first()[0] <= max(2 * rows, 60)


def test_ranges_give_what_whole_replicates_give(series):
    _, df = series
    df = df.where("rep is not null")
    for a, b in (
        (kinetics.pairs(df, "rep", ["t", "i"], "state", ["a", "b"], 3), kinetics.pairs(df, "rep", ["t", "i"], "state", ["a", "b"], 3, rows_each=50)),
        (kinetics.visits(df, "rep", ["t", "i"], "state", "t"), kinetics.visits(df, "rep", ["t", "i"], "state", "t", rows_each=50)),
        (msm.lagged_counts(df, "rep", ["t", "i"], "state", [1, 4], False), msm.lagged_counts(df, "rep", ["t", "i"], "state", [1, 4], False, rows_each=50)),
    ):
        assert sorted(map(repr, (r.asDict() for r in a.select(sorted(a.columns)).collect()))) == sorted(map(repr, (r.asDict() for r in b.select(sorted(a.columns)).collect())))
    left, right = df.where("state = 'a'").withColumn("key", F.concat_ws("-", "rep", "i")), df.where("state != 'a'").groupBy("rep", "t").agg(F.max("x").alias("x"))
    for how in ({}, {"strict": True}, {"direction": "forward"}, {"direction": "nearest"}, {"direction": "nearest", "ties": "later", "tolerance": 3.0}):
        a, b = joins.asof(left, right, ["rep"], "t", "x", "key", **how), joins.asof(left, right, ["rep"], "t", "x", "key", rows=40, **how)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), how
    a, b = joins.accumulated_before(left, right, ["rep"], "t", "x", "key"), joins.accumulated_before(left, right, ["rep"], "t", "x", "key", rows=40)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_wham_of_stiff_windows_far_apart():
    edges = np.linspace(0, 60, 601)
    x = (edges[1:] + edges[:-1]) / 2
    centers, kappa = np.arange(0, 61, 5.0), 300.0
    u = 0.5 * kappa * (x[None] - centers[:, None]) ** 2
    rng = np.random.default_rng(0)
    counts = np.stack([np.histogram(c + rng.standard_normal(2000) / np.sqrt(kappa), edges)[0] for c in centers])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p, f = reweight.wham(counts, counts.sum(1), u, most=200)
    assert np.isfinite(p).all() and np.isfinite(f).all() and abs(p.sum() - 1) < 1e-9
    with pytest.warns(UserWarning, match="did not settle"):
        reweight.wham(counts, counts.sum(1), u, tolerance=0.0, most=3)


def test_wham_counts_correlated_samples_less():
    edges = np.linspace(-2, 3, 51)
    x = (edges[1:] + edges[:-1]) / 2
    u = np.stack([2 * x**2, 2 * (x - 1) ** 2])
    rng = np.random.default_rng(1)
    counts = np.stack([np.histogram(rng.normal(c, 0.5, 4000), edges)[0] for c in (0, 1)])
    p, f = reweight.wham(counts, counts.sum(1), u)
    same, _ = reweight.wham(counts, counts.sum(1), u, inefficiency=[3.0, 3.0])
    other, _ = reweight.wham(counts, counts.sum(1), u, inefficiency=[1.0, 20.0])
    alike, _ = reweight.wham(counts[0] + counts[1] / 20, np.array([counts[0].sum(), counts[1].sum() / 20]), u)
    assert np.allclose(p, same) and np.allclose(other, alike) and not np.allclose(p, other) and abs(f[1]) < 0.2


def test_effective_samples_of_long_replicates(spark):
    from terrane.operators import timeseries

    rng = np.random.default_rng(8)
    rows = []
    for k, (n, keep) in {"slow": (900, 0.97), "white": (500, 0.0), "flat": (300, None), "few": (3, 0.5)}.items():
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = 0.0 if keep is None else keep * x[i - 1] + rng.standard_normal()
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rep string, t long, x double").repartition(3)
    plain = {r["rep"]: r["g"] for r in timeseries.effective_samples(df, "rep", ["t"], "x").collect()}
    for each in (2, 100):
        got = {r["rep"]: r["g"] for r in timeseries.effective_samples(df, "rep", ["t"], "x", each).collect()}
        assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-8 * plain[k] for k in plain)


def test_medoids_without_pairs(spark):
    from terrane.operators import representatives

    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0, 3, (260, 2)), 1)
    df = spark.createDataFrame([(i, "a" if i < 200 else None, float(p), float(q)) for i, (p, q) in enumerate(x)], "i long, g string, x double, y double").repartition(4)
    for rows in (10_000, 30):
        got = {r["i"]: r["total"] for r in representatives.distance_sums(df, ["g"], "x", "i", rows).collect()}
        for i in range(260):
            own = x[:200, 0] if i < 200 else x[200:, 0]
            assert abs(got[i] - np.abs(own - x[i, 0]).sum()) < 1e-8
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).sum(1)
    key, mean, passes = representatives.medoid(df, ["x", "y"], "i")
    assert key == int(d.argmin()) and abs(mean - d.min() / 260) < 1e-9 and passes < 4
    with pytest.raises(ValueError, match="not enough"):
        representatives.medoid(df, ["x", "y"], "i", most_passes=0)


def test_tasks_of_block_indices_grow_with_the_draws(spark, monkeypatch):
    """One long replicate and a short one: the same draws as plainly drawn, in tasks of a bounded number."""
    for name, value in (("TASK_DRAWS", 2000), ("CHUNK", 50), ("STRETCH", 300)):
        monkeypatch.setattr(resample, name, value)
    sizes = spark.createDataFrame([("long", 20_003), ("short", 3), ("one", 1)], "r string, n long")
    out = resample.block_indices(sizes, "r", 4, 7, 5).withColumn("task", F.spark_partition_id()).collect()
    plain = {}
    for r, n in (("long", 20_003), ("short", 3), ("one", 1)):
        for b in range(4):
            for k in range(-(-n // 7)):
                start = int(hashlib.md5(f"5:{b}:{r}:{k}".encode()).hexdigest()[:8], 16) % n
                for off in range(min(7, n - 7 * k)):
                    at = (b, r, (start + off) % n)
                    plain[at] = plain.get(at, 0) + 1
    assert {(x["b"], x["r"], x["_i"]): x["times"] for x in out} == plain and len(out) == len(plain)
    assert max(np.bincount([x["task"] for x in out])) < 6000

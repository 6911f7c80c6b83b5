"""Numerical kernels against known answers."""

import math

import numpy as np
import pytest

from terrane.operators import compare, decompose, kinetics, msm, reweight, segment, timeseries


def test_moments_merge_as_one_pass():
    rng = np.random.default_rng(0)
    x = rng.normal(100, 1, (500, 7))
    a = decompose.merged(decompose.of_rows(x[:123]), decompose.of_rows(x[123:]))
    assert a[0] == 500 and np.allclose(a[1], x.mean(0)) and np.allclose(a[2] / 500, np.cov(x.T, bias=True))
    assert decompose.merged(decompose.empty(7), a) is a


def test_equal_replicate_weighting():
    a, b = decompose.of_rows(np.zeros((10, 2))), decompose.of_rows(np.ones((1000, 2)))
    assert np.allclose(decompose.covariance({0: a, 1: b})[0], 0.5)
    assert np.allclose(decompose.covariance({0: a, 1: b}, "frame")[0], 1000 / 1010)


def test_rmsip_limits():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(30, 15)))[0]
    assert decompose.rmsip(q[:, :10], q[:, :10]) == pytest.approx(1)
    assert decompose.rmsip(q[:, :5], q[:, 5:10]) == pytest.approx(0, abs=1e-7)
    assert decompose.rmsip(q[:, :10], q[:, 5:15]) == pytest.approx(math.sqrt(0.5))


def test_tica_finds_the_slow_axis(spark):
    rng = np.random.default_rng(2)
    slow = np.zeros(4000)
    for k in range(1, 4000):
        slow[k] = 0.99 * slow[k - 1] + rng.normal(0, 0.1)
    x = np.column_stack([rng.normal(0, 3, 4000), slow])
    df = spark.createDataFrame([(0, k, r.tolist()) for k, r in enumerate(x)], "rep int, k int, v array<double>")
    t = decompose.tica(df, "v", "rep", ["k"], 5, 1)
    assert abs(t["vectors"][1, 0]) > 0.95
    assert abs(decompose.pca(df, "v", "rep", 1)["vectors"][0, 0]) > 0.95


def test_superposition_removes_rigid_motion(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=(12, 3))
    rows = []
    for k in range(5):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q *= np.sign(np.linalg.det(q))
        rows.append((k, (ref @ q + rng.normal(size=3)).ravel().tolist()))
    out = decompose.superposed(spark.createDataFrame(rows, "k int, c array<double>"), "c", ref).collect()
    assert max(r["fit_rmsd"] for r in out) < 1e-10
    assert all(np.allclose(np.array(r["c"]).reshape(-1, 3), ref) for r in out)


def test_inefficiency():
    rng = np.random.default_rng(4)
    assert timeseries.inefficiency(rng.normal(size=20000)) < 1.3
    x = np.zeros(100000)
    for k in range(1, len(x)):
        x[k] = 0.8 * x[k - 1] + rng.normal()
    assert timeseries.inefficiency(x) == pytest.approx(9, rel=0.15)
    assert timeseries.inefficiency(np.ones(10)) == 1 and timeseries.inefficiency(np.array([1.0, 2.0])) == 1


def test_equilibration_finds_a_drift():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.linspace(10, 0, 200), np.zeros(800)]) + rng.normal(0, 0.3, 1000)
    assert 100 <= timeseries.equilibration(x)[0] <= 320


def test_equilibration_equals_a_plain_scan():
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=60), np.cumsum(rng.normal(size=150)), np.concatenate([rng.normal(5, 1, 40), rng.normal(size=120)]), np.repeat(rng.normal(size=20), 4)):
        x = np.asarray(x)
        starts = timeseries.starts_of(len(x))
        want = [timeseries.inefficiency(x[t:]) for t in starts]
        got = timeseries.inefficiencies(x, starts)
        moves = np.array([np.ptp(x[t:]) > 0 for t in starts])
        assert np.allclose(got[moves], np.array(want)[moves]) and np.isnan(got[~moves]).all()
        best = max(range(len(starts)), key=lambda k: ((len(x) - starts[k]) / want[k] if moves[k] else -1, -k))
        assert timeseries.equilibration(x)[0] == starts[best]


def test_equilibration_passes_over_constant_ends():
    rng = np.random.default_rng(12)
    x = np.zeros(460)
    for k in range(1, 400):
        x[k] = 0.95 * x[k - 1] + rng.normal()
    x[400:] = x[399]
    assert timeseries.equilibration(x)[0] < 399
    assert timeseries.equilibration(np.ones(50)) == (0, 1.0, 50.0)
    ramp = np.arange(20.0)  # the correlations of a line: C of the last lag, n - 1, is not summed
    d = ramp - ramp.mean()
    c = [d[t:] @ d[: 20 - t] / ((20 - t) * ramp.var()) for t in range(1, 19)]
    stop = next(k for k, v in enumerate(c) if v <= 0 and k + 1 > 3)
    assert timeseries.inefficiency(ramp) == pytest.approx(1 + 2 * sum(v * (1 - (k + 1) / 20) for k, v in enumerate(c[:stop])))


def plain_merge(basin, energy, least):
    """Joins the pair of the lowest barrier, looks again, and so on."""
    basin = basin.copy()
    while True:
        low = {k: energy[basin == k].min() for k in np.unique(basin) if k}
        pairs = {}
        for (y, x), k in np.ndenumerate(basin):
            for b, a in ((y + 1, x), (y, x + 1)):
                if b < basin.shape[0] and a < basin.shape[1] and k and basin[b, a] and basin[b, a] != k:
                    key = tuple(sorted((int(k), int(basin[b, a]))))
                    pairs[key] = min(pairs.get(key, np.inf), max(energy[y, x], energy[b, a]))
        barriers = sorted((e - max(low[i], low[j]), i, j) for (i, j), e in pairs.items())
        if not barriers or barriers[0][0] >= least:
            return basin
        _, i, j = barriers[0]
        basin[basin == (j if low[i] <= low[j] else i)] = i if low[i] <= low[j] else j


def test_joining_shallow_basins_equals_the_plain_way():
    rng = np.random.default_rng(13)
    for _ in range(30):
        energy = rng.normal(size=(14, 14)).cumsum(0).cumsum(1) * 0.2 + rng.normal(size=(14, 14))
        support = rng.random((14, 14)) < 0.9
        basin = segment.flooded(energy, [tuple(map(int, c)) for c in rng.integers(14, size=(12, 2))], support) * support
        for least in (0.2, 1.0, 3.0):
            assert (segment.shallow_merged(basin, energy, least) == plain_merge(basin, energy, least)).all()


def test_matching_counts_the_resampled_basin():
    reference, other = np.array([[1, 1, 1, 1, 1, 1, 2, 2]]), np.array([[1, 1, 0, 0, 0, 0, 2, 2]])
    assert segment.matched(reference, other, np.ones((1, 8))) == {1: 1, 2: 2}
    assert segment.matched(np.array([[1, 0, 0, 0]]), np.array([[1, 1, 1, 1]]), np.ones((1, 4))) == {}


def mixture():
    rng = np.random.default_rng(101)
    at = np.array([(-3, -3), (3, 3), (3, -3)])[rng.choice(3, 4000, p=[0.65, 0.25, 0.10])]
    return at + rng.normal(0, 0.5, (4000, 2))


def test_segmentation_of_three_wells():
    x = mixture()
    h, ex, ey = np.histogram2d(x[:, 0], x[:, 1], bins=30)
    p = h.T / h.sum()
    with np.errstate(divide="ignore"):
        g = np.where(p > 0, -2.494 * np.log(p / p.max()), np.nan)
    b = segment.segmented(p, g, p > 0, least_barrier=2.494)
    sizes = sorted((p[b == k].sum() for k in np.unique(b) if k), reverse=True)
    assert len(sizes) >= 3 and sizes[0] == pytest.approx(0.65, abs=0.08) and sizes[1] == pytest.approx(0.25, abs=0.06)
    assert (b[p == 0] == 0).all() and (b[p > 0] > 0).all()


def test_assignment_and_matching():
    cost = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert sum(cost[i, j] for i, j in segment.assignment(cost)) == 5
    ref, other = np.array([[1, 1, 2, 2]]), np.array([[2, 2, 1, 1]])
    assert segment.matched(ref, other, np.ones((1, 4))) == {2: 1, 1: 2}


def test_mean_first_passage_two_states():
    m = kinetics.mean_first_passage(np.array([[0.9, 0.1], [0.2, 0.8]]), 10)
    assert m[0, 1] == pytest.approx(100) and m[1, 0] == pytest.approx(50)


def chain(t, n, seed=0):
    rng = np.random.default_rng(seed)
    out, s = [], 0
    for u in rng.random(n):
        out.append(s)
        s = int(np.searchsorted(np.cumsum(t[s]), u))
    return np.array(out)


T4 = np.array([[0.95, 0.049, 0.001, 0], [0.05, 0.948, 0.002, 0], [0, 0.002, 0.948, 0.05], [0, 0, 0.06, 0.94]])


def test_markov_model_recovers_the_chain():
    x = chain(T4, 200_000)
    c = np.zeros((4, 4))
    np.add.at(c, (x[:-1], x[1:]), 1)
    e = msm.estimate(c, 1)
    assert np.allclose(e["T"], T4, atol=0.02) and np.allclose(e["T"].sum(1), 1) and msm.is_reversible(e["T"], e["pi"])
    chi = msm.pcca(e["T"], 2)
    assert chi[:2].argmax(1).tolist() == [chi[0].argmax()] * 2 and chi[2:].argmax(1).tolist() == [1 - chi[0].argmax()] * 2
    assert np.allclose(chi.sum(1), 1) and msm.coarse(e["T"], chi)[0, 0] > 0.99
    sets = chi.argmax(1)
    c5 = np.zeros((4, 4))
    np.add.at(c5, (x[:-5], x[5:]), 1)
    assert msm.chapman_kolmogorov({1: c, 5: c5, 2: c}, 1, sets, 1)["within_tolerance"].all()


def test_connected_sets_and_timescales():
    c = np.array([[0, 5, 0], [5, 0, 1], [0, 0, 3.0]])
    assert msm.connected(c) == [[0, 1], [2]]
    assert decompose.timescales([1.0, 0.5, -0.1], 2).tolist()[:2] == [math.inf, pytest.approx(2 / math.log(2))]



def test_student_quantiles():
    assert compare.t_quantile(0.975, 2) == pytest.approx(4.302652729911275, rel=1e-9)
    assert compare.t_quantile(0.975, 30) == pytest.approx(2.042272456301238, rel=1e-9)


def test_one_hill():
    hill = {"centers": np.array([[0.0]]), "sigmas": np.array([[0.5]]), "heights": np.array([2.0]), "hill_times": np.array([1.0])}
    assert reweight.bias(np.array([[0.0]]), None, **hill)[0] == pytest.approx(2)
    assert reweight.bias(np.array([[0.0]]), np.array([1.0]), **hill)[0] == 0
    assert reweight.bias(np.array([[2.0]]), None, **hill)[0] == 0
    assert reweight.bias(np.array([[6.2]]), None, periods=[2 * math.pi], **hill)[0] > 1.9


def test_wham_and_mbar_agree(spark):
    rng = np.random.default_rng(6)
    centers, kappa, kt = [-1.0, 0.0, 1.0], [8.0] * 3, 2.494
    x = [rng.normal(c / 2, math.sqrt(kt / 16), 3000) for c in centers]  # a harmonic well of constant 8 under the windows
    df = spark.createDataFrame([(float(v), k) for k, s in enumerate(x) for v in s], "x double, k int")
    e = reweight.umbrella_energies(df, "x", centers, kappa, kt).persist()
    f = reweight.mbar(e, [3000] * 3, steps=60)
    edges = np.linspace(-3, 3, 61)
    h = sum(np.histogram(s, edges)[0] for s in x)
    mid = (edges[1:] + edges[:-1]) / 2
    p, g = reweight.wham(h, np.array([3000] * 3), np.array([[0.5 * k * (m - c) ** 2 / kt for m in mid] for c, k in zip(centers, kappa, strict=True)]))
    assert np.allclose(f, g, atol=0.08)
    w = reweight.unbiased_weights(e, f, [3000] * 3).selectExpr("sum(weight) s", "sum(weight * x * x) v").first()
    assert w["s"] == pytest.approx(1) and w["v"] == pytest.approx(kt / 8, rel=0.15)

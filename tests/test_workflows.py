"""Workflows of the API and the command line, and operators that joined them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import api, cli
from terrane.config import Analysis
from terrane.functions import columns
from terrane.operators import compare, decompose, joins, msm, quantiles, resample, residues, timeseries
from terrane.sources import sinks


@pytest.fixture(scope="module")
def two_states(spark):
    """A series that jumps between two wells, and begins far from both."""
    rng, rows = np.random.default_rng(3), []
    for rep in ("a", "b"):
        side = 1
        for k in range(400):
            side = -side if rng.random() < 0.05 else side
            x = 12 - 0.3 * k if k < 40 else 3 * side
            rows.append((rep, k, 10.0 * k, [float(v) for v in (x + rng.normal(0, 0.5), rng.normal(0, 0.5), rng.normal(0, 0.2))]))
    return spark.createDataFrame(rows, "replicate string, frame int, time_ps double, coords array<double>").persist()


def test_analysis_discards_the_transient_and_fits_anew(two_states):
    s = Analysis(components=2, bins=16, bootstrap=5, equilibration="auto")
    out = api.analyze(two_states, s)
    starts = {r["replicate"]: r["t0"] for r in out.tables["discarded"].collect()}
    assert all(15 <= t <= 120 for t in starts.values())
    assert out.tables["projections"].count() == 800 - sum(starts.values())
    assert out.tables["modes"].count() == 2 and len(out.tables["mean"].first()["mean"]) == 3
    assert {"first_passage_times", "bootstrap_intervals", "cosine_content"} <= out.tables.keys()
    before = Analysis(bins=16, bootstrap=0)
    api.rebin(out.tables["projections"], before)
    assert before.method == "pca"


def test_markov_model_as_tables(two_states, tmp_path):
    frames = two_states.where("frame >= 40").withColumn("PC1", F.col("coords")[0]).withColumn("PC2", F.col("coords")[1])
    out = api.build_msm(frames, Analysis(clusters=6, metastable=2, msm_lag=2, msm_lags=(1, 2, 4, 1000)))
    t = {name: df.collect() for name, df in out.tables.items()}
    assert sum(r["probability"] for r in t["stationary"]) == pytest.approx(1)
    assert {r["lag"] for r in t["timescales"]} == {1, 2, 4, 6} and {r["label"] for r in t["microstates"]} <= {"MS1", "MS2", "inactive"}
    rows = {}
    for r in t["transition_matrix"]:
        rows[r["source"]] = rows.get(r["source"], 0) + r["probability"]
    assert all(v == pytest.approx(1) for v in rows.values()) and len(t["frames"]) == 720
    sinks.save(out.tables, f"file://{tmp_path}/msm", {k: v.tolist() for k, v in out.arrays.items()})
    assert set(sinks.load(frames.sparkSession, f"file://{tmp_path}/msm")[0]) == set(out.tables)


def test_residue_analysis(spark):
    rng, rows = np.random.default_rng(1), []
    for k in range(60):
        base = np.array([[0, 0, 0], [2, 0, 0], [8, 0, 0], [10, 0, 0], [3.5 if k % 2 else 6.0, 0, 0.0]])
        rows.append(("r", k, "A" if k % 2 else "B", (base + rng.normal(0, 0.1, base.shape)).ravel().tolist()))
    frames = spark.createDataFrame(rows, "replicate string, frame int, state string, coords array<double>")
    atoms = spark.createDataFrame([(i, "X", 1 + i // 2, "LIG" if i == 4 else "ALA", ("C", "CA")[i % 2]) for i in range(5)], "ordinal int, chain string, residue_number int, residue_name string, atom_name string")
    out = api.analyze_residues(frames, atoms, Analysis(contact_cutoff=2.5), ligand=["LIG"])
    n = {(r["residue"], r["state"]): r["persistence"] for r in out["contact_persistence_by_state"].collect()}
    assert n == {(0, "A"): 1.0, (0, "B"): 0.0, (1, "A"): 0.0, (1, "B"): pytest.approx(n[1, "B"])} and n[1, "B"] > 0.9
    assert out["residue_correlations"].where("i = j").count() == 3 and out["residue_correlations_by_state"].count() == 18
    assert {r["residue"] for r in out["binding_site"].collect()} <= {0, 1}
    d = api.descriptors_of(frames, Analysis(), [12.0] * 5)
    assert d["descriptor_series"].count() == 60 and d["descriptor_summary"].first()["frames"] == 60 and d["atom_fluctuations"].count() == 5


def test_umbrella_and_doctor_commands(spark, tmp_path, capsys):
    rng, args = np.random.default_rng(2), ["umbrella", f"file://{tmp_path}/out", "--cv", "d", "--bins", "20"]
    for k, c in enumerate((0.0, 1.0, 2.0)):
        (tmp_path / f"w{k}").write_text("#! FIELDS time d\n" + "".join(f"{t} {x}\n" for t, x in enumerate(c + rng.normal(0, 0.3, 200))))
        args += ["--window", f"file://{tmp_path}/w{k}", str(c), "27.7"]
    cli.main(args)
    tables, _ = sinks.load(spark, f"file://{tmp_path}/out")
    assert tables["windows"].count() == 3 and tables["weights"].agg(F.sum("weight")).first()[0] == pytest.approx(1) and tables["pmf"].count() == 20
    assert max(abs(r["free_energy"]) for r in tables["windows"].collect()) < 1.0  # flat below the windows
    cli.main(["doctor"])
    assert "python workers answer" in capsys.readouterr().out


def test_newton_steps_reach_what_self_consistent_ones_do(spark):
    from terrane.operators import reweight

    rng = np.random.default_rng(4)
    centers, n = [0.0, 1.0, 2.0, 3.0], [150, 0, 80, 120]
    x = np.concatenate([c + rng.normal(0, 0.6, k) for c, k in zip(centers, n, strict=True)])
    df = reweight.umbrella_energies(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", centers, [3.0] * 4, 1.0).persist()
    u, f = np.stack([1.5 * (x - c) ** 2 for c in centers]), np.zeros(4)
    for _ in range(20_000):
        d = (np.array(n)[:, None] * np.exp(f[:, None] - u)).sum(0)
        f = -np.log((np.exp(-u) / d).sum(1))
        f -= f[0]
    assert np.allclose(reweight.mbar(df, n), f, atol=1e-6)


def test_exact_quantiles_of_more_values_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), np.full(7, 9.0)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
    p = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, "v", p), np.quantile(x, p))
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    times = spark.createDataFrame([(int(v),) for v in rng.integers(0, 5000, 900)], "t long")
    want = np.diff(np.unique([r["t"] for r in times.collect()]))
    assert sorted(r["gap"] for r in quantiles.gaps(times, "t").collect()) == sorted(want.tolist())


def test_block_counts_equal_plain_draws(spark):
    rng = np.random.default_rng(7)
    rows = [(rep, k, str(rng.choice(["x", "y", "z"]))) for rep, n in (("a", 23), ("b", 4), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "replicate string, k int, s string")
    sizes = df.groupBy("replicate").agg(F.count("*").alias("n"))
    for length in (1, 5, 30):
        plain = resample.resampled(df, "replicate", ["k"], 6, length).groupBy("b", "replicate", "s").agg(F.sum("times").alias("t"))
        got = resample.block_counts(df, "replicate", ["k"], "s", 6, length)
        assert sorted(map(str, got.select("b", "replicate", "s", "t").collect())) == sorted(map(str, plain.select("b", "replicate", "s", "t").collect()))
    own = sizes.select("replicate", (F.col("n") % 7 + 1).cast("int").alias("length"))
    counts = resample.block_counts(df, "replicate", ["k"], "s", 6, own).groupBy("b", "replicate").agg(F.sum("t").alias("t")).join(sizes, "replicate")
    assert counts.where("t != n").count() == 0 and counts.count() == 18


def test_correlated_motion():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(500, 3))
    x = np.hstack([a, a, -a, rng.normal(size=(500, 3)), np.zeros((500, 3))])
    c = decompose.cross_correlation(np.cov(x.T, bias=True))
    assert np.allclose(np.diag(c)[:4], 1) and c[0, 1] == pytest.approx(1) and c[0, 2] == pytest.approx(-1) and abs(c[0, 3]) < 0.1 and np.isnan(c[4]).all()
    small = decompose.collapsed(c, [0, 0, 1, 1, 2])
    assert small[0, 0] == pytest.approx(1) and small[0, 1] == pytest.approx((-2 + c[0, 3] * 2) / 4) and np.isnan(small[2]).all()
    v = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    m = decompose.mode_contributions(v)
    assert np.allclose((m**2).sum(0), 1) and np.allclose(decompose.mode_contributions(v, 3, [0, 0]), 1)


def test_weights_and_projection(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "w double")
    with pytest.raises(Exception, match="not a weight"):
        df.select(columns.checked_weight(F.col("w"))).collect()
    with pytest.raises(Exception, match="add up"):
        residues.centroid(spark.createDataFrame([(1, 0.0, 2.0)], "k int, w double, x double"), ["k"], ["x"], "w").collect()
    rng = np.random.default_rng(9)
    x, mean, axes = rng.normal(size=(20, 300)), rng.normal(size=300), rng.normal(size=(300, 3))
    frames = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    got = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in decompose.projected(frames, "v", mean, axes).orderBy("k").collect()])
    assert np.allclose(got, (x - mean) @ axes)


def test_later_ties_and_frames_of_times(spark):
    left = spark.createDataFrame([(0, 1, 15.0)], "g int, k int, t double")
    right = spark.createDataFrame([(0, 10.0, "a"), (0, 20.0, "b")], "g int, t double, v string")
    assert joins.asof(left, right, ["g"], "t", "v", "k", "nearest", ties="later").first()["v"] == "b"
    assert joins.at_time(right, ["g"], "t", [], 15.0).first()["v"] == "a"


def test_joint_equilibration_and_blocks(spark):
    rng = np.random.default_rng(10)
    drift = np.concatenate([np.linspace(6, 0, 60), np.zeros(240)]) + rng.normal(0, 0.3, 300)
    df = spark.createDataFrame([("r", k, float(drift[k]), float(rng.normal())) for k in range(300)], "replicate string, k int, x double, y double")
    rows = {r["observable"]: r for r in timeseries.equilibrated(df, "replicate", ["k"], ["x", "y"]).collect()}
    assert rows["latest"]["t0"] == max(rows["x"]["t0"], rows["y"]["t0"]) and 30 <= rows["joint"]["t0"] <= 120
    g = spark.createDataFrame([(1.0, 1000), (20.0, 1000), (5.0, 300), (None, 10)], "g double, n long")
    assert [r[0] for r in g.select(timeseries.blocks_of(F.col("g"), F.col("n"))).collect()] == [10, 5, 6, 5]


def test_scan_leaves_out_lags_without_an_estimate():
    import pandas as pd

    c = pd.DataFrame([(1, 0, 0, 90), (1, 0, 1, 10), (1, 1, 0, 10), (1, 1, 1, 90)], columns=["lag", "i", "j", "c"])
    table, flat = msm.scan(c, [1, 50], 2)
    assert table["lag"].tolist() == [1] and flat is None and table["timescale"][0] == pytest.approx(-1 / np.log(0.8))


def test_intervals_of_any_count(spark):
    df = spark.createDataFrame([(50.0, 2.0, 2000), (50.0, 2.0, 3), (50.0, None, 1)], "m double, sem double, n long")
    rows = {r["n"]: r for r in compare.replicate_intervals(df, "m", "sem", "n").collect()}
    assert rows[2000]["ci_high"] == pytest.approx(50 + 2 * 1.9611514) and rows[3]["ci_high"] == pytest.approx(50 + 2 * 4.30265273) and rows[1]["ci_low"] is None


def test_a_stored_run_gives_its_settings(spark, tmp_path, monkeypatch, two_states):
    run, other, plain = (str(tmp_path / n) for n in ("run", "other", "plain"))
    was = Analysis(method="columns", x="x", y="y", bins=14, temperature=310, smooth_sigma=1.0, max_states=4, bootstrap=20)
    kept = two_states.where("frame >= 40").select("replicate", "frame", "time_ps", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    sinks.save({"projections": kept}, run, {"settings": vars(was)})
    assert Analysis(**sinks.stored_settings(spark, run)) == was
    new = api.rebin_run(spark, run, {"bins": 9})
    assert new.settings == Analysis(**vars(was) | {"bins": 9, "bootstrap": 0}) and "bootstrap_intervals" not in new.tables
    assert new.tables["free_energy"].count() == 81 and new.tables["projections"].count() == kept.count()
    new.release()
    seen = []
    monkeypatch.setattr(api, "analyze", lambda frames, s: seen.append(s) or api.Results(s, {"projections": frames}))
    cli.main(["analyze", run + "/projections", other, "--from", run, "--set", "stride=2", "--set", 'order=["frame"]'])
    assert seen == [Analysis(**vars(was) | {"stride": 2})] and sinks.is_run(spark, other) and sinks.stored_settings(spark, other)["stride"] == 2
    spark.range(3).write.parquet(plain)
    assert not sinks.is_run(spark, plain)
    with pytest.raises(ValueError, match="no stored run"):
        cli.main(["analyze", plain, other, "--from", plain])
    with pytest.raises(ValueError, match="discarded by the analysis"):
        api.rebin_run(spark, run, {"equilibration": "auto"})

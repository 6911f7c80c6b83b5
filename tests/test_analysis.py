"""Bootstraps of long replicates, convergence of modes, state differences, umbrella and metadynamics workflows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import cli
from terrane.operators import decompose, overlaps, residues, resample, reweight, umbrella
from terrane.sources import text


def test_drawn_blocks_of_long_replicates_as_of_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, i, None if rng.random() < 0.1 else str(rng.choice(list("abc")))) for k, n in (("x", 83), ("y", 7), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "rep string, t long, label string").withColumn("sys", F.when(F.col("rep") == "x", 1).otherwise(2)).repartition(3)
    lengths = spark.createDataFrame([("x", 9), ("y", 3), (None, 5)], "rep string, length int")
    both = []
    for draws in (10**9, 0, 60):
        monkeypatch.setattr(resample, "DRAWS", draws)
        found = resample.block_counts(df.where("rep is not null"), "rep", ["t"], "label", 6, lengths, 3, ["sys"]).groupBy("sys", "b", "label").agg(F.sum("t").alias("t"))
        both.append(sorted(map(tuple, found.collect())))
    assert both[0] == both[1] == both[2]
    each = []
    for draws in (10**9, 0):
        monkeypatch.setattr(resample, "DRAWS", draws)
        each.append(sorted(map(repr, resample.block_counts(df.where("rep is not null"), "rep", ["t"], "label", 6, lengths, 3).select("rep", "b", "label", "t").collect())))
    assert each[0] == each[1]
    plain = {}
    for rep, size in (("x", 9), ("y", 3)):
        own = [r[2] for r in rows if r[0] == rep]
        n = len(own)
        drawn = spark.createDataFrame([(rep, b, k) for b in range(6) for k in range(-(-n // size))], "rep string, b int, k int")
        from terrane.functions.columns import counter_uniform

        for r in drawn.withColumn("s", counter_uniform(F.lit(n), F.lit(3), F.col("b"), F.col("rep"), F.col("k"))).collect():
            for off in range(min(size, n - r["k"] * size)):
                label = own[(r["s"] + off) % n]
                if label is not None:
                    key = (1 if rep == "x" else 2, r["b"], label)
                    plain[key] = plain.get(key, 0) + 1
    assert both[0] == sorted((*k, v) for k, v in plain.items())


def test_overlaps_as_from_parts(spark):
    rng = np.random.default_rng(1)
    sizes, d = {"a": 41, "b": 30, "c": 3}, 6
    x = {r: rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) for r, n in sizes.items()}
    df = spark.createDataFrame([(r, i, x[r][i].tolist()) for r in x for i in range(sizes[r])], "rep string, i long, v array<double>").repartition(4)
    found = overlaps.convergence(df, "v", "rep", ["i"], 3)

    def modes(parts):
        return decompose.eigen(decompose.covariance({k: decompose.of_rows(p) for k, p in parts.items()})[1], 3)[2]

    long = [r for r in x if sizes[r] >= 4]
    first, second = {r: x[r][: sizes[r] // 2] for r in long}, {r: x[r][sizes[r] // 2 :] for r in long}
    assert dict(found["halves"])[None] == pytest.approx(decompose.rmsip(modes(first), modes(second)))
    assert dict(found["halves"])["a"] == pytest.approx(decompose.rmsip(modes({"a": first["a"]}), modes({"a": second["a"]})))
    for f, value in found["progressive"]:
        part = {r: x[r][: max(2, round(sizes[r] * f))] for r in x}
        assert value == pytest.approx(decompose.rmsip(modes(part), modes(x)))
    assert {(a, b): v for a, b, v in found["pairs"]}["a", "b"] == pytest.approx(decompose.rmsip(modes({"a": x["a"]}), modes({"b": x["b"]})))
    assert len(found["pairs"]) == 3


def test_differences_of_all_states(spark):
    rng = np.random.default_rng(2)
    x, w, states = rng.standard_normal((50, 4, 3)), rng.uniform(0.5, 2, 50), rng.choice(["S", "T", "U"], 50, p=[0.5, 0.3, 0.2])
    moves = spark.createDataFrame([(str(states[f]), a // 2, a, float(w[f]), *map(float, x[f, a])) for f in range(50) for a in range(4)], "st string, residue long, atom long, w double, x double, y double, z double")
    got = {(r["residue"], r["state_b"]): r for r in residues.all_state_differences(moves, "st", "residue", "atom", ["x", "y", "z"], "w").collect()}
    assert len(got) == 4

    def part(s):
        m = states == s
        p = w[m] / w[m].sum()
        mean = np.einsum("f,fad->ad", p, x[m])
        return mean, np.einsum("f,fad->a", p, (x[m] - mean) ** 2)

    ma, fa = part("S")
    for (residue, s), r in got.items():
        mb, fb = part(s)
        at = slice(2 * residue, 2 * residue + 2)
        d = (mb - ma)[at]
        assert r["rmsf_a"] == pytest.approx(np.sqrt(fa[at].mean())) and r["rmsf_b"] == pytest.approx(np.sqrt(fb[at].mean())) and r["delta_rmsf"] == pytest.approx(r["rmsf_b"] - r["rmsf_a"])
        assert r["mean_rmsd"] == pytest.approx(np.sqrt((d**2).sum(1).mean())) and r["centroid_displacement"] == pytest.approx(np.linalg.norm(d.mean(0)))
        assert r["state_a"] == "S" and r["n_atoms"] == 2 and r["n_frames_b"] == (states == s).sum()


def test_wham_recovers_a_profile(spark, tmp_path):
    rng, kt = np.random.default_rng(3), reweight.R * 300.0
    centers, kappa = np.arange(-2, 2.1, 1.0), 20.0
    rows = []
    for k, c in enumerate(centers):  # samples of a harmonic well of force constant 4 under each bias
        total = 4 + kappa
        rows += [(k, float(i), float(v)) for i, v in enumerate(rng.normal(kappa * c / total, np.sqrt(kt / total), 3000))]
    df = spark.createDataFrame(rows, "window int, time double, x double")
    g = umbrella.inefficiencies(df, "window", "time", "x", 5)
    assert all(1 <= v < 1.5 for v in g)
    profile, f = umbrella.wham(df, "x", "window", centers.tolist(), [kappa] * 5, 60, inefficiency=g)
    table = profile.where("count > 300").toPandas()
    shape = table["free_energy"] - 2 * table["x"] ** 2
    assert shape.std() < 0.15 and len(f) == 5 and f[0] == 0
    for k, c in enumerate(centers):
        (tmp_path / f"w{k}").write_text("#! FIELDS time d\n" + "\n".join(f"{t} {v}" for w, t, v in rows[3000 * k : 3000 * k + 200] if w == k))
    cli.main(["umbrella", str(tmp_path / "out"), "--cv", "d", "--bins", "20", "--method", "wham", *(x for k, c in enumerate(centers) for x in ("--window", str(tmp_path / f"w{k}"), str(c), str(kappa)))])
    assert spark.read.parquet(f"{tmp_path}/out/windows").count() == 5


def test_reweighting_from_files_without_collecting(spark, tmp_path):
    rng = np.random.default_rng(4)
    lines = "\n".join(f"{t} {rng.uniform(-3, 3):.4f} {rng.uniform(0, 2):.4f} 0.35 0.2 {1.2 * rng.uniform(0.5, 1):.4f} 10" for t in range(1, 60))
    hills = "#! FIELDS time phi d sigma_phi sigma_d height biasf\n#! SET multivariate false\n#! SET kerneltype gaussian\n#! SET min_phi -pi\n#! SET max_phi pi\n" + lines
    (tmp_path / "HILLS").write_text(hills)
    (tmp_path / "COLVAR").write_text("#! FIELDS time phi d\n" + "\n".join(f"{t} {rng.uniform(-3, 3):.4f} {rng.uniform(0, 2):.4f}" for t in np.arange(0.5, 60, 1.5)))
    table, names, spans, factor = text.hill_table(spark, str(tmp_path / "HILLS"))
    assert names == ["phi", "d"] and spans[0] == pytest.approx((-np.pi, np.pi)) and spans[1] is None and factor == 10 and table.count() == 59
    for mode in ("final", "rct"):
        cli.main(["reweight", str(tmp_path / "HILLS"), str(tmp_path / "COLVAR"), str(tmp_path / mode), "--mode", mode, "--skip", "3"])
        got = [float(r["value"].split()[-1]) for r in spark.read.text(f"{tmp_path}/{mode}").collect() if r["value"].strip() and not r["value"].startswith("#")]
        parsed = text.parse_hills(hills)
        rows = [line.split() for line in (tmp_path / "COLVAR").read_text().splitlines()[1:]]
        frames = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "row int, time_ps double, phi double, d double")
        plain = [r["weight"] for r in reweight.metad_weights(frames, ["phi", "d"], "time_ps", parsed, 300.0, mode, 10.0, 3.0).collect()]
        assert np.allclose(np.sort(got), np.sort(plain), rtol=1e-4, atol=1e-6)

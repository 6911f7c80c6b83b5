"""Dihedral features, resampled landscapes and further sources."""

import numpy as np
import pytest

from terrane.operators import decompose, features, landscape, resample, segment
from terrane.sources import sinks, text


def test_dihedral_definitions_and_features(spark):
    names = ["N", "CA", "C"]
    rows = [(3 * r + k, names[k], "A", r + 1) for r in range(4) for k in range(3)]
    atoms = spark.createDataFrame(rows, "ordinal int, atom_name string, chain string, residue_number int")
    d = {(r["kind"], r["residue_number"]): (r["i"], r["j"], r["k"], r["l"]) for r in features.definitions(atoms).collect()}
    assert d["psi", 1] == (0, 1, 2, 3) and d["phi", 2] == (2, 3, 4, 5) and ("phi", 4) not in d and ("phi", 1) not in d
    xyz = [[1, 0, 0], [0, 0, 0], [0, 0, 1], [0, 1, 1.0]]
    df = spark.createDataFrame([(np.ravel(xyz).tolist(),)], "c array<double>")
    f = features.with_features(df, "c", [(0, 1, 2, 3)]).first()["features"]
    assert f[0] == pytest.approx(0, abs=1e-6) and abs(f[1]) == pytest.approx(1)


def test_side_chain_and_nucleic_dihedrals(spark):
    schema = "ordinal int, atom_name string, chain string, residue_number int, residue_name string"
    ile = [(k, n, "A", 1, "ILE") for k, n in enumerate(["N", "CA", "CB", "CG1", "CG2", "CD"])]
    val = [(10 + k, n, "A", 2, "VAL") for k, n in enumerate(["N", "CA", "CB", "CG1", "CG2"])]
    base = [(20 + k, n, "B", 1, "G") for k, n in enumerate(["O4*", "C1*", "N9", "C4", "C4*", "C3*", "O3*"])] + [(30 + k, n, "B", 2, "C") for k, n in enumerate(["P", "O5*", "O4*", "C1*", "N1", "C2"])]
    atoms = spark.createDataFrame(ile + val + base, schema)
    d = {(r["kind"], r["chain"], r["residue_number"]): (r["i"], r["j"], r["k"], r["l"]) for r in features.definitions(atoms, ("chi1", "chi2", "chi", "epsilon", "zeta")).collect()}
    assert d == {("chi1", "A", 1): (0, 1, 2, 3), ("chi1", "A", 2): (10, 11, 12, 13), ("chi2", "A", 1): (1, 2, 3, 5), ("chi", "B", 1): (20, 21, 22, 23), ("chi", "B", 2): (32, 33, 34, 35), ("epsilon", "B", 1): (24, 25, 26, 30), ("zeta", "B", 1): (25, 26, 30, 31)}
    assert features.definitions(atoms.drop("residue_name"), ("chi1",)).count() == 2
    with pytest.raises(ValueError):
        features.definitions(atoms, ("tau",))


def test_files_of_many_splits(spark, tmp_path):
    """A trajectory and a table that are read in pieces give what they give in one."""
    atom = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00"
    lines = []
    for m in range(60):
        lines += [f"MODEL {m + 1:8d}", *(atom.format(k + 1, k + 1, m, k, 0.5) for k in range(9)), "ENDMDL"]
    (tmp_path / "t.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "COLVAR").write_text("#! FIELDS time d\n#! SET min_d -pi\n" + "".join(f"{t} {t / 2}\n" for t in range(3000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert text.split_lines(spark, f"file://{tmp_path}/t.pdb").select("block").distinct().count() > 5
        rows = [(r["model"], r["ordinal"], r["x"], r["y"]) for r in text.read_pdb(spark, f"file://{tmp_path}/t.pdb").orderBy("model", "ordinal").collect()]
        assert rows == [(m + 1, k, m, k) for m in range(60) for k in range(9)]
        numbered = text.numbered_lines(spark, f"file://{tmp_path}/t.pdb").orderBy("line").collect()
        assert [r["line"] for r in numbered] == list(range(len(lines))) and [r["value"] for r in numbered] == lines
        t = text.read_plumed(spark, f"file://{tmp_path}/COLVAR").orderBy("row").collect()
        assert [(r["row"], r["values"]["d"]) for r in t] == [(k, k / 2) for k in range(3000)] and t[-1]["constants"] == {"min_d": "-pi"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hills_as_a_table_and_errors(spark, tmp_path):
    write = lambda name, body: (tmp_path / name).write_text(body) and f"file://{tmp_path}/{name}"
    p = write("HILLS", "#! FIELDS time phi sigma_phi height biasf\n#! SET min_phi -pi\n1 0.1 0.3 1.2 10\n2 0.2 0.3 1.1 10\n")
    rows = text.read_hills(spark, p).orderBy("hill_time").collect()
    assert [(r["names"], r["centers"], r["sigmas"], round(r["height"], 9), r["factor"]) for r in rows] == [(["phi"], [0.1], [0.3], 1.08, 10), (["phi"], [0.2], [0.3], 0.99, 10)]
    for name, body, why in (("a", "1 2\n", "before any"), ("b", "#! FIELDS x y\n1\n", "shorter"), ("c", "#! FIELDS x\nq\n", "word"), ("d", "#! FIELDS x\n1\n#! FIELDS y\n2\n", "change")):
        with pytest.raises(Exception, match=why):
            text.read_plumed(spark, write(name, body)).collect()
    with pytest.raises(Exception, match="multivariate"):
        text.read_hills(spark, write("e", "#! FIELDS time x sigma_x height\n#! SET multivariate true\n1 0 1 1\n")).collect()


def test_dcd_selections_and_references(spark, tmp_path):
    import struct

    coords = np.arange(2 * 3 * 3, dtype="<f4").reshape(2, 3, 3)
    block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    head = [0] * 20
    head[0], head[2], head[10], head[19] = 2, 5, 1, 24
    header = b"CORD" + struct.pack("<9i", *head[:9]) + struct.pack("<f", 2.0) + struct.pack("<10i", *head[10:])
    body = b"".join(block(bytes(48)) + b"".join(block(f[:, a].tobytes()) for a in range(3)) for f in coords)
    (tmp_path / "t.dcd").write_bytes(block(header) + block(struct.pack("<i", 1) + b"x" * 80) + block(struct.pack("<i", 3)) + body)
    rows = text.read_dcd(spark, f"file://{tmp_path}/t.dcd", time_unit=1.0).orderBy("frame").collect()
    assert [r["time_ps"] for r in rows] == [0, 10] and [r["coords"] for r in rows] == coords.reshape(2, 9).tolist()
    frames = spark.createDataFrame([("r", 1, [4.0]), ("r", 0, [3.0])], "replicate string, frame int, coords array<double>")
    assert text.reference_coordinates(spark, None, frames) == [3.0]
    atoms = spark.createDataFrame([(0, "CA", "ALA", "A"), (1, "N", "ALA", "A"), (2, "C1", "LIG", "B")], "ordinal int, atom_name string, residue_name string, chain string")
    assert [r["ordinal"] for r in text.selected(atoms, ["C-alpha", "LIG", "ALA"]).collect()] == [0, 1, 2]


def test_resampled_landscapes(spark):
    rng = np.random.default_rng(0)
    s = np.repeat(rng.random(40) < 0.7, 25)
    x = np.where(s, -3, 3) + rng.normal(0, 0.4, 1000)
    df = spark.createDataFrame([("r", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, rng.normal(0, 0.4, 1000), strict=True))], "replicate string, k int, x double, y double")
    bounds = landscape.value_range(df, "x", "y")
    g = landscape.grid(df, "x", "y", 12, bounds)
    basins = segment.basins(g.selectExpr("0 as one", "*"), "one", 12)
    boots = resample.bootstrap_landscapes(df, "replicate", ["k"], "x", "y", 12, bounds, 5, 25).persist()
    assert {round(r["p"], 9) for r in boots.groupBy("b").agg({"probability": "sum"}).withColumnRenamed("sum(probability)", "p").collect()} == {1.0}
    again = resample.resegmented(boots, basins, 12)
    assert again.where("basin_id is not null").count() >= 5 and resample.state_counts(again).agg({"resamples": "sum"}).first()[0] == 5
    assert resample.cell_intervals(boots, 5).where("support < 0.5 and sd is not null").count() == 0
    sys_ = resample.bootstrap_systems(df.selectExpr("'A' as system", "*", "x > 0 as right"), "system", "replicate", ["k"], "right", 4, 25)
    assert sys_.count() == 8


def test_subspace_overlaps(spark):
    rng = np.random.default_rng(1)
    rows = [(g, k, rng.normal(0, [5, 3, 1, 0.1]).tolist()) for g in (0, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    assert decompose.rmsip_pairs(df, "v", "g", 2)[0][2] > 0.98
    assert decompose.rmsip_progressive(df, "v", "g", ["k"], 2)[-1][1] == pytest.approx(1)
    assert decompose.extreme_structures(np.zeros(3), np.array([1.0, 0, 0]), 4.0, 3)[2, 0] == 4


def test_further_sources(spark, tmp_path):
    p = tmp_path / "proj.xvg"
    p.write_text("@ t\n0 1\n1 2\n&\n0 3\n1 4\n2 5\n&\n")
    assert [r["values"] for r in text.read_multiset(spark, f"file://{p}").orderBy("row").collect()] == [[1, 3], [2, 4]]
    c = tmp_path / "COLVAR"
    c.write_text("#! FIELDS time d\n0 1\n5 2\n")
    w = text.umbrella_windows(spark, [f"file://{c}"] * 2, "d", [0.0, 1.0], 3.0, skip=5)
    assert sorted(tuple(r) for r in w.collect()) == [(0, 0.0, 3.0, 5.0, 2.0), (1, 1.0, 3.0, 5.0, 2.0)]
    assert "mode 1 2.0000 1.00000" in sinks.nmd_text("t", ["CA"], ["ALA"], [0, 0, 0], np.eye(3)[:, :1], [4.0])
    x = tmp_path / "a.xyz"
    x.write_text("1\nc\nH 0 0 1\n1\nc\nH 0 0 2\n")
    assert text.frames_of(text.read_xyz(spark, f"file://{x}"), ["frame"]).orderBy("frame").collect()[1]["coords"] == [0, 0, 2]
    g = tmp_path / "a.gro"
    g.write_text("t\n    1\n    1ALA     CA    1   0.100   0.200   0.300\n 1 1 1\n")
    assert text.read_gro(spark, f"file://{g}").first()["z"] == pytest.approx(3)


def test_metadynamics_weights_wrap_and_sort(spark):
    """Weights from the table operator against plain sums, for a periodic variable and hills in no order."""
    from terrane.operators import reweight

    rng = np.random.default_rng(6)
    period, n = 2 * np.pi, 40
    hills = {"times": rng.permutation(n) * 1.0, "centers": rng.uniform(-np.pi, np.pi, (n, 1)), "sigmas": np.full((n, 1), 0.4), "heights": np.full(n, 1.2), "periods": [period], "spans": [(-np.pi, np.pi)]}
    x = rng.uniform(-np.pi, np.pi, 60)
    frames = spark.createDataFrame([(k, k * 0.7, float(v)) for k, v in enumerate(x)], "k int, time_ps double, phi double")
    a, kt = 1 / (1 - np.exp(-6.25)), 0.008314462618 * 300

    def kernel(d):
        q = 0.5 * ((d + np.pi) % period - np.pi) ** 2 / 0.16
        return np.where(q < 6.25, a * np.exp(-q) + 1 - a, 0)

    order = np.argsort(hills["times"])
    grid = np.linspace(-np.pi, np.pi, 200, endpoint=False)
    run = np.cumsum([1.2 * kernel(grid - hills["centers"][i, 0]) for i in order], axis=0)
    c = kt * (np.log(np.exp(10 * run / kt / 9).sum(1)) - np.log(np.exp(run / kt / 9).sum(1)))
    lw = {"final": [1.2 * kernel(v - hills["centers"][:, 0]).sum() / kt for v in x]}
    lw["rct"] = [(1.2 * kernel(v - hills["centers"][:, 0])[hills["times"] < k * 0.7].sum() - (c[m - 1] if (m := int((np.sort(hills["times"]) < k * 0.7).sum())) else 0)) / kt for k, v in enumerate(x)]
    for mode, values in lw.items():
        want = np.exp(values) / np.exp(values).sum() * len(x)
        got = [r["weight"] for r in reweight.metad_weights(frames, ["phi"], "time_ps", hills, mode=mode, factor=10.0).orderBy("k").collect()]
        assert np.allclose(got, want)
    assert reweight.in_time(hills)["times"].tolist() == sorted(hills["times"])

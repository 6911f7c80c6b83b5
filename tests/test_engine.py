"""Sources, operators on small tables, whole analyses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import api, cli
from terrane.config import Analysis, merged
from terrane.operators import joins, kinetics, landscape, residues, resample, states
from terrane.sources import sinks, text


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return f"file://{p}"


def test_index_groups(spark, tmp_path):
    p = write(tmp_path, "a.ndx", "[ System ]\n1 2 3 4 5 6\n[ C-alpha ]\n 2   5 ; ends\n[ Empty ]\n[ System ]\n9\n")
    rows = text.read_index(spark, p).collect()
    group = lambda n: [r["atom"] for r in sorted((r for r in rows if r["name"] == n and r["atom"] is not None), key=lambda r: r["ordinal"])]
    assert group("System") == [0, 1, 2, 3, 4, 5] and group("C-alpha") == [1, 4] and group("Empty") == []


def test_columns_and_weights(spark, tmp_path):
    p = write(tmp_path, "a.xvg", "# h\n@ x\n0 1.5 9 9 .3\n10 1.6 9 9 .3\n")
    assert [tuple(r)[2:] for r in text.read_columns(spark, p, [1, 4], 0).orderBy("line").collect()] == [(0.0, 1.5, 0.3), (10.0, 1.6, 0.3)]
    c = write(tmp_path, "a.csv", "time,d1,d2\n0,1,2\n1,3,4\n")
    assert [tuple(r)[2:] for r in text.read_columns(spark, c, [1, 2]).orderBy("line").collect()] == [(1.0, 2.0), (3.0, 4.0)]
    w = write(tmp_path, "w", "# t w\n0 2.0\n1 0.5\n")
    assert [r["weight"] for r in text.read_weights(spark, w).orderBy("line").collect()] == [2.0, 0.5]
    bad = write(tmp_path, "bad", "0 -1\n")
    with pytest.raises(Exception, match="negative"):
        text.read_weights(spark, bad).collect()


def test_plumed_and_hills(spark, tmp_path):
    body = "#! FIELDS time d1 d2\n#! SET min_d1 -pi\n0 1 2\n# note\n1 3 4\n#! FIELDS time d1 d2\n2 5 6\n"
    rows = text.read_plumed(spark, write(tmp_path, "COLVAR", body)).orderBy("row").collect()
    assert [r["values"]["d2"] for r in rows] == [2, 4, 6] and rows[0]["constants"]["min_d1"] == "-pi"
    assert text.plumed_number("-pi") == -math.pi and text.plumed_number("2*pi") == 2 * math.pi
    with pytest.raises(ValueError):
        text.parse_plumed("#! FIELDS a b\n1\n")
    h = text.parse_hills("#! FIELDS time phi sigma_phi height biasf\n#! SET min_phi -pi\n#! SET max_phi pi\n1 0.1 0.3 1.2 10\n2 0.2 0.3 1.1 10\n")
    assert np.allclose(h["heights"], [1.08, 0.99]) and h["periods"] == [pytest.approx(2 * math.pi)] and h["factor"] == 10
    with pytest.raises(ValueError):
        text.parse_hills("#! FIELDS time phi sigma_phi height biasf\n#! SET multivariate true\n1 0 1 1 1\n")


XPM = """/* XPM */
/* x-axis:  1 2 3 */
/* y-axis:  10 20 */
static char *g[] = {
"3 2 3 1",
"a  c #FFFFFF " /* "0.0" */,
"b  c #888888 " /* "5.5" */,
"c  c #000000 " /* "11.0" */,
"abc",
"cca"
};
"""


def test_xpm(spark, tmp_path):
    m = text.parse_xpm(XPM)
    assert m["values"].tolist() == [[11, 11, 0], [0, 5.5, 11]] and m["x"].tolist() == [1, 2, 3]
    assert text.read_xpm(spark, write(tmp_path, "a.xpm", XPM)).count() == 6
    with pytest.raises(ValueError):
        text.parse_xpm(XPM.replace('"cca"', '"cXa"'))


def test_pdb_round_trip(spark, tmp_path):
    atoms = spark.createDataFrame([(0, "CA", "ALA", "A", 1, 1.0, 2.0, 3.0), (1, "CB", "GLY", "A", 2, 4.0, 5.0, 6.5)], "ordinal int, atom_name string, residue_name string, chain string, residue_number int, x double, y double, z double")
    lines = [r["value"] for r in sinks.pdb_lines(atoms).orderBy("ordinal").collect()]
    back = text.read_pdb(spark, write(tmp_path, "a.pdb", "\n".join(lines))).orderBy("ordinal").collect()
    assert [(r["atom_name"], r["residue_number"], r["z"]) for r in back] == [("CA", 1, 3.0), ("CB", 2, 6.5)]
    assert text.residue_selection(atoms, "C-alpha").count() == 1 and text.residue_selection(atoms, "GLY").count() == 1


def frame(spark, states_, rep="r"):
    return spark.createDataFrame([(rep, k, 10.0 * k, s) for k, s in enumerate(states_)], "replicate string, frame int, time_ps double, state string")


def test_kinetics_known_answer(spark):
    df = frame(spark, "A A A B B A U A B B B".split())
    steps = kinetics.pairs(df, "replicate", ["time_ps"], "state", ["A", "B"])
    n = {(r["source"], r["target"]): r["n"] for r in kinetics.transition_counts(steps, ["A", "B"]).collect()}
    assert n == {("A", "A"): 3, ("A", "B"): 2, ("B", "A"): 1, ("B", "B"): 3}
    v = kinetics.visits(df, "replicate", ["time_ps"], "state", "time_ps", ["A", "B"], 10.0)
    assert v.count() == 4 and max(r["dwell"] for r in v.where("state = 'B'").collect()) == 30
    p = {(r["source"], r["target"]): r["probability"] for r in kinetics.transition_matrix(kinetics.transition_counts(steps, ["A", "B"])).collect()}
    assert p["A", "B"] == pytest.approx(0.4)


def test_bins_follow_edges(spark):
    x = np.arange(1, 51)
    df = spark.createDataFrame([(float(a), float(a % 7)) for a in x], "x double, y double")
    for bins in (7, 16, 49, 98):
        got = {(r["ix"], r["iy"]): r["frames"] for r in landscape.histogram(df, "x", "y", bins).collect()}
        h = np.histogram2d(x, x % 7, bins=bins)[0]
        assert got == {(i, j): h[i, j] for i, j in zip(*np.nonzero(h), strict=True)}
    flat = spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double")
    assert landscape.histogram(flat, "x", "y", 10).first()["frames"] == 3


def test_asof_ties_and_edges(spark):
    left = spark.createDataFrame([(0, 1, 10.0), (0, 2, 15.0), (0, 3, 100.0), (1, 4, 5.0)], "g int, k int, t double")
    right = spark.createDataFrame([(0, 10.0, "a"), (0, 20.0, "b")], "g int, t double, v string")
    near = {r["k"]: r["v"] for r in joins.asof(left, right, ["g"], "t", "v", "k", "nearest").collect()}
    assert near == {1: "a", 2: "a", 3: "b", 4: None}
    strict = {r["k"]: r["v"] for r in joins.asof(left, right, ["g"], "t", "v", "k", "backward", strict=True).collect()}
    assert strict == {1: None, 2: "a", 3: "b", 4: None}


def test_block_indices(spark):
    n = spark.createDataFrame([("r", 100)], "replicate string, n long")
    rows = resample.block_indices(n, "replicate", 3, 10).collect()
    for b in range(3):
        assert sum(r["times"] for r in rows if r["b"] == b) == 100


def test_contacts_strict_and_periodic(spark):
    a = spark.createDataFrame([(0, "p", 0.0)], "f int, g string, x double")
    b = spark.createDataFrame([(0, 4.5), (0, 9.0)], "f int, x double")
    assert residues.contacts(a, b, "f", "g", ["x"], 4.5).first()["in_contact"] is False
    assert residues.contacts(a, b, "f", "g", ["x"], 4.5, [10.0]).first()["min_distance"] == pytest.approx(1.0)


def test_state_ranking_keeps_one(spark):
    pops = spark.createDataFrame([(1, 0.02), (2, 0.01)], "basin_id int, population double")
    assert [r["state"] for r in states.ranked(pops).collect()] == ["A"]


def test_settings():
    assert merged({"bins": 20}, {"bins": 30, "stride": 2}) == Analysis(bins=20, stride=2)
    with pytest.raises(ValueError):
        merged({"nonsense": 1})
    with pytest.raises(ValueError):
        Analysis(temperature=-1)


def test_whole_analysis_and_comparison(spark, tmp_path):
    folder = f"file://{tmp_path}/frames"
    cli.example(spark, folder, frames=60, atoms=8)
    s = Analysis(components=3, bins=16, bootstrap=10, smooth_sigma=1.0)
    frames = api.load(spark, folder, s).withColumn("replicate", F.concat_ws("/", "system", "replicate"))
    out = api.analyze(frames, s)
    assert out.tables["frames"].count() == 240
    assert out.tables["states"].agg(F.sum("population")).first()[0] <= 1 + 1e-9
    assert {"transition_counts", "dwell_summary", "effective_samples", "bootstrap_intervals"} <= out.tables.keys()
    again = api.rebin(out.tables["projections"], Analysis(bins=16, bootstrap=0, smooth_sigma=1.0))
    assert again.tables["states"].orderBy("state").select("population").collect() == out.tables["states"].orderBy("state").select("population").collect()
    both = api.compare(frames, Analysis(components=3, bins=16, bootstrap=10))
    assert both.tables["overlaps"].count() == 1 and both.tables["differences"].count() > 0
    sinks.save({"states": out.tables["states"]}, f"file://{tmp_path}/out", {"k": 1})
    assert sinks.load(spark, f"file://{tmp_path}/out")[1] == {"k": 1}
    with pytest.raises(ValueError):
        api.kinetics_of(out.tables["frames"], Analysis(weight="w"))


def test_streaming_histogram(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(float(k % 10), float(k % 5)) for k in range(100)], "x double, y double").write.parquet(folder)
    from terrane.streaming import incremental

    stream = spark.readStream.schema("x double, y double").parquet(folder)
    q = incremental.streaming_histogram(stream, "x", "y", (0, 10, 0, 5), 5).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(frames) FROM cells").first()[0] == 100
    finally:
        q.stop()

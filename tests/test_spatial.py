"""Cells and boxes, selections, compressed trajectories, clustering, stateful streams."""

import itertools
import struct

import numpy as np
import pytest

from terrane.operators import clusters, decompose, features, msm, near
from terrane.sources import selection, text, xtc

BOXES = {"open": None, "orthorhombic": [9.0, 11.0, 13.0], "triclinic": [9.0, 11.0, 13.0, 70.0, 80.0, 100.0], "skewed": [[10.0, 0, 0], [13.0, 9.0, 0], [-6.0, 8.0, 8.0]]}


def plain_distance(a, b, box):
    if box is None:
        return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    m = near.lattice(box)
    shifts = np.array(list(itertools.product(range(-9, 10), repeat=3))) @ m
    return np.sqrt((((a[:, None] - b[None])[:, :, None] + shifts) ** 2).sum(3)).min(2)


@pytest.mark.parametrize("name", BOXES)
@pytest.mark.parametrize("pairs", [0, near.PAIRS])
def test_contacts_in_every_box(spark, name, pairs, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", pairs)
    rng, box = np.random.default_rng(1), BOXES[name]
    a, b = rng.uniform(-12, 25, (2, 60, 3)), rng.uniform(-12, 25, (2, 7, 3))
    left = spark.createDataFrame([(f, i // 6, *map(float, a[f, i])) for f in range(2) for i in range(60)], "frame long, g long, x double, y double, z double")
    right = spark.createDataFrame([(f, *map(float, b[f, i])) for f in range(2) for i in range(7)], "frame long, x double, y double, z double")
    expected = {(f, g): plain_distance(a[f], b[f], box).min(1).reshape(10, 6).min(1)[g] for f in range(2) for g in range(10)}
    rows = near.contacts(left, right, "frame", "g", ["x", "y", "z"], 2.5, box).collect()
    assert len(rows) == 20
    for r in rows:
        d = expected[r["frame"], r["g"]]
        assert abs(r["min_distance"] - d) < 1e-9 and r["in_contact"] == (d < 2.5)
    close = near.contacts(left, right, "frame", "g", ["x", "y", "z"], 2.5, box, distances=False).collect()
    assert {(r["frame"], r["g"]) for r in close} == {k for k, d in expected.items() if d < 2.5}


def test_reduced_lattices_are_the_same_lattice():
    for box in BOXES.values():
        if box is not None:
            m = near.lattice(box)
            r = near.reduced(m)
            change = r @ np.linalg.inv(m)
            assert np.allclose(change, np.rint(change)) and abs(abs(np.linalg.det(change)) - 1) < 1e-9
            short = np.sort([np.linalg.norm(np.array(s) @ m) for s in itertools.product(range(-4, 5), repeat=3) if any(s)])
            assert abs(np.linalg.norm(r, axis=1).min() - short[0]) < 1e-9
    assert np.allclose(near.lattice([2, 3, 4, 90, 90, 90]), np.diag([2, 3, 4]))
    with pytest.raises(ValueError):
        near.reduced(np.ones((3, 3)))


ATOMS = [("N", "ALA", "A", 1, 0.0), ("CA", "ALA", "A", 1, 1.0), ("CB", "ALA", "A", 1, 2.0), ("HA", "ALA", "A", 1, 1.5), ("N", "HIE", "A", 2, 5.0), ("CA", "HIE", "A", 2, 6.0), ("C1'", "DG", "B", 1, 8.0), ("O1", "LIG", None, 9, 9.5), ("2HO", "LIG", None, 9, 30.0), ("BB", "XYZ", "C", 4, 40.0)]


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame([(i, *a[:4], a[4], 0.0, 0.0) for i, a in enumerate(ATOMS)], "ordinal int, atom_name string, residue_name string, chain string, residue_number int, x double, y double, z double")


@pytest.mark.parametrize(
    ("words", "expected"),
    [
        ("name CA CB", [1, 2, 5]), ("name C*", [1, 2, 5, 6]), ("name ?A", [1, 3, 5]), ("protein and not name N", [1, 2, 3, 5]), ("resid 1:2 and chain A or resname LIG", [0, 1, 2, 3, 4, 5, 7, 8]),
        ("not (protein or nucleic)", [7, 8, 9]), ("resid 2-4 9", [4, 5, 7, 8, 9]), ("index 0 3:4", [0, 3, 4]), ("bynum 1", [0]), ("prop x >= 8.0 and prop x < 31", [6, 7, 8]), ("hydrogen", [3, 8]),
        ("around 1.6 of resname LIG", [6]), ("around 2 (name CA and resid 1)", [0, 2, 3]), ("byres around 1.6 resname LIG", [6]), ("same residue as name CB", [0, 1, 2, 3]), ("same chain as index 0", [0, 1, 2, 3, 4, 5]),
        ("same chain as resname LIG", [7, 8]), ("backbone", [0, 1, 4, 5]), ("sidechain", [2, 3]), ("none", []), ("protein and around 4.5 (around 1.6 resname LIG)", [4, 5]), ("not around 100 all", list(range(10))),
    ],
)
def test_selections(atoms, words, expected):
    assert sorted(r["ordinal"] for r in selection.Selection(words).of(atoms).collect()) == expected


@pytest.mark.parametrize("words", ["", "name", "name CA and", "(name CA", "resid x", "1 = 1", "around five all", "prop x ~ 3", "prop chain > 3", "same colour as all", "around 3"])
def test_selections_that_are_refused(words):
    with pytest.raises(ValueError):
        selection.Selection(words)


def test_groups_by_index_name_residue_and_chain(spark, atoms):
    index = spark.createDataFrame([("Pocket", 4), ("pocket", 7), ("far", 99)], "name string, atom int")
    got = lambda words: sorted(r["ordinal"] for r in selection.resolved(atoms, words, index).collect())
    assert got("POCKET") == [4, 7] and got("C-alpha") == [1, 5, 9] and got("LIG") == [7, 8] and got("B") == [6] and got("System") == list(range(10)) and got("Backbone") == [0, 1, 4, 5, 9]
    for words in ("far", "nobody", "name QQ", "resid 77"):
        with pytest.raises(ValueError):
            selection.resolved(atoms, words, index)
    assert text.residue_selection(atoms, "name CB or resname DG").count() == 2


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, n, x):
        self.value, self.n = self.value << n | x, self.n + n

    def mixed(self, n, numbers, sizes):
        value = numbers[0]
        for x, s in zip(numbers[1:], sizes[1:], strict=True):
            value = value * s + x
        raw = value.to_bytes(-(-n // 8) + 1, "little")
        while n > 8:
            self.put(8, raw[0])
            raw, n = raw[1:], n - 8
        if n:
            self.put(n, raw[0])

    def data(self):
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def encoded(points, step, time, precision=1000.0, draw=None, magic=xtc.MAGIC, wide=0):
    """A frame as the format defines it, with runs of near points and changes of the step wherever `draw` says."""
    n = len(points)
    head = struct.pack(">iiif9fi", magic, n, step, time, *([1.0, 0, 0, 0, 2.0, 0, 0.5, 0, 3.0]), n)
    if n <= 9:
        return head + np.asarray(points, ">f4").tobytes()
    whole = np.rint(np.asarray(points) * precision).astype(int)
    low, high = whole.min(0), whole.max(0) + wide
    sizes = (high - low + 1).tolist()
    at, bits, k, run, written = 20, Bits(), 0, 0, []
    split = max(sizes) > 0xFFFFFF
    while k < n:
        half, radix = xtc.STEPS[at] // 2, xtc.STEPS[at]
        order, take = [k], 0
        near_ = lambda a, b, half=half, radix=radix: all(0 <= x + half < radix for x in (whole[b] - whole[a]).tolist())
        if draw is not None and draw.random() < 0.8 and k + 1 < n and near_(k + 1, k):
            # the second point of a pair is stored first
            order, take = [k + 1, k], 1
            while take < 8 and k + take + 1 < n and near_(k if take == 1 else k + take, k + take + 1):
                order.append(k + take + 1)
                take += 1
        full = (whole[order[0]] - low).tolist()
        if split:
            for x, s in zip(full, sizes, strict=True):
                bits.put(s.bit_length(), x)
        else:
            bits.mixed((sizes[0] * sizes[1] * sizes[2]).bit_length(), full, sizes)
        change = 0 if draw is None else int(draw.integers(-1, 2))
        if not xtc.FIRST_STEP < at + change < 40:
            change = 0
        if 3 * take != run or change:
            bits.put(1, 1)
            bits.put(5, 3 * take + change + 1)
            run = 3 * take
        else:
            bits.put(1, 0)
        before = whole[order[0]]
        for p in order[1:]:
            bits.mixed(at, (whole[p] - before + half).tolist(), [radix] * 3)
            before = whole[p]
        at += change
        written += order
        k += take + 1
    data = bits.data()
    length = struct.pack(">q" if magic == xtc.MAGIC_LONG else ">i", len(data))
    return head + struct.pack(">f7i", precision, *low.tolist(), *high.tolist(), 20) + length + data + bytes(-len(data) % 4)


def test_compressed_trajectories(spark, tmp_path):
    draw = np.random.default_rng(0)
    frames = []
    for f in range(40):
        n = 57
        p = draw.uniform(-3, 3, (n, 3))
        for i in range(1, n):
            if draw.random() < 0.8:
                p[i] = p[i - 1] + draw.uniform(-0.03, 0.03, 3)
        frames.append(p)
    data = [encoded(p, 10 * f, 2.0 * f, draw=draw if f % 4 else None, magic=xtc.MAGIC_LONG if f % 7 == 3 else xtc.MAGIC, wide=2**25 if f % 5 == 0 else 0) for f, p in enumerate(frames)]
    (tmp_path / "a.xtc").write_bytes(b"".join(data) + data[0][:70])  # a frame that was cut off
    few = [draw.uniform(-1, 1, (3, 3)) for _ in range(4)]
    (tmp_path / "b.xtc").write_bytes(b"".join(encoded(p, f, float(f)) for f, p in enumerate(few)))
    rows = xtc.read_xtc(spark, str(tmp_path / "a.xtc"), frames=6).orderBy("frame").collect()
    assert [r["frame"] for r in rows] == list(range(40)) and [r["step"] for r in rows] == [10 * f for f in range(40)] and [r["time_ps"] for r in rows] == [2.0 * f for f in range(40)]
    for r, p in zip(rows, frames, strict=True):
        assert np.allclose(np.array(r["coords"]).reshape(-1, 3), 10 * np.rint(p * 1000) / 1000, atol=1e-5)
    assert rows[0]["box"] == [10.0, 0, 0, 0, 20.0, 0, 5.0, 0, 30.0]
    some = xtc.read_xtc(spark, str(tmp_path / "a.xtc"), stride=3, begin=10.0, end=50.0, atoms=[4, 0], frames=2)
    assert some.rdd.getNumPartitions() == 4
    some = some.orderBy("frame").collect()
    assert [r["frame"] for r in some] == [6, 9, 12, 15, 18, 21, 24] and all(len(r["coords"]) == 6 for r in some)
    assert np.allclose(some[0]["coords"][3:], 10 * np.rint(frames[6][0] * 1000) / 1000, atol=1e-5)
    both = xtc.read_xtc(spark, [str(tmp_path / "b.xtc"), str(tmp_path / "a.xtc")])
    assert both.count() == 44 and both.where("size(coords) = 9").count() == 4
    assert xtc.read_xtc(spark, str(tmp_path / "a.xtc"), begin=1e6).count() == 0
    (tmp_path / "c.xtc").write_bytes(b"not a trajectory" * 20)
    with pytest.raises(Exception, match="no frame at byte 0"):
        xtc.read_xtc(spark, str(tmp_path / "c.xtc")).count()


def greedy(x, d):
    out = []
    for p in x:
        if not out or ((np.array(out) - p) ** 2).sum(1).min() > d * d:
            out.append(p)
    return np.array(out)


def test_regular_space_as_frame_by_frame(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (900, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double").repartition(5)
    for size in (7, 200, 20_000):
        monkeypatch.setattr(clusters, "ROUND", size)
        assert np.array_equal(clusters.regular_space(df, ["a", "b"], 0.9, ["i"]), greedy(x, 0.9))
    assert np.array_equal(clusters.regular_space(df, ["a", "b"], 0.9, ["i"], stride=4), greedy(x[::4], 0.9))
    with pytest.raises(ValueError, match="more than 5"):
        clusters.regular_space(df, ["a", "b"], 0.9, ["i"], most=5)
    assert len(clusters.regular_space(df.limit(0), ["a", "b"], 1.0, ["i"])) == 0
    at = clusters.assigned(df, ["a", "b"], greedy(x, 0.9)).collect()
    assert all(r["distance2"] <= 0.81 for r in at)


def test_kmeans_finds_blobs_and_refills_empty_clusters(spark):
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [20, 20.0]])
    x = np.vstack([c + 0.3 * rng.standard_normal((80, 2)) for c in centers])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(4)
    found, spread = clusters.kmeans(df, ["a", "b"], 5, n_init=2)
    assert np.allclose(found[np.lexsort(found.T)], np.array([x[80 * k : 80 * k + 80].mean(0) for k in range(5)])[np.lexsort(np.array([x[80 * k : 80 * k + 80].mean(0) for k in range(5)]).T)], atol=1e-6)
    assert abs(spread - sum(((x[80 * k : 80 * k + 80] - x[80 * k : 80 * k + 80].mean(0)) ** 2).sum() for k in range(5))) < 1e-6
    bad = np.array([[5, 5], [500, 500], [600, 600], [0, 0.0], [20, 20]])
    refilled, spread2 = clusters.kmeans(df, ["a", "b"], 5, init=bad)
    assert len(refilled) == 5 and spread2 < 3000 and np.isfinite(refilled).all()
    n, _, _, far = clusters._sums(df, ["a", "b"], bad[[3]], 3)
    assert n[0] == 400 and np.allclose(far, x[np.argsort(-(x**2).sum(1))[:3]])
    same = spark.createDataFrame([(1.0,)] * 5, "a double")
    assert clusters.kmeans(same, ["a"], 3)[0].tolist() == [[1.0]]


def test_streams_keep_state(spark, tmp_path):
    from terrane.streaming import stateful

    parts = [[("u", 1, "a"), ("u", 2, "a"), ("v", 1, "b")], [("u", 4, "b"), ("u", 3, "a"), ("v", 1, "c"), ("v", 5, "b")], [("u", 5, "b"), ("u", 2, "c"), ("u", 6, "a"), ("v", 6, "a"), (None, 1, "a")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame([(r, t, s, [float(t), float(t * t)]) for r, t, s in rows], "rep string, t long, state string, v array<double>").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("rep string, t long, state string, v array<double>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stateful.ended_visits(stream, "rep", "t", "state").writeStream.format("memory").queryName("visits").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = sorted((r["rep"], r["visit"], r["state"], r["start_time"], r["end_time"], r["frames"]) for r in spark.table("visits").collect())
    assert rows == [("u", 1, "a", 1, 3, 3), ("u", 2, "b", 4, 5, 2), ("v", 1, "b", 1, 5, 2)] or rows[-1] == ("v", 1, "b", 1, 5, 2)
    late = {(r["rep"], r["visit"]): r["late"] for r in spark.table("visits").collect()}
    assert late["v", 1] == 1
    q = stateful.running_moments(stream, "rep", "v").writeStream.format("memory").queryName("moments").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["rep"]: r for r in spark.table("moments").orderBy("n").collect()}
    x = np.array([[t, t * t] for p in parts for r, t, _ in p if r == "u"], float)
    assert last["u"]["n"] == len(x) and np.allclose(last["u"]["mean"], x.mean(0)) and np.allclose(np.array(last["u"]["m2"]).reshape(2, 2), len(x) * np.cov(x.T, bias=True))


def test_side_chains_of_protonated_residues():
    by_name = features.wanted(("chi1", "chi2"), True)
    ends = {(kind, name): atom for kind, _, name, corner, atom, _ in by_name if corner == 3}
    assert ends["chi1", "HIE"] == "CG" and ends["chi1", "CYX"] == "SG" and ends["chi2", "HSP"] == "ND1" and ends["chi2", "GLH"] == "CD" and ends["chi2", "ASH"] == "OD1" and ends["chi2", "LYN"] == "CD"
    assert ("chi2", "CYM") not in ends


def test_coarse_matrix_is_stochastic_and_reversible():
    rng = np.random.default_rng(0)
    flux = rng.random((6, 6))
    flux = flux + flux.T + 30 * np.kron(np.eye(2), np.ones((3, 3)))
    t, pi = flux / flux.sum(1, keepdims=True), flux.sum(1) / flux.sum()
    chi = np.kron(np.eye(2), np.ones((3, 1))) * 0.9 + 0.05
    m, p = msm.coarse_grained(t, chi, pi)
    plain = np.linalg.inv(chi.T @ chi) @ chi.T @ t @ chi
    x = (chi.T @ pi)[:, None] * plain
    x = (x + x.T) / 2
    assert np.allclose(m, x / x.sum(1, keepdims=True)) and np.allclose(p, x.sum(1)) and np.allclose(p[:, None] * m, (p[:, None] * m).T)


def test_tica_reduces_when_pairs_are_few(spark):
    rng = np.random.default_rng(5)
    slow = np.cumsum(rng.standard_normal((2, 120)), 1)
    x = slow[:, :, None] * rng.standard_normal(40) + 0.3 * rng.standard_normal((2, 120, 40))
    df = spark.createDataFrame([(r, i, x[r, i].tolist()) for r in range(2) for i in range(120)], "rep long, i long, v array<double>")
    p = decompose.tica(df, "v", "rep", ["i"], 4, 3)
    flat = x.reshape(-1, 40)
    mean, cov = decompose.covariance({r: decompose.of_rows(x[r]) for r in range(2)})
    axes = decompose.eigen(cov, 23)[2]  # a tenth of 232 pairs
    short = df.sparkSession.createDataFrame([(r, i, ((x[r, i] - mean) @ axes).tolist()) for r in range(2) for i in range(120)], "rep long, i long, v array<double>")
    plain = decompose.tica(short, "v", "rep", ["i"], 4, 3, most=None)
    assert p["vectors"].shape == (40, 3) and np.allclose(p["eigenvalues"], plain["eigenvalues"], atol=1e-8)
    series = (flat - p["mean"]) @ p["vectors"][:, 0]
    assert abs(np.corrcoef(series, slow.ravel())[0, 1]) > 0.95
    whole = decompose.tica(df, "v", "rep", ["i"], 4, 3, most=None)
    assert whole["eigenvalues"][1] > p["eigenvalues"][1]

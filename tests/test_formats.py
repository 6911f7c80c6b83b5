"""Structure files and uncompressed trajectories against the numbers they were written from."""

import struct

import numpy as np
import pytest

from terrane import api
from terrane.config import Analysis
from terrane.sources import text
from terrane.sources.structures import read_cif, read_crd, read_mol2, read_structure
from terrane.sources.trajectories import cell_vectors, read_trajectory

HEADS = ["group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id", "pdbx_PDB_model_num"]


def cif_row(k, model=1):
    name = ("CA", "\"O5'\"", "'C 1'", "N")[k % 4]
    return ["ATOM", str(k + 1), name, "ALA", "A", str(k // 4 + 1), f"{k * 0.5:.3f}", f"{-k:.3f}", "1.000", str(k // 4 + 10), "?" if k % 2 else "B", str(model)]


def written(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return f"file://{tmp_path}/{name}"


def atoms(df):
    return [tuple(r)[1:] for r in df.select("path", "model", "ordinal", "atom_name", "residue_name", "chain", "residue_number", "x", "y", "z").orderBy("path", "model", "ordinal").collect()]


def expected(k, model=1, ordinal=None):
    return (model, k if ordinal is None else ordinal, ("CA", "O5'", "C 1", "N")[k % 4], "ALA", "A" if k % 2 else "B", k // 4 + 10, k * 0.5, float(-k), 1.0)


def test_cif_by_splits_of_files(spark, tmp_path):
    head = "data_ONE\n_entry.id ONE\nloop_\n_struct.text\n;a field with\n_atom_site.id\nloop_\n;\n#\nloop_\n" + "".join(f"_atom_site.{h}\n" for h in HEADS)
    rows = [cif_row(k) for k in range(120)]
    lines = [" ".join(r) for r in rows[:40]]
    loose = [v for r in rows[40:60] for v in r]  # rows broken and joined anywhere
    lines += [" ".join(loose[k : k + 7]) + (" # remark" if k % 3 == 0 else "") for k in range(0, len(loose), 7)]
    lines += ["", *("\t".join(r) for r in rows[60:])]
    body = head + "\n".join(lines) + "\n#\nloop_\n_other.a\n1\n2\n"
    p = written(tmp_path, "a.cif", body)
    want = [expected(k) for k in range(120)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size == "700b" else "4MB")
            assert atoms(read_cif(spark, p)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cif_models_blocks_and_errors(spark, tmp_path):
    head = "loop_\n" + "".join(f"_atom_site.{h}\n" for h in HEADS)
    rows = lambda m: "\n".join(" ".join(cif_row(k, m)) for k in range(3)) + "\n"
    p = written(tmp_path, "b.cif", "data_A\n" + head + rows(1) + rows(2) + "data_B\n" + head + rows(1))
    for entry, models in ((0, (1, 2)), (1, (1,))):
        assert atoms(read_cif(spark, p).where(f"entry = {entry}")) == [expected(k, m) for m in models for k in range(3)]
    assert atoms(read_structure(spark, p)) == [expected(k, m) for m in (1, 2) for k in range(3)]
    few = written(tmp_path, "c.cif", "data_A\nloop_\n_atom_site.Cartn_x\n_atom_site.cartn_y\n_atom_site.CARTN_Z\n1 2 .\n")
    assert atoms(read_cif(spark, few)) == [(1, 0, None, None, None, None, 1.0, 2.0, None)]
    assert atoms(read_cif(spark, written(tmp_path, "d.cif", "data_A\n_atom_site.id 1\n"))) == []
    assert atoms(read_cif(spark, written(tmp_path, "e.cif", ""))) == []
    with pytest.raises(Exception, match="no whole row"):
        read_cif(spark, written(tmp_path, "f.cif", "data_A\n" + head + "ATOM 1\n")).collect()
    with pytest.raises(Exception, match="text field"):
        read_cif(spark, written(tmp_path, "g.cif", "data_A\n" + head + ";\nx\n;\n")).collect()


def test_mol2_molecules(spark, tmp_path):
    one = "@<TRIPOS>MOLECULE\nname\n 3 1\nSMALL\n@<TRIPOS>ATOM\n 1 C1 0.5 1.5 -2 C.3 7 ALA7 -0.25\n# remark\n 2 N1 1 2 3 N.am \\\n 8 HIS\n\n 3 O1 0 0 0 O.2\n@<TRIPOS>BOND\n 1 1 2 1\n"
    p = written(tmp_path, "m.mol2", one * 40)
    want = [(0, "C1", "ALA", 7, 0.5, 1.5, -2.0, "C.3", -0.25), (1, "N1", "HIS", 8, 1.0, 2.0, 3.0, "N.am", None), (2, "O1", None, None, 0.0, 0.0, 0.0, "O.2", None)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size == "300b" else "4MB")
            rows = read_mol2(spark, p).orderBy("model", "ordinal").select("ordinal", "atom_name", "residue_name", "residue_number", "x", "y", "z", "atom_type", "charge").collect()
            assert [tuple(r) for r in rows] == want * 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(Exception, match="lacks coordinates"):
        read_mol2(spark, written(tmp_path, "n.mol2", "@<TRIPOS>ATOM\n1 C1 x y z C.3\n")).collect()


def test_structures_by_ending(spark, tmp_path):
    usual = "* title\n*\n    2\n    1    1 ALA  N      1.00000   2.00000   3.00000 SEG1 10     0.00000\n    2    1 ALA  CA    -1.00000   0.50000   0.25000 SEG1 10     0.00000\n"
    p = written(tmp_path, "a.crd", usual)
    assert atoms(read_crd(spark, p)) == [(1, 0, "N", "ALA", "SEG1", 10, 1.0, 2.0, 3.0), (1, 1, "CA", "ALA", "SEG1", 10, -1.0, 0.5, 0.25)]
    assert atoms(read_structure(spark, p)) == atoms(read_crd(spark, p))
    pdb = "ATOM      1  N   ALA A   5       1.000   2.000   3.000  1.00  0.00    -0.350 N\n"
    for name in ("a.pdb", "a.ent", "a.pdbqt"):
        assert atoms(read_structure(spark, written(tmp_path, name, pdb))) == [(1, 0, "N", "ALA", "A", 5, 1.0, 2.0, 3.0)]
    assert atoms(read_structure(spark, written(tmp_path, "a.xyz", "1\nt\nC 1 2 3\n1\nt\nC 4 5 6\n"))) == [(1, 0, "C", None, None, None, 1.0, 2.0, 3.0), (2, 0, "C", None, None, None, 4.0, 5.0, 6.0)]
    assert text.reference_coordinates(spark, written(tmp_path, "b.mol2", "@<TRIPOS>MOLECULE\n@<TRIPOS>ATOM\n1 C 1 2 3 C.3\n2 C 4 5 6 C.3\n")) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="no reader"):
        read_structure(spark, "a.doc")


def trr_frame(points, step, time, kind="f", box=True, velocities=False):
    n, w = len(points), 4 if kind == "f" else 8
    sizes = [0, 0, 9 * w if box else 0, 0, 0, 0, 0, 3 * n * w, 3 * n * w if velocities else 0, 0]
    head = struct.pack(">3i", 1993, 13, 12)[:8] + struct.pack(">i", 12) + b"GMX_trn_file" + struct.pack(">13i", *sizes, n, step, 0) + struct.pack(f">2{kind}", time, 0.0)
    parts = [np.eye(3) * 4.0] * box + [points] + [points * 9] * velocities
    return head + b"".join(np.asarray(x, f">f{w}").tobytes() for x in parts)


def test_trr_frames(spark, tmp_path):
    points = np.random.default_rng(1).normal(size=(20, 5, 3)).astype(np.float32)
    data = [trr_frame(p, 10 * k, 2.0 * k, "fd"[k % 2], k % 3 > 0, k % 4 == 0) for k, p in enumerate(points)]
    (tmp_path / "a.trr").write_bytes(b"".join(data) + data[0][:50])
    rows = read_trajectory(spark, str(tmp_path / "a.trr"), frames=6).orderBy("frame").collect()
    assert [(r["frame"], r["step"], r["time_ps"]) for r in rows] == [(k, 10 * k, 2.0 * k) for k in range(20)]
    assert np.allclose([r["coords"] for r in rows], points.reshape(20, 15) * 10, rtol=1e-6)
    assert rows[0]["box"] is None and rows[1]["box"] == [40, 0, 0, 0, 40, 0, 0, 0, 40]
    some = read_trajectory(spark, f"{tmp_path}/*.trr", stride=3, begin=5.0, end=30.0, atoms=[4, 0], frames=2)
    assert [(r["frame"], len(r["coords"])) for r in some.orderBy("frame").collect()] == [(k, 6) for k in (3, 6, 9, 12, 15)]
    (tmp_path / "b.trr").write_bytes(b"no trajectory" * 20)
    with pytest.raises(Exception, match="not a frame"):
        read_trajectory(spark, str(tmp_path / "b.trr")).count()
    with pytest.raises(ValueError, match="no reader"):
        read_trajectory(spark, "a.nc")


@pytest.mark.parametrize("order", ["<", ">"])
def test_dcd_of_either_byte_order(spark, tmp_path, order):
    points = np.random.default_rng(2).normal(size=(9, 12, 3)).astype("f4")
    block = lambda b: struct.pack(f"{order}i", len(b)) + b + struct.pack(f"{order}i", len(b))
    for cell in (0, 1):
        head = [9, 100, 5, 0, 0, 0, 0, 0, 0]
        header = b"CORD" + struct.pack(f"{order}9i", *head) + struct.pack(f"{order}f", 2.0) + struct.pack(f"{order}10i", cell, *[0] * 8, 24)
        box = block(struct.pack(f"{order}6d", 30, 90, 40, 90, 90, 50)) if cell else b""
        body = b"".join(box + b"".join(block(f[:, a].astype(f"{order}f4").tobytes()) for a in range(3)) for f in points)
        (tmp_path / f"{cell}.dcd").write_bytes(block(header) + block(struct.pack(f"{order}i", 1) + b"x" * 80) + block(struct.pack(f"{order}i", 12)) + body + b"cut")
        rows = read_trajectory(spark, str(tmp_path / f"{cell}.dcd"), frames=4, time_unit=1.0).orderBy("frame").collect()
        assert [(r["step"], r["time_ps"]) for r in rows] == [(100 + 5 * k, 10.0 * k) for k in range(9)]
        assert [r["coords"] for r in rows] == points.reshape(9, 36).tolist()
        assert rows[0]["box"] == ([30, 0, 0, 0, 40, 0, 0, 0, 50] if cell else None)
    both = api.load(spark, f"{tmp_path}/0.dcd;{tmp_path}/1.dcd", Analysis(stride=4))
    assert [(r[0][-5:], r[1]) for r in both.select("replicate", "frame").orderBy("replicate", "frame").collect()] == [(f"{c}.dcd", k) for c in (0, 1) for k in (0, 4, 8)]


def test_oblique_cells():
    v = np.array(cell_vectors(np.array([10.0, 60.0, 8.0, 75.0, 80.0, 6.0]))).reshape(3, 3)
    lengths = np.linalg.norm(v, axis=1)
    angle = lambda a, b: np.degrees(np.arccos(v[a] @ v[b] / lengths[a] / lengths[b]))
    assert np.allclose(lengths, [10, 8, 6]) and np.allclose([angle(0, 1), angle(0, 2), angle(1, 2)], [60, 75, 80])

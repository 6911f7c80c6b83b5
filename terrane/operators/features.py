"""Backbone and side-chain dihedrals as features: definitions by joins on the atom table, angles as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Atoms of backbone dihedrals of proteins and nucleic acids with the residue they are taken from, relative to the residue in question (fixed values, IUPAC).
BACKBONE = {
    "phi": (("C", -1), ("N", 0), ("CA", 0), ("C", 0)),
    "psi": (("N", 0), ("CA", 0), ("C", 0), ("N", 1)),
    "omega": (("CA", 0), ("C", 0), ("N", 1), ("CA", 1)),
    "alpha": (("O3'", -1), ("P", 0), ("O5'", 0), ("C5'", 0)),
    "beta": (("P", 0), ("O5'", 0), ("C5'", 0), ("C4'", 0)),
    "gamma": (("O5'", 0), ("C5'", 0), ("C4'", 0), ("C3'", 0)),
    "delta": (("C5'", 0), ("C4'", 0), ("C3'", 0), ("O3'", 0)),
    "epsilon": (("C4'", 0), ("C3'", 0), ("O3'", 0), ("P", 1)),
    "zeta": (("C3'", 0), ("O3'", 0), ("P", 1), ("O5'", 1)),
}
#: Glycosidic dihedrals, of purines and of pyrimidines (fixed values, IUPAC).
GLYCOSIDIC = (("O4'", "C1'", "N9", "C4"), ("O4'", "C1'", "N1", "C2"))
#: Third atoms beyond CB and fourth atoms beyond those of side chains by residue (fixed values, IUPAC).
GAMMA = {"ARG": "CG", "ASN": "CG", "ASP": "CG", "CYS": "SG", "GLN": "CG", "GLU": "CG", "HIS": "CG", "ILE": "CG1", "LEU": "CG", "LYS": "CG", "MET": "CG", "PHE": "CG", "PRO": "CG", "SER": "OG", "THR": "OG1", "TRP": "CG", "TYR": "CG", "VAL": "CG1"}
DELTA = {"ARG": ("CD",), "ASN": ("OD1",), "ASP": ("OD1",), "GLN": ("CD",), "GLU": ("CD",), "HIS": ("ND1",), "ILE": ("CD1", "CD"), "LEU": ("CD1",), "LYS": ("CD",), "MET": ("SD",), "PHE": ("CD1",), "PRO": ("CD",), "TRP": ("CD1",), "TYR": ("CD1",)}

#: Names of protonation states and of disulphide-bridged residues, by the amino acid whose heavy atoms they have (fixed values).
STATES_OF = {"HIS": "HID HIE HIP HSD HSE HSP", "CYS": "CYX CYM", "LYS": "LYN", "ASP": "ASH", "GLU": "GLH"}


def _named(name: str) -> list[str]:
    """The names under which an amino acid comes."""
    return [name, *STATES_OF.get(name, "").split()]


def wanted(kinds: tuple[str, ...], by_name: bool) -> list[tuple]:
    """(kind, variant, residue_name, corner, atom, offset): what each dihedral is made of; a lower variant is preferred, no residue name fits all."""
    out: list[tuple] = []
    for kind in kinds:
        if kind in BACKBONE:
            out += [(kind, 0, None, c, atom, offset) for c, (atom, offset) in enumerate(BACKBONE[kind])]
        elif kind == "chi":
            out += [(kind, v, None, c, atom, 0) for v, spec in enumerate(GLYCOSIDIC) for c, atom in enumerate(spec)]
        elif kind == "chi1" and not by_name:
            out += [(kind, v, None, c, atom, 0) for v, end in enumerate(dict.fromkeys(GAMMA.values())) for c, atom in enumerate(("N", "CA", "CB", end))]
        elif kind == "chi1":
            out += [(kind, 0, own, c, atom, 0) for name, end in GAMMA.items() for own in _named(name) for c, atom in enumerate(("N", "CA", "CB", end))]
        elif kind == "chi2" and by_name:
            out += [(kind, v, own, c, atom, 0) for name, ends in DELTA.items() for own in _named(name) for v, end in enumerate(ends) for c, atom in enumerate(("CA", "CB", GAMMA[name], end))]
        else:
            raise ValueError(f"no dihedral {kind!r}" if kind != "chi2" else "chi2 needs residue names")
    return out


def definitions(atoms: DataFrame, kinds: tuple[str, ...] = ("phi", "psi")) -> DataFrame:
    """(kind, chain, residue_number, i, j, k, l): atom ordinals of each dihedral that exists, from one join with the table of what they are made of and one aggregation.

    Neighbours are residues of the same chain whose number differs by exactly one; phi is kept only where psi exists too. Side chains go by residue
    name if atoms have one.
    """
    by_name = "residue_name" in atoms.columns
    parts = F.broadcast(atoms.sparkSession.createDataFrame(wanted(kinds, by_name), "kind string, variant int, only string, corner int, name string, offset int"))
    w = Window.partitionBy("chain", "residue_number", "name").orderBy("ordinal")
    a = atoms.select("chain", "residue_number", F.translate("atom_name", "*", "'").alias("name"), "ordinal", *(["residue_name"] if by_name else []))
    a = a.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    hit = a.join(parts, "name")
    hit = hit.where("only is null or only = upper(residue_name)") if by_name else hit
    corner = [F.max(F.when(F.col("corner") == k, F.col("ordinal"))).alias(c) for k, c in enumerate("ijkl")]
    found = hit.groupBy("kind", "variant", "chain", (F.col("residue_number") - F.col("offset")).alias("residue_number")).agg(*corner).where(" and ".join(f"{c} is not null" for c in "ijkl"))
    best = found.groupBy("kind", "chain", "residue_number").agg(F.min(F.struct("variant", "i", "j", "k", "l")).alias("b")).select("kind", "chain", "residue_number", "b.i", "b.j", "b.k", "b.l")
    if not {"phi", "psi"} <= set(kinds):
        return best
    also = F.max(F.col("kind") == "psi").over(Window.partitionBy("chain", "residue_number"))
    return best.withColumn("_psi", also).where("kind != 'phi' or _psi").drop("_psi")


def with_features(frames: DataFrame, coords: str, quads: list[tuple[int, int, int, int]], name: str = "features") -> DataFrame:
    """Frames with cosines of all dihedrals, then their sines, as one array of floats. Definitions are as many as residues and become literals."""
    from terrane.operators.residues import dihedral

    def point(q: Column, corner: str) -> list[Column]:
        return [F.get(F.col(coords), q[corner] * 3 + c).cast("double") for c in range(3)]

    table = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("ijkl", q, strict=True))) for q in quads))
    angles = F.transform(table, lambda q: F.radians(dihedral([point(q, c) for c in "ijkl"])))
    out = frames.withColumn("_a", angles)
    return out.withColumn(name, F.concat(F.transform("_a", lambda a: F.cos(a).cast("float")), F.transform("_a", lambda a: F.sin(a).cast("float")))).drop("_a")

"""A selection language over atom tables, compiled to columns.

    selection := term ("or" term)*          term := factor ("and" factor)*          factor := "not" factor | "(" selection ")" | test
    test := all | none | protein | nucleic | backbone | sidechain | hydrogen | heavy
          | name A B* ... | resname ... | chain ... (segid, chainid) | resid 3 5:9 12-14 ... (resnum) | index 0 4:7 (from 0) | bynum 1:8 (from 1)
          | prop x <= 3.5 | around 4.5 [of] factor | byres factor | same residue as factor | same chain as factor

Names may hold `*` and `?`. Nothing of a text is run as SQL: names become literals. `around` is a spatial semi-join by cells, without the atoms
of the selection itself; `byres` and `same` are semi-joins on their columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.near import within

#: Residue names of proteins: the twenty amino acids, their protonation states and common variants; of nucleic acids (fixed values).
AMINO = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL ASH CYM CYX GLH HID HIE HIP HSD HSE HSP LYN MSE".split()
NUCLEIC = "A C G U T DA DC DG DT DU ADE CYT GUA THY URA".split()
MARTINI = "BB SC1 SC2 SC3 SC4 SC5".split()
#: Names of groups as simulation packages write them (fixed values), as selections.
GROUPS = {
    "backbone": "(protein and name N CA C) or name BB",
    "mainchain": "(protein and name N CA C O) or name BB",
    "main-chain": "(protein and name N CA C O) or name BB",
    "c-alpha": "name CA BB",
    "calpha": "name CA BB",
    "ca": "name CA BB",
    "protein": "protein or name BB SC1 SC2 SC3 SC4 SC5",
    "sidechain": "(protein and not name N CA C O) or name SC1 SC2 SC3 SC4 SC5",
    "heavy": "heavy",
    "system": "all",
}
_TOKEN = re.compile(r"\(|\)|<=|>=|==|!=|<|>|[^\s()<>=!]+")
_NAMES = {"name": "atom_name", "resname": "residue_name", "chain": "chain", "segid": "chain", "chainid": "chain"}
_RANGES = {"resid": ("residue_number", 0), "resnum": ("residue_number", 0), "index": ("ordinal", 0), "bynum": ("ordinal", 1)}
_ALONE = ("all", "none", "protein", "nucleic", "backbone", "sidechain", "hydrogen", "heavy")
_WORDS = {*_NAMES, *_RANGES, *_ALONE, "and", "or", "not", "prop", "around", "byres", "same", "(", ")"}
_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def matches(column: str, patterns: list[str]) -> Column:
    plain = [p for p in patterns if not re.search(r"[*?]", p)]
    wild = [F.col(column).rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$") for p in patterns if re.search(r"[*?]", p)]
    return F.coalesce(_any([F.col(column).isin(plain), *wild] if plain else wild), F.lit(False))


class Selection:
    """Reads one text; `of` gives the atoms of a table that it selects.

    Atoms have ordinal, atom_name, residue_name, chain and residue_number, and x, y, z where `around` is used. A text that cannot be read is a ValueError.
    """

    def __init__(self, text: str, box: list | None = None):
        self.tokens, self.at, self.box = _TOKEN.findall(text), 0, box
        if not self.tokens:
            raise ValueError("an empty selection")
        self.tree = self._either()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at]!r} is not understood")

    def _peek(self) -> str:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else ""

    def _next(self, what: str) -> str:
        if self.at >= len(self.tokens):
            raise ValueError(f"{what} is missing at the end")
        self.at += 1
        return self.tokens[self.at - 1]

    def _either(self) -> tuple:
        out = self._both()
        while self._peek() == "or":
            self.at += 1
            out = ("or", out, self._both())
        return out

    def _both(self) -> tuple:
        out = self._factor()
        while self._peek() == "and":
            self.at += 1
            out = ("and", out, self._factor())
        return out

    def _factor(self) -> tuple:
        word = self._next("a test").lower()
        if word == "not":
            return ("not", self._factor())
        if word == "(":
            out = self._either()
            if self._next("a closing parenthesis") != ")":
                raise ValueError("a closing parenthesis is missing")
            return out
        if word in _ALONE:
            return (word,)
        if word in _NAMES or word in _RANGES:
            values = []
            while self.at < len(self.tokens) and self._peek() not in _WORDS:
                values.append(self._next("a value"))
            if not values:
                raise ValueError(f"{word} needs values")
            return (word, values if word in _NAMES else [self._range(v) for v in values])
        if word == "prop":
            column, sign, value = self._next("a column"), self._next("a comparison"), self._next("a number")
            if column.lower() not in ("x", "y", "z", "mass", "charge") or sign not in _COMPARE:
                raise ValueError(f"prop {column} {sign} is not understood")
            return ("prop", column.lower(), sign, float(value))
        if word == "around":
            distance = float(self._next("a distance"))
            if self._peek() == "of":
                self.at += 1
            return ("around", distance, self._factor())
        if word == "byres":
            return ("same", "residue", self._factor())
        if word == "same":
            what = self._next("an attribute").lower()
            if what not in ("residue", "chain") or self._next("as").lower() != "as":
                raise ValueError("same residue as, or same chain as")
            return ("same", what, self._factor())
        raise ValueError(f"{word!r} is not understood")

    @staticmethod
    def _range(text: str) -> tuple[int, int]:
        found = re.fullmatch(r"(-?\d+)(?:[:-](-?\d+))?", text)
        if not found:
            raise ValueError(f"{text!r} is not a number or a range")
        return int(found[1]), int(found[2] if found[2] is not None else found[1])

    def of(self, atoms: DataFrame) -> DataFrame:
        """The selected atoms, with their columns."""
        marked, test = self._compiled(self.tree, atoms)
        return marked.where(test).select(atoms.columns)

    def _compiled(self, node: tuple, atoms: DataFrame) -> tuple[DataFrame, Column]:
        """`atoms` with the marks that the test reads, and the test, which is never null."""
        kind = node[0]
        if kind in ("and", "or"):
            atoms, left = self._compiled(node[1], atoms)
            atoms, right = self._compiled(node[2], atoms)
            return atoms, left & right if kind == "and" else left | right
        if kind == "not":
            atoms, test = self._compiled(node[1], atoms)
            return atoms, ~test
        if kind in ("around", "same"):
            mark = f"_mark{sum(c.startswith('_mark') for c in atoms.columns)}"
            inner, test = self._compiled(node[2], atoms)
            chosen = inner.where(test)
            if kind == "around":
                hits = within(atoms.where("x is not null"), chosen.select("x", "y", "z"), node[1], ["x", "y", "z"], ["ordinal"], box=self.box).join(chosen.select("ordinal"), "ordinal", "left_anti")
                keys = ["ordinal"]
            else:
                keys = ["chain", "residue_number"] if node[1] == "residue" else ["chain"]
                hits = chosen.select(*keys).distinct()
            hits = hits.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.lit(True).alias(mark))
            match = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))
            out = atoms.join(hits, match, "left").drop(*(f"_k{n}" for n in range(len(keys))))
            return out, F.coalesce(F.col(mark), F.lit(False))
        if kind in _NAMES:
            return atoms, matches(_NAMES[kind], node[1])
        if kind in _RANGES:
            column, first = _RANGES[kind]
            return atoms, F.coalesce(_any([F.col(column).between(a - first, b - first) for a, b in node[1]]), F.lit(False))
        if kind == "prop":
            return atoms, F.coalesce(_COMPARE[node[2]](F.col(node[1]), F.lit(node[3])), F.lit(False))
        protein, hydrogen = matches("residue_name", AMINO), F.coalesce(F.upper(F.regexp_replace("atom_name", "^[0-9]+", "")).startswith("H"), F.lit(False))
        chain = matches("atom_name", ["N", "CA", "C", "O"])
        return atoms, {"all": F.lit(True), "none": F.lit(False), "protein": protein, "nucleic": matches("residue_name", NUCLEIC), "backbone": protein & chain, "sidechain": protein & ~chain, "hydrogen": hydrogen, "heavy": ~hydrogen}[kind]


def resolved(atoms: DataFrame, text: str, index: DataFrame | None = None, box: list | None = None) -> DataFrame:
    """Atoms of a group of an index, of a named group, of a selection, of a residue name or of a chain, whichever the text is first; an error if that is none.

    `index` has (name, atom), atoms from 0.
    """
    if index is not None:
        hit = index.where(F.lower("name") == text.strip().lower()).where("atom is not null").select(F.col("atom").alias("ordinal")).distinct()
        if not hit.isEmpty():
            beyond = hit.join(atoms.select("ordinal"), "ordinal", "left_anti").first()
            if beyond:
                raise ValueError(f"group {text!r} has atom {beyond['ordinal'] + 1}, which is not there")
            return atoms.join(hit, "ordinal", "left_semi")
    known = GROUPS.get(text.strip().lower())
    try:
        found = Selection(known or text, box).of(atoms)
    except ValueError:
        if known or len(text.split()) != 1:
            raise
        found = atoms.where(F.lit(False))
    if found.isEmpty() and len(text.split()) == 1:
        found = atoms.where(F.col("residue_name") == text.strip())
        if found.isEmpty():
            found = atoms.where(F.col("chain") == text.strip())
    if found.isEmpty():
        raise ValueError(f"selection {text!r} has no atoms")
    return found

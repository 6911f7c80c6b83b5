"""Atoms of structure files beyond fixed columns: mmCIF, MOL2, CHARMM and PDBQT, and one reader that goes by the ending.

All are read by splits of files: what a line means hangs on lines before it, and is carried along a file as one row a split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.sources.text import numbered_lines, read_gro, read_pdb, read_xyz, running, split_lines

#: A quoted value ends where a blank follows its quote; a comment begins only where a value could.
_VALUE = r"""'[^']*(?:'(?=\S)[^']*)*'(?=\s|$)|"[^"]*(?:"(?=\S)[^"]*)*"(?=\s|$)|#.*|\S+"""
_ATOMS = "_atom_site."
ATOM_COLUMNS = ["path", "model", "ordinal", "atom_name", "residue_name", "chain", "residue_number", "x", "y", "z"]


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Lines with the last value that is not null, of theirs and all lines before in the file."""
    rows = lines.withColumn("_v", value)
    ends = rows.groupBy("path", "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("place"))).alias("_e"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "block", F.last("_e", ignorenulls=True).over(before).alias("_before"))
    here = F.last("_v", ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("place"))
    return rows.join(ends, ["path", "block"]).withColumn(name, F.coalesce(here, "_before")).drop("_v", "_before")


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Atoms numbered from 0 within their models."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("path", "model").orderBy(*order)) - 1).cast("int")).select(*ATOM_COLUMNS)


def _states(lines: DataFrame) -> DataFrame:
    """Lines of mmCIF files with _in (what section a line stands in), _prose (within a text field), _data (number of its data block), _values and _start (values of atoms before it).

    A split cannot know in which state it begins, so it is summed up for each: an even or odd number of semicolons before, among atoms or not. One row a split is put in order, which tells the states.
    """
    word = F.regexp_extract(F.lower(F.trim(F.translate("value", "\t", " "))), r"^(\S+)", 1)
    kind = F.when(word.startswith(_ATOMS), "atoms").when(word.rlike("^(data_|save_|loop_$|stop_$|global_$|_)"), "other")
    w = Window.partitionBy("path", "block").orderBy("place")
    mark = F.when(F.col("value").startswith(";"), 1).otherwise(0)
    values = F.filter(F.regexp_extract_all("value", F.lit(_VALUE), F.lit(0)), lambda v: ~v.startswith("#"))
    rows = lines.select("*", mark.alias("_m"), F.sum(mark).over(w).alias("_marks"), kind.alias("_k"), word.startswith("data_").alias("_d"), F.substring(word, len(_ATOMS) + 1, 1000).alias("_head"), values.alias("_values"))

    def under(odd: Column) -> tuple[Column, Column]:
        prose = ((F.col("_marks") + odd) % 2 == 1) | (F.col("_m") == 1)
        return prose, F.when(~prose, F.col("_k"))

    both = [under(F.lit(p)) for p in (0, 1)]
    seen = rows.select("*", *(F.last(k, ignorenulls=True).over(w).alias(f"_last{p}") for p, (_, k) in enumerate(both)))
    inside = lambda p, a: (F.coalesce(F.col(f"_last{p}"), F.lit(a)) == "atoms") & both[p][1].isNull() & ~both[p][0]
    ends = seen.groupBy("path", "block").agg(
        F.sum("_m").alias("_m"),
        *(F.max_by(k, F.when(k.isNotNull(), F.col("place"))).alias(f"_e{p}") for p, (_, k) in enumerate(both)),
        *(F.count_if(~prose & F.col("_d")).alias(f"_d{p}") for p, (prose, _) in enumerate(both)),
        *(F.sum(F.when(inside(p, a), F.size("_values")).otherwise(0)).alias(f"_n{p}{a}") for p in (0, 1) for a in ("atoms", "other")),
    )
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pick = lambda one, two: F.when(F.col("_odd") == 0, F.col(one)).otherwise(F.col(two))
    ends = ends.withColumn("_odd", F.coalesce(F.sum("_m").over(order), F.lit(0)) % 2)
    ends = ends.withColumn("_before", F.coalesce(F.last(pick("_e0", "_e1"), ignorenulls=True).over(order), F.lit("other")))
    number = F.when(F.col("_before") == "atoms", pick("_n0atoms", "_n1atoms")).otherwise(pick("_n0other", "_n1other"))
    ends = ends.select("path", "block", "_odd", "_before", F.coalesce(F.sum(pick("_d0", "_d1")).over(order), F.lit(0)).alias("_d_before"), F.coalesce(F.sum(number).over(order), F.lit(0)).alias("_n_before"))
    prose, own = under(F.col("_odd"))
    out = rows.join(ends, ["path", "block"]).withColumn("_prose", prose).withColumn("_kind", own)
    out = out.withColumn("_in", F.coalesce(F.last("_kind", ignorenulls=True).over(w), "_before")).withColumn("_atoms", (F.col("_in") == "atoms") & F.col("_kind").isNull())
    size = F.when(F.col("_atoms") & ~F.col("_prose"), F.size("_values")).otherwise(0)
    data = F.sum(F.when(~F.col("_prose") & F.col("_d"), 1).otherwise(0)).over(w) + F.col("_d_before")
    return out.select("path", "block", "place", "_kind", "_prose", "_atoms", "_head", "_values", size.alias("_size"), data.alias("_data"), (F.sum(size).over(w) - size + F.col("_n_before")).alias("_start"))


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, model, ordinal, atom_name, residue_name, chain, residue_number, x, y, z) of the atom loops of mmCIF files, names and numbers the author's where there are any.

    Columns stand in any order, values may be quoted and rows may be broken or joined anywhere at blanks; `.` and `?` are null. Text between
    lines that begin with a semicolon is passed over, and is an error among the atoms, as are values that fill no whole row. Atoms outside a loop are not read.
    A file's data blocks are its entries, from 0, each with models and atoms of its own; without a model's number it is 1.
    """
    lines = _states(split_lines(spark, path))
    head = F.when(F.col("_kind") == "atoms", F.struct("block", "place", "_head"))
    first = lines.where("_kind = 'atoms' OR _atoms").groupBy("path", "_data").agg(
        F.transform(F.array_sort(F.collect_list(head)), lambda h: h["_head"]).alias("_heads"),
        F.min(F.when(F.col("_size") > 0, F.col("_start"))).alias("_first"),
        F.sum("_size").alias("_total"),
        F.max(F.col("_atoms") & F.col("_prose")).alias("_text"),
    )
    refused = lambda why: F.raise_error(F.lit(why)).cast("int")
    width = F.when(F.col("_text"), refused("a text field among atoms")).when(F.col("_total") % F.size("_heads") != 0, refused("values of atoms fill no whole row")).otherwise(F.size("_heads"))
    first = first.select("path", "_data", "_heads", "_first", width.alias("_width"))
    data = lines.where("_size > 0 OR _atoms AND _prose").select("path", "_data", "_start", "_values").join(first, ["path", "_data"]).withColumn("_at", F.col("_start") - F.col("_first"))
    row = F.floor(F.col("_at") / F.col("_width"))
    rows = data.withColumn("_row", F.explode(F.sequence(row, F.floor((F.col("_at") + F.size("_values") - 1) / F.col("_width")))))
    begin = F.greatest(F.col("_row") * F.col("_width") - F.col("_at"), F.lit(0)).cast("int")
    stop = F.least((F.col("_row") + 1) * F.col("_width") - F.col("_at"), F.size("_values")).cast("int")
    rows = rows.select("path", "_data", "_row", "_heads", "_start", F.slice("_values", begin + 1, stop - begin).alias("_piece"))
    rows = rows.groupBy("path", "_data", "_row").agg(F.any_value("_heads").alias("_heads"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_piece"))), lambda p: p["_piece"])).alias("_values"))

    def field(*names: str) -> Column:
        found = []
        for n in names:
            v = F.get("_values", (F.array_position("_heads", n) - 1).cast("int"))
            bare = F.when(F.array_contains("_heads", n) & ~v.isin(".", "?"), v)
            found.append(F.when(bare.rlike("(?s)^(['\"]).*\\1$") & (F.length(bare) > 1), bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare))
        return F.coalesce(*found)

    out = rows.select(
        "path",
        F.greatest(F.col("_data") - 1, F.lit(0)).cast("int").alias("entry"),
        "_row",
        F.coalesce(field("pdbx_pdb_model_num").cast("int"), F.lit(1)).alias("model"),
        field("auth_atom_id", "label_atom_id").alias("atom_name"),
        field("auth_comp_id", "label_comp_id").alias("residue_name"),
        field("auth_asym_id", "label_asym_id").alias("chain"),
        field("auth_seq_id", "label_seq_id").cast("int").alias("residue_number"),
        *(field(f"cartn_{c}").cast("double").alias(c) for c in "xyz"),
    )
    ordinal = (F.row_number().over(Window.partitionBy("path", "entry", "model").orderBy("_row")) - 1).cast("int")
    return out.withColumn("ordinal", ordinal).select("path", "entry", *ATOM_COLUMNS[1:])


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of MOL2 files, as of `read_cif`, with the force field's type and the charge; each molecule is a model. A row that ends in a backslash goes on in the next line.

    The residue's number is that of the substructure; digits at the end of a substructure's name that repeat it are left out of residue_name.
    """
    lines = split_lines(spark, path).withColumn("value", F.trim(F.translate("value", "\t\r", "  "))).where(~F.col("value").startswith("#"))
    lines = running(lines, F.when(F.col("value") == "@<TRIPOS>MOLECULE", 1).otherwise(0), "model")
    lines = carried(lines, F.when(F.col("value").startswith("@"), F.col("value")), "_in")
    rows = lines.where((F.col("_in") == "@<TRIPOS>ATOM") & (F.col("value") != "") & ~F.col("value").startswith("@"))
    open_ = F.col("value").endswith("\\")
    rows = running(rows, F.when(open_, 0).otherwise(1), "_row").withColumn("_row", F.col("_row") + F.when(open_, 1).otherwise(0))
    piece = F.when(open_, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    rows = rows.withColumn("_open", open_).withColumn("_piece", piece).withColumn("_alone", ~open_ & ~F.coalesce(F.lag("_row").over(Window.partitionBy("path", "block").orderBy("place")) == F.col("_row"), F.lit(True)))
    joined = rows.where(~F.col("_alone")).groupBy("path", "model", "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "_piece"))), lambda p: p["_piece"]), " ").alias("_piece"))
    rows = rows.where("_alone").select("path", "model", "_row", "_piece").unionByName(joined).withColumn("_f", F.split(F.trim("_piece"), r"\s+"))
    f = lambda k: F.get("_f", F.lit(k))
    number = f(6).cast("int")
    name = F.when(f(7).endswith(number.cast("string")) & (F.length(f(7)) > F.length(f(6))), f(7).substr(F.lit(1), F.length(f(7)) - F.length(f(6)))).otherwise(f(7))
    coordinates = [F.when(f(k).try_cast("double").isNotNull(), f(k).try_cast("double")).otherwise(F.raise_error(F.lit("an atom lacks coordinates")).cast("double")).alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))]
    out = rows.select("path", F.col("model").cast("int").alias("model"), "_row", f(1).alias("atom_name"), name.alias("residue_name"), F.lit(None).cast("string").alias("chain"), number.alias("residue_number"), *coordinates, f(5).alias("atom_type"), f(8).try_cast("double").alias("charge"))
    ordinal = (F.row_number().over(Window.partitionBy("path", "model").orderBy("_row")) - 1).cast("int")
    return out.withColumn("ordinal", ordinal).select(*ATOM_COLUMNS, "atom_type", "charge")


def read_crd(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of CHARMM coordinate files, usual and extended ones: lines of stars, the number of atoms, then one line an atom. The segment is the chain."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("*") & (F.trim("value") != ""))
    head = lines.groupBy("path").agg(F.min("line").alias("_head"))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.join(head, "path").where(F.col("line") > F.col("_head")).withColumn("_f", f).where(F.size("_f") >= 7)
    g = lambda k: F.get("_f", F.lit(k))
    number = F.coalesce(g(8).try_cast("int"), g(1).try_cast("int"))
    out = rows.select("path", F.lit(1).alias("model"), "line", g(3).alias("atom_name"), g(2).alias("residue_name"), g(7).alias("chain"), number.alias("residue_number"), *(g(k).cast("double").alias(c) for k, c in ((4, "x"), (5, "y"), (6, "z"))))
    return _in_order(out, "line")


#: Readers by the ending of a file's name; PDBQT has the columns of PDB, XYZ has no residues.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pdb": read_pdb, "ent": read_pdb, "pdbqt": read_pdb, "gro": read_gro, "cif": read_cif, "mmcif": read_cif, "mol2": read_mol2, "crd": read_crd, "xyz": read_xyz}


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of a structure file of any known format, in the columns of `read_cif`; what a format lacks is null, and its only model is 1. Of several entries of a file the first is the structure."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name[:-3] if name.endswith(".gz") else name
    kind = name.rsplit(".", 1)[-1]
    if kind not in READERS:
        raise ValueError(f"no reader for files that end in .{kind}; there are {', '.join(sorted(READERS))}")
    found = READERS[kind](spark, path)
    found = found.where("entry = 0") if "entry" in found.columns else found
    found = found.withColumn("model", F.col("frame") + 1) if "frame" in found.columns else found
    for column, missing in (("model", F.lit(1)), ("residue_name", F.lit(None).cast("string")), ("chain", F.lit(None).cast("string")), ("residue_number", F.lit(None).cast("int"))):
        found = found if column in found.columns else found.withColumn(column, missing)
    return found.select("path", F.col("model").cast("int").alias("model"), F.col("ordinal").cast("int").alias("ordinal"), *ATOM_COLUMNS[3:])

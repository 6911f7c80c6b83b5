"""Text formats of frames, atoms, groups and series as DataFrames.

Line formats go through Spark's text reader, so large files split and any file system serves; formats whose meaning depends on
a header or on whole files are read whole, one file a row, and parsed where they lie.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, place, value): lines as splits of files are read, `block` where the split begins and `place` the line's place in it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("path", "block").orderBy("_id")) - 1).drop("_id")


def running(lines: DataFrame, amount: Column, name: str) -> DataFrame:
    """Lines with a running sum along each file: within splits, started from the sums of the splits before, of which there is one row each."""
    w = Window.partitionBy("path", "block").orderBy("place")
    rows = lines.withColumn("_a", amount)
    sums = rows.groupBy("path", "block").agg(F.sum("_a").alias("_s"))
    before = sums.select("path", "block", (F.sum("_s").over(Window.partitionBy("path").orderBy("block")) - F.col("_s")).alias("_before"))
    return rows.join(before, ["path", "block"]).withColumn(name, F.sum("_a").over(w) + F.col("_before")).drop("_a", "_before")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) with lines numbered from 0, file by file, however many splits a file has."""
    return running(split_lines(spark, path), F.lit(1), "line").withColumn("line", (F.col("line") - 1).cast("long"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ordinal, atom): groups of an index file, atoms from 0. Of groups of one name the first counts; `;` begins a comment."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", ";.*$", "")))
    head = F.regexp_extract("value", r"^\[\s*(.*?)\s*\]", 1)
    is_head = F.col("value").rlike(r"^\[.*\]")
    w = Window.partitionBy("path").orderBy("line")
    rows = lines.withColumn("group", F.sum(F.when(is_head, 1).otherwise(0)).over(w)).withColumn("name", F.last(F.when(is_head, head), ignorenulls=True).over(w))
    first = rows.where(is_head).groupBy("path", "name").agg(F.min("group").alias("group"))
    atoms = rows.where(~is_head & (F.col("value") != "") & F.col("name").isNotNull()).select("path", "name", "group", "line", F.posexplode(F.split("value", r"\s+")).alias("k", "atom"))
    ordinal = F.row_number().over(Window.partitionBy("path", "name").orderBy("line", "k")) - 1
    found = atoms.join(first, ["path", "name", "group"]).select("path", "name", ordinal.alias("ordinal"), (F.col("atom").cast("int") - 1).alias("atom"))
    return first.select("path", "name").join(found, ["path", "name"], "left")


def read_columns(spark: SparkSession, path: str, columns: list[int], time_column: int | None = None) -> DataFrame:
    """(path, line, time, c0, c1, ...): numeric columns of a white-space or comma separated file, counted from 0.

    Lines that begin with #, @ or ; and lines whose first field is no number are left out; a number that a row lacks or that does not parse is an error.
    """
    lines = numbered_lines(spark, path).withColumn("f", F.split(F.trim(F.translate("value", ",", " ")), r"\s+"))
    rows = lines.where(~F.trim("value").rlike("^[#@;]") & F.col("f")[0].try_cast("double").isNotNull())

    def number(k: int) -> Column:
        v = F.get("f", F.lit(k)).try_cast("double")
        return F.when(v.isNotNull(), v).otherwise(F.raise_error(F.format_string("column %d of line %d is no number", F.lit(k), F.col("line"))))

    time = [number(time_column).alias("time")] if time_column is not None else []
    return rows.select("path", "line", *time, *(number(k).alias(f"c{i}") for i, k in enumerate(columns)))


def read_weights(spark: SparkSession, path: str, column: int | None = None) -> DataFrame:
    """(path, line, weight): the last column by default; weights must be finite and not negative."""
    lines = numbered_lines(spark, path).withColumn("f", F.split(F.trim(F.translate("value", ",", " ")), r"\s+"))
    rows = lines.where(~F.trim("value").rlike("^[#@;]") & F.col("f")[0].try_cast("double").isNotNull())
    v = (F.element_at("f", -1) if column is None else F.get("f", F.lit(column))).try_cast("double")
    fine = v.isNotNull() & (v >= 0) & (v < float("inf")) & ~F.isnan(v)
    return rows.select("path", "line", F.when(fine, v).otherwise(F.raise_error(F.lit("a weight is negative or not finite"))).alias("weight"))


def parse_plumed(text: str) -> tuple[list[str], dict[str, str], list[list[float]]]:
    """Field names, constants and rows of a PLUMED table. A repeated equal header is fine; another one, a short row or a word among numbers is an error."""
    fields: list[str] = []
    constants: dict[str, str] = {}
    rows: list[list[float]] = []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.split()
        if not parts:
            continue
        if parts[0] == "#!":
            if parts[1:2] == ["FIELDS"]:
                if fields and fields != parts[2:]:
                    raise ValueError(f"line {n}: the fields change")
                fields = parts[2:]
            elif parts[1:2] == ["SET"] and len(parts) >= 4:
                constants[parts[2]] = parts[3]
            continue
        if parts[0].startswith("#"):
            continue
        if not fields:
            raise ValueError(f"line {n}: numbers before any fields")
        if len(parts) < len(fields):
            raise ValueError(f"line {n}: {len(parts)} of {len(fields)} columns")
        rows.append([float(x) for x in parts[: len(fields)]])
    return fields, constants, rows


def read_plumed(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values, constants): values by field name, a row a line, by splits of files. The same things are errors as in `parse_plumed`."""
    lines = numbered_lines(spark, path).withColumn("f", F.split(F.trim(F.translate("value", "\t", " ")), " +"))
    mark = F.get("f", F.lit(0)) == "#!"
    heads = lines.where(mark & (F.get("f", F.lit(1)) == "FIELDS")).groupBy("path").agg(F.collect_set(F.slice("f", F.lit(3), F.size("f"))).alias("heads"), F.min("line").alias("first"))
    sets = lines.where(mark & (F.get("f", F.lit(1)) == "SET") & (F.size("f") >= 4)).groupBy("path", F.get("f", F.lit(2)).alias("name")).agg(F.max_by(F.get("f", F.lit(3)), "line").alias("v"))
    sets = sets.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("constants"))
    data = running(lines_of_data(spark, path), F.lit(1), "row")
    data = data.join(heads, "path", "left").join(sets, "path", "left")
    names = F.get("heads", F.lit(0))
    numbers = F.transform(F.slice("f", F.lit(1), F.size(names)), lambda x: x.try_cast("double"))
    refused = lambda why: F.raise_error(F.lit(why)).cast("map<string,double>")
    values = (
        F.when(F.col("heads").isNull(), refused("numbers before any fields"))
        .when(F.size("heads") > 1, refused("the fields change"))
        .when(F.size("f") < F.size(names), refused("a row is shorter than its fields"))
        .when(F.exists(numbers, lambda x: x.isNull()), refused("a word among numbers"))
        .otherwise(F.map_from_arrays(names, numbers))
    )
    return data.select("path", (F.col("row") - 1).cast("int").alias("row"), values.alias("values"), F.coalesce("constants", F.create_map().cast("map<string,string>")).alias("constants"))


def lines_of_data(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments, cut at blanks (f)."""
    lines = split_lines(spark, path).withColumn("value", F.trim(F.translate("value", "\t", " ")))
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("f", F.split("value", " +"))


def read_hills(spark: SparkSession, path: str, rescaled: bool = True) -> DataFrame:
    """(path, hill_time, names, centers, sigmas, height, factor, constants): hills as a table of any size; heights lose the well-tempered scaling if they were written with it."""
    t = read_plumed(spark, path)
    v = F.col("values")
    names = F.filter(F.map_keys(v), lambda n: F.map_contains_key(v, F.concat(F.lit("sigma_"), n)))
    factor = F.coalesce(F.try_element_at(v, F.lit("biasf")), F.lit(-1.0))
    height = F.when(F.lit(rescaled) & (factor > 1), v["height"] * (factor - 1) / factor).otherwise(v["height"])
    single = F.when(F.coalesce(F.try_element_at("constants", F.lit("multivariate")), F.lit("false")) == "true", F.raise_error(F.lit("multivariate hills are not supported")).cast("double")).otherwise(v["time"])
    out = t.select("path", single.alias("hill_time"), names.alias("names"), v.alias("_v"), height.alias("height"), F.when(factor > 1, factor).alias("factor"), "constants")
    pick = lambda prefix: F.transform("names", lambda n: F.element_at("_v", F.concat(F.lit(prefix), n)))
    return out.select("path", "hill_time", "names", pick("").alias("centers"), pick("sigma_").alias("sigmas"), "height", "factor", "constants")


def plumed_number(text: str) -> float:
    """A constant, which may be a multiple of pi."""
    import math

    m = re.fullmatch(r"([+-]?)(?:([0-9.eE+-]+)\*)?pi(?:/([0-9.]+))?", text.strip())
    return (-1 if m[1] == "-" else 1) * float(m[2] or 1) * math.pi / float(m[3] or 1) if m else float(text)


def hill_spans(names: list[str], constants: dict[str, str]) -> list[tuple[float, float] | None]:
    """Ends of the period of each variable, from constants such as min_phi and max_phi; none for variables that do not wrap."""
    return [(plumed_number(constants[f"min_{n}"]), plumed_number(constants[f"max_{n}"])) if f"min_{n}" in constants and f"max_{n}" in constants else None for n in names]


def hill_table(spark: SparkSession, path: str, rescaled: bool = True) -> tuple[DataFrame, list[str], list[tuple[float, float] | None], float | None]:
    """(hills, names, spans, bias factor): hills with hill_time, height, and c0, s0, c1, ... for the variables, of any number; names, periods and factor are the first row's."""
    found = read_hills(spark, path, rescaled)
    head = found.first()
    if head is None:
        raise ValueError("no hills")
    names = list(head["names"])
    columns = [F.get("centers", F.lit(k)).alias(f"c{k}") for k in range(len(names))] + [F.get("sigmas", F.lit(k)).alias(f"s{k}") for k in range(len(names))]
    return found.select("hill_time", "height", *columns), names, hill_spans(names, dict(head["constants"] or {})), head["factor"]


def parse_hills(text: str, rescaled: bool = True) -> dict:
    """Centres, widths, deposited heights, times and periods of hills; heights lose the well-tempered scaling if they were written with it."""
    import numpy as np

    fields, constants, rows = parse_plumed(text)
    if constants.get("multivariate") == "true":
        raise ValueError("multivariate hills are not supported")
    names = [f for f in fields if f"sigma_{f}" in fields]
    table = pd.DataFrame(rows, columns=fields)
    factor = float(table["biasf"].iloc[0]) if "biasf" in table and len(table) else -1.0
    height = table["height"].to_numpy()
    spans = hill_spans(names, constants)
    periods = [s[1] - s[0] if s else None for s in spans]
    return {"names": names, "times": table["time"].to_numpy(), "centers": table[names].to_numpy(), "sigmas": table[[f"sigma_{n}" for n in names]].to_numpy(), "heights": height * (factor - 1) / factor if rescaled and factor > 1 else np.array(height), "factor": factor if factor > 1 else None, "periods": periods, "spans": spans}


def parse_xpm(text: str) -> dict:
    """Width, height, axes and values (rows from the lowest y up) of an XPM matrix."""
    import numpy as np

    quoted = re.findall(r'"([^"]*)"', re.sub(r"/\*.*?\*/", "", text, flags=re.S))
    width, height, _, size = (int(x) for x in quoted[0].split()[:4])
    axes = {a: [float(x) for line in re.findall(rf"/\*\s*{a}-axis:\s*([^*]*)\*/", text) for x in line.split()] for a in "xy"}
    values = {}
    for line in text.splitlines():
        m = re.match(rf'\s*"(.{{{size}}})\s+c\s+\S+\s*".*?/\*\s*"([^"]*)"', line)
        if m:
            values[m[1]] = float(m[2])
    rows = []
    for line in quoted[-height:]:
        cells = [line[i : i + size] for i in range(0, width * size, size)]
        missing = [c for c in cells if c not in values]
        if missing:
            raise ValueError(f"unknown symbol {missing[0]!r}")
        rows.append([values[c] for c in cells])
    out = {}
    for a, count in (("x", width), ("y", height)):
        at = np.array(axes[a]) if axes[a] else np.arange(count, dtype=float)
        out[a] = (at[1:] + at[:-1]) / 2 if len(at) == count + 1 else at
    return {"width": width, "height": height, **out, "values": np.array(rows[::-1])}


def read_xpm(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z) of matrices, cells without a number left out."""

    def run(batches):
        for b in batches:
            for name, text in zip(b["path"], b["value"], strict=True):
                m = parse_xpm(text)
                yield pd.DataFrame([(name, x, y, v) for y, row in zip(m["y"], m["values"], strict=True) for x, v in zip(m["x"], row, strict=True) if v == v], columns=["path", "x", "y", "z"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(run, "path string, x double, y double, z double")


def _cut(start: int, stop: int) -> Column:
    return F.trim(F.substring("value", start, stop - start + 1))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(path, model, ordinal, atom_name, residue_name, chain, residue_number, x, y, z) of ATOM and HETATM records, by splits of files."""
    lines = running(split_lines(spark, path), F.when(F.col("value").startswith("MODEL "), 1).otherwise(0), "model")
    rows = lines.where(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM"))
    ordinal = F.row_number().over(Window.partitionBy("path", "model").orderBy("block", "place")) - 1
    return rows.select("path", F.greatest("model", F.lit(1)).cast("int").alias("model"), ordinal.alias("ordinal"), _cut(13, 16).alias("atom_name"), _cut(18, 20).alias("residue_name"), _cut(22, 22).alias("chain"), _cut(23, 26).cast("int").alias("residue_number"), _cut(31, 38).cast("double").alias("x"), _cut(39, 46).cast("double").alias("y"), _cut(47, 54).cast("double").alias("z"))


def reference_coordinates(spark: SparkSession, structure: str | None, frames: DataFrame | None = None, order: list[str] | None = None) -> list[float]:
    """Flat coordinates of a structure's first model if there is a structure, else of the first frame."""
    if structure:
        from terrane.sources.structures import read_structure

        atoms = read_structure(spark, structure)
        return frames_of(atoms.where("model = 1"), ["model"]).first()["coords"]
    return frames.orderBy(*(order or ["replicate", "frame"])).first()["coords"]


def selected(atoms: DataFrame, groups: list[str], index: DataFrame | None = None) -> DataFrame:
    """Atoms of any of several groups, each once, in order."""
    out = None
    for g in groups:
        one = residue_selection(atoms, g, index).select("ordinal")
        out = one if out is None else out.union(one)
    return atoms.join(out.distinct(), "ordinal", "left_semi").orderBy("ordinal")


def read_dcd(spark: SparkSession, path: str, time_unit: float = 0.04888821) -> DataFrame:
    """(path, frame, time_ps, coords) of DCD trajectories, by ranges of frames; times are the file's in picoseconds."""
    from terrane.sources.trajectories import read_trajectory

    found = read_trajectory(spark, path, time_unit=time_unit)
    return found.select("path", F.col("frame").cast("int").alias("frame"), "time_ps", "coords")


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of single-frame GRO files, in Angstrom."""
    lines = numbered_lines(spark, path)
    n = lines.where("line = 1").select("path", F.trim("value").cast("int").alias("n"))
    rows = lines.join(n, "path").where((F.col("line") >= 2) & (F.col("line") < F.col("n") + 2))
    return rows.select("path", (F.col("line") - 2).alias("ordinal"), _cut(1, 5).cast("int").alias("residue_number"), _cut(6, 10).alias("residue_name"), _cut(11, 15).alias("atom_name"), *((_cut(a, a + 7).cast("double") * 10).alias(c) for a, c in ((21, "x"), (29, "y"), (37, "z"))))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, ordinal, atom_name, x, y, z) of multi-frame XYZ files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        for b in batches:
            out = []
            for name, text in zip(b["path"], b["value"], strict=True):
                lines, at, frame = text.splitlines(), 0, 0
                while at < len(lines) and lines[at].strip():
                    n = int(lines[at])
                    for k in range(n):
                        a, x, y, z = lines[at + 2 + k].split()[:4]
                        out.append((name, frame, k, a, float(x), float(y), float(z)))
                    at, frame = at + 2 + n, frame + 1
            yield pd.DataFrame(out, columns=["path", "frame", "ordinal", "atom_name", "x", "y", "z"])

    return whole.mapInPandas(run, "path string, frame int, ordinal int, atom_name string, x double, y double, z double")


def frames_of(atoms: DataFrame, frame: list[str]) -> DataFrame:
    """Flat coordinate arrays from atoms, one row a frame."""
    packed = atoms.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("ordinal", "x", "y", "z"))).alias("a"))
    return packed.select(*frame, F.flatten(F.transform("a", lambda s: F.array(s["x"], s["y"], s["z"]))).alias("coords"))


FRAMES = T.StructType([T.StructField("system", T.StringType()), T.StructField("replicate", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("time_ps", T.DoubleType()), T.StructField("coords", T.ArrayType(T.FloatType()))])


def scan_frames(spark: SparkSession, path: str, stride: int = 1, begin: float | None = None, end: float | None = None) -> DataFrame:
    """A Parquet table of frames, strided from frame 0 and then cut to a time window; both reach the scan as filters."""
    df = spark.read.schema(FRAMES).parquet(path)
    df = df.where(F.col("frame") % stride == 0) if stride > 1 else df
    df = df.where(F.col("time_ps") >= begin) if begin is not None else df
    return df.where(F.col("time_ps") <= end) if end is not None else df


def residue_selection(atoms: DataFrame, text: str, index: DataFrame | None = None) -> DataFrame:
    """Atoms of a group or of a selection text; see `selection.resolved`."""
    from terrane.sources.selection import resolved

    return resolved(atoms, text, index)


def read_multiset(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, time, values): projections written one set after another, sets divided by `&`, cut to the shortest set."""

    def run(batches):
        for b in batches:
            out = []
            for name, body in zip(b["path"], b["value"], strict=True):
                sets: list[list[tuple[float, float]]] = [[]]
                for line in body.splitlines():
                    if line.strip() == "&":
                        sets.append([])
                    elif line.strip() and line.lstrip()[0] not in "#@;":
                        t, v = line.split()[:2]
                        sets[-1].append((float(t), float(v)))
                sets = [s for s in sets if s]
                for k in range(min(map(len, sets), default=0)):
                    out.append((name, k, sets[0][k][0], [s[k][1] for s in sets]))
            yield pd.DataFrame(out, columns=["path", "row", "time", "values"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(run, "path string, row int, time double, values array<double>")


def umbrella_windows(spark: SparkSession, paths: list[str], column: str, centers: list[float], kappas: float | list[float], skip: float = 0.0) -> DataFrame:
    """(window, center, kappa, time, x): one table a window, frames from `skip` on; one force constant serves all windows."""
    k = kappas if isinstance(kappas, list) else [kappas] * len(paths)
    if not len(paths) == len(centers) == len(k):
        raise ValueError("as many centres and force constants as windows are needed")
    out = None
    for i, (path, c, kappa) in enumerate(zip(paths, centers, k, strict=True)):
        v = F.col("values")
        rows = read_plumed(spark, path).where(v["time"] >= skip).select(F.lit(i).alias("window"), F.lit(float(c)).alias("center"), F.lit(float(kappa)).alias("kappa"), v["time"].alias("time"), v[column].alias("x"))
        out = rows if out is None else out.unionByName(rows)
    return out

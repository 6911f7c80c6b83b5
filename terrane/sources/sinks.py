"""Result tables as Parquet folders with a manifest, and text outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, about: dict | None = None) -> None:
    """Each table as Parquet under `folder`, and a manifest table with their names and what else is to be kept."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = json.dumps({"tables": sorted(tables), "about": about or {}}, default=str)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}, manifest["about"]


def is_run(spark: SparkSession, folder: str) -> bool:
    try:
        stored_settings(spark, folder)
    except ValueError:
        return False
    return True


def stored_settings(spark: SparkSession, folder: str) -> dict:
    """Settings that a stored run was made with; an error if the folder holds no run, none if the run kept no settings."""
    from pyspark.errors import AnalysisException

    try:
        about = json.loads(spark.read.text(f"{folder}/manifest").first()[0])["about"]
    except AnalysisException as e:
        raise ValueError(f"{folder} holds no stored run") from e
    return about.get("settings") or {}


def wide_grid(grid: DataFrame, value: str = "free_energy") -> DataFrame:
    """A row for each iy with a column for each ix, for spreadsheets."""
    return grid.groupBy("iy").pivot("ix").agg(F.first(value)).orderBy("iy")


def write_weights(df: DataFrame, path: str, time: str = "time_ps", weight: str = "weight") -> None:
    df.orderBy(time).select(F.format_string("%.6f %.10g", time, weight).alias("value")).write.mode("overwrite").text(path)


def write_cells(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated numbers with five places."""
    df.select(F.concat_ws("\t", *(F.format_string("%.5f", F.col(c).cast("double")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


def pdb_lines(atoms: DataFrame, bfactor: str | None = None) -> DataFrame:
    """(model, ordinal, value): ATOM records in fixed columns; a value per residue may go where temperature factors stand, held to what fits."""
    b = F.greatest(F.lit(-99.99), F.least(F.lit(999.99), F.coalesce(F.col(bfactor), F.lit(0.0)))) if bfactor else F.lit(0.0)
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.substring("atom_name", 1, 4))
    line = F.format_string("ATOM  %5d %s %-3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", (F.col("ordinal") + 1) % 100000, name, "residue_name", F.coalesce("chain", F.lit(" ")), "residue_number", "x", "y", "z", F.lit(1.0), b)
    return atoms.select(*(c for c in ("model",) if c in atoms.columns), "ordinal", line.alias("value"))


def with_bfactor(atoms: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Atoms with a residue's value, by chain and number, else by number alone."""
    exact = values.select("chain", "residue_number", F.col(value).alias("_exact"))
    loose = values.groupBy("residue_number").agg(F.first(value).alias("_loose"))
    out = atoms.join(F.broadcast(exact), ["chain", "residue_number"], "left").join(F.broadcast(loose), "residue_number", "left")
    return out.withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def nmd_text(title: str, names: list[str], residues: list[str], coords, vectors, eigenvalues) -> str:
    """Modes in the NMD format: a header, mean coordinates, and a line for each mode with the root of its eigenvalue."""
    lines = [f"nmwiz_load {title}.nmd", f"name {title}", "atomnames " + " ".join(names), "resnames " + " ".join(residues), "coordinates " + " ".join(f"{x:.3f}" for x in coords)]
    lines += [f"mode {k + 1} {max(e, 0) ** 0.5:.4f} " + " ".join(f"{x:.5f}" for x in v) for k, (e, v) in enumerate(zip(eigenvalues, vectors.T, strict=True))]
    return "\n".join(lines) + "\n"

"""Command line: analyze, compare, rebin, msm, residues, reweight, umbrella, example, init-config, doctor."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from terrane import api
from terrane.config import from_file, merged
from terrane.sources import sinks


def example(spark: SparkSession, folder: str, frames: int = 100, atoms: int = 25) -> None:
    """Two systems of two replicates that jump between two shapes, with other probabilities in each system."""
    import numpy as np

    rows = []
    for system, stay in (("A", 0.65), ("B", 0.30)):
        for rep in range(2):
            rng = np.random.default_rng([ord(system), rep])
            base, state = np.cumsum(np.ones((atoms, 3)), 0) * 2.0, 0
            bend = np.zeros((atoms, 3))
            bend[atoms // 2 :, 2] = np.arange(atoms - atoms // 2)
            for k in range(frames):
                state = state if rng.random() < 0.9 else int(rng.random() > stay)
                rows.append((system, f"Rep{rep}", k, 10.0 * k, (base + state * bend + rng.normal(0, 0.2, base.shape)).ravel().tolist()))
    spark.createDataFrame(rows, "system string, replicate string, frame int, time_ps double, coords array<double>").write.mode("overwrite").parquet(folder)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="terrane")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "compare", "rebin", "msm", "residues"):
        c = sub.add_parser(name)
        c.add_argument("input", help="frames in Parquet, or trajectories divided by `;`; for rebin, projections or a stored run")
        c.add_argument("output")
        c.add_argument("--config")
        c.add_argument("--reference")
        c.add_argument("--from", dest="run", metavar="RUN", help="a stored run, whose settings stand where none are given")
        c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting, as JSON or a word")
        if name == "residues":
            c.add_argument("atoms", help="a structure file")
            c.add_argument("--ligand", action="append", help="a residue name of the ligand")
    c = sub.add_parser("umbrella", help="free energies and weights of umbrella windows")
    c.add_argument("output")
    c.add_argument("--window", action="append", nargs=3, required=True, metavar=("COLVAR", "CENTER", "KAPPA"))
    c.add_argument("--cv", required=True)
    c.add_argument("--temperature", type=float, default=300.0)
    c.add_argument("--skip", type=float, default=0.0)
    c.add_argument("--period", type=float)
    c.add_argument("--bins", type=int, default=50)
    c.add_argument("--method", choices=("mbar", "wham"), default="mbar")
    sub.add_parser("doctor", help="print versions and try Python workers")
    c = sub.add_parser("reweight")
    c.add_argument("hills")
    c.add_argument("colvar")
    c.add_argument("output")
    c.add_argument("--temperature", type=float, default=300.0)
    c.add_argument("--mode", choices=("final", "rct"), default="final")
    c.add_argument("--skip", type=float, default=0.0)
    c = sub.add_parser("example")
    c.add_argument("output")
    sub.add_parser("init-config", help="print all settings with their defaults")
    a = p.parse_args(args)
    if a.command == "init-config":
        import yaml

        settings = vars(merged())
        print(yaml.safe_dump({k: list(v) if isinstance(v, tuple) else v for k, v in settings.items()}, sort_keys=False), end="")
        return
    spark = SparkSession.builder.appName("terrane").getOrCreate()
    if a.command == "example":
        example(spark, a.output)
    elif a.command == "doctor":
        doctor(spark)
    elif a.command == "reweight":
        reweight(spark, a)
    elif a.command == "umbrella":
        umbrella(spark, a)
    else:
        def value(text: str):
            try:
                return json.loads(text)
            except ValueError:
                return text

        given = {k: value(v) for k, _, v in (x.partition("=") for x in a.set)}
        file = from_file(a.config) if a.config else {}
        if a.command == "rebin" and sinks.is_run(spark, a.input):
            result = api.rebin_run(spark, a.input, file | given)
            sinks.save(result.tables, a.output, about(result))
            return
        s = merged(given, file, sinks.stored_settings(spark, a.run) if a.run else None)
        frames = api.load(spark, a.input, s)
        if a.command == "msm":
            result = api.build_msm(frames, s)
            sinks.save(result.tables, a.output, about(result))
            return
        if a.command == "residues":
            from terrane.sources.structures import read_structure

            sinks.save(api.analyze_residues(frames, read_structure(spark, a.atoms), s, "state" if "state" in frames.columns else None, a.ligand), a.output)
            return
        result = api.compare(frames, s, a.reference) if a.command == "compare" else api.rebin(frames, s) if a.command == "rebin" else api.analyze(frames, s)
        sinks.save(result.tables, a.output, about(result, "vectors"))


def about(result: api.Results, *without: str) -> dict:
    """What a run keeps beside its tables: small arrays and its settings."""
    return {k: v.tolist() for k, v in result.arrays.items() if k not in without} | {"settings": vars(result.settings)}


def doctor(spark: SparkSession) -> None:
    """Versions, and whether Python workers answer."""
    import sys

    import numpy
    import pandas
    import pyarrow

    api.on_workers(spark)
    for name, version in (("python", sys.version.split()[0]), ("spark", spark.version), ("numpy", numpy.__version__), ("pandas", pandas.__version__), ("pyarrow", pyarrow.__version__)):
        print(f"{name} {version}")
    n = spark.range(10).mapInPandas(lambda batches: batches, "id long").count()
    print(f"python workers {'answer' if n == 10 else 'do not answer'}")


def umbrella(spark: SparkSession, a: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from terrane.functions.columns import R
    from terrane.operators import landscape
    from terrane.operators import reweight as weights
    from terrane.operators import umbrella as wham
    from terrane.sources import text

    files, centers, kappas = zip(*a.window, strict=True)
    centers, kappas = [float(x) for x in centers], [float(x) for x in kappas]
    samples = text.umbrella_windows(spark, list(files), a.cv, centers, kappas, skip=a.skip)
    energies = weights.umbrella_energies(samples, "x", centers, kappas, R * a.temperature, a.period).persist()
    n = {r["window"]: r["count"] for r in samples.groupBy("window").count().collect()}  # one row a window
    totals = [n.get(k, 0) for k in range(len(centers))]
    if a.method == "wham":
        g = wham.inefficiencies(samples, "window", "time", "x", len(centers))
        profile, f = wham.wham(samples, "x", "window", centers, kappas, a.bins, a.temperature, a.period, inefficiency=g)
        windows = spark.createDataFrame([(k, centers[k], kappas[k], totals[k], g[k], f[k]) for k in range(len(centers))], "window int, center double, kappa double, samples long, inefficiency double, free_energy double")
        sinks.save({"windows": windows, "pmf": profile.withColumn("kt", F.lit(R * a.temperature))}, a.output)
        energies.unpersist()
        return
    f = weights.mbar(energies, totals)
    weighted = weights.unbiased_weights(energies, f, totals)
    windows = spark.createDataFrame([(k, centers[k], kappas[k], totals[k], float(x)) for k, x in enumerate(f)], "window int, center double, kappa double, samples long, free_energy double")
    sinks.save({"windows": windows, "weights": weighted.drop("u"), "pmf": landscape.pmf(weighted, "x", a.bins, "weight", a.temperature).withColumn("kt", F.lit(R * a.temperature))}, a.output)
    energies.unpersist()


def reweight(spark: SparkSession, a: argparse.Namespace) -> None:
    import numpy as np
    from pyspark.sql import functions as F

    from terrane.operators import hills
    from terrane.operators import reweight as weights
    from terrane.sources import text

    table, names, spans, factor = text.hill_table(spark, a.hills)
    centers, sigmas = [f"c{k}" for k in range(len(names))], [f"s{k}" for k in range(len(names))]
    ends = table.agg(*(F.min(c).alias(f"lo_{c}") for c in centers), *(F.max(c).alias(f"hi_{c}") for c in centers), *(F.max(x).alias(x) for x in sigmas)).first()
    box = np.array([[ends[f"lo_{c}"] for c in centers], [ends[f"hi_{c}"] for c in centers]])
    axes = weights.default_grid(box, np.array([[ends[x] for x in sigmas]]), periods=spans)
    colvar = text.read_plumed(spark, a.colvar)
    frames = colvar.select("row", F.col("values")["time"].alias("time_ps"), *(F.col("values")[n].alias(n) for n in names))
    out = hills.weights(frames, table, "row", names, "time_ps", a.temperature, a.mode, factor, a.skip, axes, [s[1] - s[0] if s else None for s in spans], centers, sigmas)
    sinks.write_weights(out, a.output)


if __name__ == "__main__":
    main()

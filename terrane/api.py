"""Building blocks and whole analyses: DataFrames in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane import on_workers
from terrane.config import Analysis, merged
from terrane.operators import compare as comparing
from terrane.operators import clusters, decompose, kinetics, landscape, msm, overlaps, resample, residues, segment, states, timeseries
from terrane.sources import sinks
from terrane.sources.trajectories import read_trajectory


@dataclass
class Results:
    """Tables by name, and small arrays that belong to the run. Tables that others read are cached until `release`."""

    settings: Analysis
    tables: dict[str, DataFrame] = field(default_factory=dict)
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def release(self) -> None:
        """Frees what the tables of this run have cached; they can still be read, at the cost of computing them anew."""
        for name in ("projections", "basins", "discarded"):
            if name in self.tables:
                self.tables[name].unpersist()


def load(spark: SparkSession, path: str, settings: Analysis) -> DataFrame:
    """Frames from Parquet or from trajectories (paths divided by `;`, a file a replicate), strided from the first frame and then cut to the time window."""
    on_workers(spark)
    if path.lower().endswith((".xtc", ".trr", ".dcd")):
        found = read_trajectory(spark, [p.strip() for p in path.split(";") if p.strip()], settings.stride, settings.begin, settings.end)
        return found.select(F.col("path").alias(settings.replicate), F.col("frame").alias(settings.order[0]), F.col("time_ps").alias(settings.time), F.col("coords").alias(settings.vector))
    df = spark.read.parquet(path)
    if settings.stride > 1:
        df = df.where(F.col(settings.order[0]) % settings.stride == 0)
    if settings.begin is not None:
        df = df.where(F.col(settings.time) >= settings.begin)
    return df.where(F.col(settings.time) <= settings.end) if settings.end is not None else df


def project(frames: DataFrame, s: Analysis) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Frames with PC1, PC2, ... from one pass of moments and one of projection; `columns` takes variables as they are."""
    if s.method == "columns":
        return frames, {}
    if s.method == "pca":
        p = decompose.pca(frames, s.vector, s.replicate, s.components, s.weighting)
    else:
        p = decompose.tica(frames, s.vector, s.replicate, list(s.order), s.lag, s.components)
    return decompose.projected(frames, s.vector, p["mean"], p["vectors"]).drop(s.vector), p


def bins_of(cvs: DataFrame, s: Analysis) -> int:
    return s.bins or landscape.automatic_bins(cvs, s.x, s.y).first()["bins"]


def landscape_of(cvs: DataFrame, s: Analysis, bounds: DataFrame | None = None, bins: int | None = None) -> tuple[DataFrame, int]:
    """(ix, iy, probability, free_energy, occupied) and the number of bins."""
    n = bins or bins_of(cvs, s)
    if s.smooth_sigma > 0:
        cells = landscape.histogram(cvs, s.x, s.y, n, bounds, s.weight)
        return landscape.smoothed(cells, n, s.smooth_sigma, s.temperature), n
    return landscape.grid(cvs, s.x, s.y, n, bounds, s.weight, s.temperature).withColumn("occupied", F.lit(True)), n


def assign_states(cvs: DataFrame, grid: DataFrame, bins: int, s: Analysis, bounds: DataFrame | None = None) -> dict[str, DataFrame]:
    """basins (with energies), frames (with basin and state), populations, ranked states and barriers."""
    cells = segment.basins(grid.withColumn("_one", F.lit(0)), "_one", bins, s.temperature, s.min_barrier).drop("_one")
    cells = grid.join(cells, ["ix", "iy"], "left").fillna(0, ["basin_id"]).persist()  # at most bins**2 rows
    placed = landscape.binned(cvs, s.x, s.y, bins, bounds if bounds is not None else landscape.value_range(cvs, s.x, s.y)).drop("xlo", "xhi", "ylo", "yhi")
    frames = states.assigned(placed, cells)
    pops = states.populations(frames, weight=s.weight)
    major = states.ranked(pops, least=s.min_state_population, most=s.max_states)
    frames = frames.join(F.broadcast(major.select("basin_id", "state")), "basin_id", "left").fillna("Unassigned", ["state"])
    names = major.select("basin_id", "state")
    edges = states.barriers(cells).join(F.broadcast(names.select(F.col("basin_id").alias("low"), F.col("state").alias("state_i"))), "low").join(F.broadcast(names.select(F.col("basin_id").alias("high"), F.col("state").alias("state_j"))), "high")
    return {"basins": cells, "frames": frames, "states": major.join(states.minima(cells), "basin_id"), "barriers": edges.select("state_i", "state_j", "saddle", "barrier_from_low", "barrier_from_high")}


def kinetics_of(frames: DataFrame, s: Analysis) -> dict[str, DataFrame]:
    """Transitions, visits and lifetimes of the major states; weighted ensembles have no kinetics."""
    if s.weight:
        raise ValueError("kinetics of weighted frames is not defined")
    labels = sorted(r[0] for r in frames.where("state != 'Unassigned'").select("state").distinct().collect())
    order = list(s.order)
    steps = kinetics.pairs(frames, s.replicate, order, "state", labels)
    counts = kinetics.transition_counts(steps, labels)
    dt = kinetics.frame_spacing(frames, s.time, s.replicate).first()["dt"] or 1.0
    v = kinetics.visits(frames, s.replicate, order, "state", s.time, labels, float(dt))
    names = sorted(labels)
    p = np.zeros((len(names), len(names)))
    for row in kinetics.transition_matrix(counts).collect():  # states are few
        p[names.index(row["source"]), names.index(row["target"])] = row["probability"] or 0
    m = kinetics.mean_first_passage(p, float(dt)) if names else p
    passage = frames.sparkSession.createDataFrame([(a, b, None if np.isnan(m[i, j]) else float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "source string, target string, mfpt double")
    return {"first_passage_times": passage, "transition_counts": counts, "transition_matrix": kinetics.transition_matrix(counts), "dwell_times": v, "dwell_summary": kinetics.visit_summary(v, steps), "transition_counts_by_replicate": kinetics.grouped_counts(steps, s.replicate)}


def convergence_of(frames: DataFrame, s: Analysis) -> dict[str, DataFrame]:
    order = list(s.order)
    stable = timeseries.leading_fraction(frames, s.replicate, order, [0.25, 0.5, 0.75, 1.0]).groupBy("fraction", "state").agg(F.count("*").alias("frames"))
    stable = stable.withColumn("population", F.col("frames") / F.sum("frames").over(Window.partitionBy("fraction")))
    return {"effective_samples": timeseries.effective_samples(frames, s.replicate, order, s.x), "population_stability": stable, "cosine_content": pooled_cosine(frames, s), "equilibration": timeseries.equilibrated(frames.select(s.replicate, *order, s.x, s.y), s.replicate, order, [s.x, s.y])}


def pooled_cosine(frames: DataFrame, s: Analysis, k: int = 1) -> DataFrame:
    """Cosine content of all replicates, one behind the other. Frames are numbered range by range, a replicate at a time at most."""
    names = frames.select(s.replicate).distinct()
    names = names.withColumn("_rank", F.row_number().over(Window.orderBy(s.replicate)))  # one row a replicate
    ranked = frames.join(names, s.replicate)
    return timeseries.cosine_content(ranked, ["_rank", *s.order], s.x, k, key=F.col("_rank"))


def modes_convergence(frames: DataFrame, cvs: DataFrame, s: Analysis) -> dict[str, DataFrame]:
    """Overlaps of halves, of leading parts and of replicates, and the verdict on sampling that they, cosine content and effective samples give."""
    spark, order = frames.sparkSession, list(s.order)
    found = overlaps.convergence(frames, s.vector, s.replicate, order, s.components, weighting=s.weighting)
    text = lambda r: None if r is None else str(r)
    number = lambda x: None if np.isnan(x) else float(x)
    tables = {
        "rmsip": spark.createDataFrame([("pooled" if k == 0 else text(r), number(x)) for k, (r, x) in enumerate(found["halves"])], "replicate string, rmsip double"),
        "progressive_overlap": spark.createDataFrame([(100 * f, number(x)) for f, x in found["progressive"]], "percent double, rmsip double"),
        "pairwise_rmsip": spark.createDataFrame([(text(a), text(b), number(x)) for a, b, x in found["pairs"]], "a string, b string, rmsip double"),
    }
    each = [timeseries.effective_samples(cvs, s.replicate, order, c).select(s.replicate, "n", "g") for c in (s.x, s.y)]
    worst = each[0].unionByName(each[1]).groupBy(s.replicate).agg((F.max("n") / F.max("g")).alias("e"))
    total = worst.agg(F.sum("e").alias("n_eff"))
    halves = float(found["halves"][0][1]) if found["halves"] else float("nan")
    verdict = timeseries.verdict(F.coalesce(F.lit(number(halves)), F.lit(0.0)), F.col("cosine_content"), F.col("n_eff"))
    tables["sampling"] = pooled_cosine(cvs, s).crossJoin(total).select(F.lit(number(halves)).cast("double").alias("rmsip"), "cosine_content", "n_eff", verdict.alias("verdict"))
    return tables


def rmsip_halves(frames: DataFrame, s: Analysis) -> float:
    """Overlap of the modes of the first and second halves of every replicate."""
    w = Window.partitionBy(s.replicate)
    half = (2 * F.row_number().over(w.orderBy(*s.order)) <= F.count("*").over(w)).alias("h")
    cut = frames.select(s.replicate, s.vector, half)
    a, b = (decompose.pca(cut.where("h" if first else "not h"), s.vector, s.replicate, s.components)["vectors"] for first in (True, False))
    return decompose.rmsip(a, b)


def uncertainty_of(frames: DataFrame, s: Analysis) -> dict[str, DataFrame]:
    """Intervals over replicates, and a block bootstrap whose blocks are in each replicate twice its statistical inefficiency long."""
    order = list(s.order)
    table = comparing.population_table(frames.withColumn("_all", F.lit("all")), "_all", s.replicate, "state").drop("_all")
    table = comparing.replicate_intervals(table.withColumn("sem", F.col("replicate_sd") / F.sqrt("n_replicates")), "replicate_mean", "sem", "n_replicates")
    g = timeseries.effective_samples(frames, s.replicate, order, s.x)
    lengths = g.select(s.replicate, timeseries.block_length(F.col("g"), F.col("n")).cast("int").alias("length"))
    samples = resample.bootstrap_populations(frames, s.replicate, order, "state", s.bootstrap, lengths, s.seed)
    return {"replicate_intervals": table, "bootstrap_samples": samples, "bootstrap_intervals": resample.summary(samples, ["state"], "population")}


def markov_of(frames: DataFrame, s: Analysis, columns: list[str]) -> dict:
    """Microstates by k-means, a scan of lags, reversible estimates at the lag and beyond, metastable sets, the Chapman-Kolmogorov test and passage times."""
    centers, _ = clusters.kmeans(frames, columns, s.clusters, s.seed)
    labelled = clusters.assigned(frames, columns, centers).drop("distance2")
    lags = sorted({*s.msm_lags, *(s.msm_lag * k for k in (1, 2, 3))})
    counts = msm.lagged_counts(labelled, s.replicate, list(s.order), "microstate", lags).toPandas()
    table = {lag: msm.matrix(counts[counts.lag == lag], list(range(len(centers)))) for lag in lags}
    scales, flat = msm.scan(counts, lags, len(centers))
    best = msm.estimate(table[s.msm_lag], s.msm_lag)
    m = min(s.metastable, len(best["active"]))
    chi = msm.pcca(best["T"], m)
    sets = np.full(len(centers), -1)
    sets[best["active"]] = chi.argmax(1)
    usable = {lag: c for lag, c in table.items() if c.sum() > 0}
    return {"frames": labelled, "centers": centers, "scan": scales, "plateau": flat, "estimate": best, "memberships": chi, "sets": sets, "coarse": msm.coarse(best["T"], chi), "ck": msm.chapman_kolmogorov(usable, s.msm_lag, sets, 3), "passage": msm.passage_times(best["T"], best["pi"], sets[best["active"]], s.msm_lag)}


def build_msm(frames: DataFrame, s: Analysis, columns: list[str] | None = None) -> Results:
    """A Markov model of the projection as tables: microstates, lag scan, transition matrix, stationary distribution, metastable sets, tests and passage times."""
    spark, m = frames.sparkSession, markov_of(frames, s, columns or [s.x, s.y])
    e, names = m["estimate"], [f"MS{k + 1}" for k in range(m["memberships"].shape[1])]
    own = lambda rows, schema: spark.createDataFrame(rows, schema)  # noqa: E731 small tables
    micro = own([(k, int(v), names[v] if v >= 0 else "inactive", c.tolist()) for k, (v, c) in enumerate(zip(m["sets"], m["centers"], strict=True))], "microstate int, set int, label string, center array<double>")
    tables = {
        "microstates": micro,
        "frames": m["frames"].join(F.broadcast(micro.select("microstate", "label")), "microstate", "left").fillna("inactive", ["label"]),
        "timescales": own(m["scan"].astype(object).values.tolist(), "lag int, mode int, timescale double, active int"),
        "transition_matrix": own([(int(e["active"][i]), int(e["active"][j]), float(p)) for (i, j), p in np.ndenumerate(e["T"])], "source int, target int, probability double"),
        "stationary": own([(int(k), float(p)) for k, p in zip(e["active"], e["pi"], strict=True)], "microstate int, probability double"),
        "memberships": own([(int(k), names[j], float(x)) for k, row in zip(e["active"], m["memberships"], strict=True) for j, x in enumerate(row)], "microstate int, label string, membership double"),
        "coarse_matrix": own([(names[i], names[j], float(p)) for (i, j), p in np.ndenumerate(m["coarse"])], "source string, target string, probability double"),
        "chapman_kolmogorov": spark.createDataFrame(m["ck"]),
        "passage_times": own([(int(a), int(b), float(x)) for (a, b), x in np.ndenumerate(m["passage"])], "source int, target int, mfpt double"),
    }
    if "state" in frames.columns:
        tables["basin_overlap"] = msm.crosstab(tables["frames"], "label", "state")
    return Results(s, tables, {"plateau_lag": np.array([m["plateau"] or 0]), "active_fraction": np.array([len(e["active"]) / len(m["centers"])])})


def descriptors_of(frames: DataFrame, s: Analysis, masses: list[float] | None = None) -> dict[str, DataFrame]:
    """Deviation from the first frame and radius of gyration of every frame, their summaries by replicate, and fluctuations of every atom."""
    keys = [s.replicate, *s.order]
    atoms = residues.long_form(frames, keys, s.vector)
    weigh = F.get(F.array(*map(F.lit, masses)), F.col("atom")) if masses else F.lit(1.0)
    atoms = atoms.withColumn("mass", weigh)
    first = frames.orderBy(*keys).select(s.vector).limit(1)
    reference = residues.long_form(first.withColumn("_one", F.lit(0)), ["_one"], s.vector).drop("_one")
    deviation = residues.deviations(atoms, reference, ["atom"], keys, ["x", "y", "z"])
    series = deviation.join(residues.gyration(atoms, keys, ["x", "y", "z"], "mass"), keys)
    summary = series.groupBy(s.replicate).agg(F.count("*").alias("frames"), *(f(c).alias(f"{c}_{n}") for c in ("rmsd", "rg") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("max", F.max))))
    return {"descriptor_series": series, "descriptor_summary": summary, "atom_fluctuations": residues.fluctuations(atoms, ["atom"], ["x", "y", "z"])}


def analyze_residues(frames: DataFrame, atoms: DataFrame, s: Analysis, state: str | None = "state", ligand: list[str] | None = None) -> dict[str, DataFrame]:
    """Fluctuations, correlations and contacts by residue, for all frames and by state. `atoms` has ordinal, chain, residue_number, residue_name and atom_name.

    Residues are numbered in order of appearance; a ligand is named by its residue names.
    """
    spark = frames.sparkSession
    found = residues.groups(atoms, ["chain", "residue_number"], "residue_name", "ordinal").withColumnRenamed("ordinal", "residue")
    member = atoms.join(F.broadcast(found.select("chain", "residue_number", "residue")), ["chain", "residue_number"])
    order = [(r["ordinal"], r["residue"]) for r in member.select("ordinal", "residue").orderBy("ordinal").collect()]  # one row an atom
    group = [g for _, g in order]
    keys = [*dict.fromkeys([s.replicate, *s.order, *([state] if state else []), *([s.weight] if s.weight else [])])]
    moves = residues.long_form(frames, keys, s.vector).join(F.broadcast(member.select(F.col("ordinal").alias("atom"), "residue")), "atom")
    flux = residues.fluctuations(moves, ["atom", "residue"], ["x", "y", "z"], s.weight)
    out = {"residues": found, "residue_fluctuations": residues.per_group(flux, ["residue"])}

    def long_(kind: dict) -> DataFrame:
        table = decompose.long_table(spark, {None if k is None else str(k): decompose.collapsed(m, group) for k, m in kind.items()}, "state", "string")
        return table.select("state", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.when(~F.isnan("value"), F.col("value")).alias("correlation"))

    out["residue_correlations"] = long_(decompose.cross_correlations(frames, s.vector, weight=s.weight))
    if state:
        out["residue_correlations_by_state"] = long_(decompose.cross_correlations(frames, s.vector, state))
        each = residues.fluctuations(moves, [state, "atom", "residue"], ["x", "y", "z"], s.weight)
        out["residue_fluctuations_by_state"] = residues.per_group(each, [state, "residue"])
        out["residue_state_differences"] = residues.all_state_differences(moves, state, "residue", "atom", ["x", "y", "z"], s.weight).join(F.broadcast(found.select("residue", "chain", "residue_number", "residue_name")), "residue")
    if ligand:
        role = F.broadcast(member.select(F.col("ordinal").alias("atom"), "residue_name", "atom_name"))
        heavy = moves.join(role, "atom").where(residues.heavy(F.col("atom_name"))).withColumn("_frame", F.struct(*keys))
        near = residues.contacts(residues.masked(heavy, "residue_name", ligand, False), residues.masked(heavy, "residue_name", ligand), "_frame", "residue", ["x", "y", "z"], s.contact_cutoff)
        near = near.select("_frame.*", "residue", "min_distance", "in_contact")
        out |= {"contacts": near, "contact_persistence": residues.persistence(near, "residue", s.weight)}
        if state:
            out["contact_persistence_by_state"] = residues.persistence_by_state(near, "residue", state, s.weight)
        site = out["contact_persistence"].where("persistence >= 0.5").select("residue")
        out["binding_site"] = residues.site_fluctuations(out["residue_fluctuations"], site, "residue")
    return out


def modes_of(spark: SparkSession, arrays: dict[str, np.ndarray]) -> dict[str, DataFrame]:
    """Modes and the mean as tables, from which structures and comparisons can be made again."""
    share = arrays.get("explained", np.full(len(arrays["eigenvalues"]), np.nan))
    rows = [(k + 1, float(e), float(share[k]), float(share[: k + 1].sum()), arrays["vectors"][:, k].tolist()) for k, e in enumerate(arrays["eigenvalues"])]
    return {"modes": spark.createDataFrame(rows, "mode int, eigenvalue double, explained double, cumulative double, vector array<double>"), "mean": spark.createDataFrame([(arrays["mean"].tolist(),)], "mean array<double>")}


def analyze(frames: DataFrame, settings: Analysis) -> Results:
    """Projection, landscape, states and, without weights, kinetics; convergence and uncertainty.

    With equilibration `auto`, each replicate's frames before its latest equilibration go, and modes are fitted anew.
    """
    out = Results(settings)
    cvs, arrays = project(frames, settings)
    if settings.equilibration == "auto":
        order = list(settings.order)
        series = cvs.select(settings.replicate, *order, settings.x, settings.y)
        starts = timeseries.equilibrated(series, settings.replicate, order, [settings.x, settings.y]).where("observable = 'latest'").persist()  # one row a replicate
        out.tables["discarded"] = starts
        cvs, arrays = project(timeseries.production(frames, starts, settings.replicate, order), settings)
    out.arrays |= arrays
    if arrays:
        out.tables |= modes_of(frames.sparkSession, arrays)
    cvs = cvs.persist()
    if arrays:
        kept = timeseries.production(frames, starts, settings.replicate, list(settings.order)) if settings.equilibration == "auto" else frames
        out.tables |= modes_convergence(kept, cvs, settings)
    grid, n = landscape_of(cvs, settings)
    out.tables |= {"projections": cvs, "free_energy": grid} | assign_states(cvs, grid, n, settings)
    labelled = out.tables["frames"]
    if not settings.weight:
        out.tables |= kinetics_of(labelled, settings)
    out.tables |= convergence_of(labelled, settings) | (uncertainty_of(labelled, settings) if settings.bootstrap else {})
    return out


def rebin(projections: DataFrame, settings: Analysis) -> Results:
    """The same analysis from stored projections, without reading frames again."""
    return analyze(projections, replace(settings, method="columns"))


def rebin_run(spark: SparkSession, folder: str, given: dict | None = None) -> Results:
    """A new landscape and its states from a stored run: settings that are not given are the run's, its projections stay as they are.

    Transients were discarded when the run was made; bootstraps are made anew only if their number is given.
    """
    given = dict(given or {})
    settings = merged({"equilibration": "report", "bootstrap": 0, "method": "columns"} | given, sinks.stored_settings(spark, folder))
    if settings.equilibration == "auto":
        raise ValueError("transients are discarded by the analysis, not when its grid is made anew")
    on_workers(spark)
    return rebin(spark.read.parquet(f"{folder}/projections"), settings)


def compare(frames: DataFrame, settings: Analysis, reference: str | None = None) -> Results:
    """Systems on one shared projection and grid: populations, energies, difference maps and overlaps."""
    out = Results(settings)
    cvs, arrays = project(frames, settings)
    out.arrays |= arrays
    cvs = cvs.persist()
    bounds = landscape.value_range(cvs, settings.x, settings.y, 0.05)
    grid, n = landscape_of(cvs, settings, bounds)
    tables = assign_states(cvs, grid, n, settings, bounds)
    reference = reference or cvs.agg(F.min(settings.system)).first()[0]
    each = landscape.grid(cvs, settings.x, settings.y, n, bounds, settings.weight, settings.temperature, by=[settings.system])
    pops = comparing.population_table(tables["frames"], settings.system, settings.replicate, "state")
    out.tables |= tables | {"projections": cvs, "system_grids": each, "populations": pops, "differences": comparing.against(pops, settings.system, "state", reference), "ddg": comparing.difference_map(each, settings.system, reference), "overlaps": comparing.overlaps(each, settings.system, settings.temperature)} | (modes_of(frames.sparkSession, arrays) if arrays else {})
    if settings.bootstrap:
        keyed = cvs.withColumn("_rep", F.concat_ws("/", settings.system, settings.replicate))
        g = timeseries.effective_samples(keyed, "_rep", list(settings.order), settings.x)
        owner = keyed.select("_rep", settings.system, settings.replicate).distinct()
        own = g.select("_rep", timeseries.block_length(F.col("g"), F.col("n")).alias("l")).join(owner, "_rep")
        system = Window.partitionBy(settings.system)  # a system's replicates share its longest block
        length = own.select(settings.system, settings.replicate, F.max("l").over(system).cast("int").alias("length"))
        samples = resample.bootstrap_systems(tables["frames"], settings.system, settings.replicate, list(settings.order), "state", settings.bootstrap, length, settings.seed)
        out.tables["difference_intervals"] = comparing.differences_by_bootstrap(samples, settings.system, "state", reference)
    return out

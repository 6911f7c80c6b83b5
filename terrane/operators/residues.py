"""Groups of atoms over frames: fluctuations, correlations, contacts and how they differ between states.

Coordinates come long (frame, atom, x, y, z, ...) for relational work; a table of flat arrays explodes into that shape with `long_form`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import near


def long_form(frames: DataFrame, keys: list[str], coords: str) -> DataFrame:
    """(keys..., atom, x, y, z) from flat 3N arrays."""
    n = (F.size(coords) / 3).cast("int")
    rows = frames.select(*keys, F.col(coords).alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("atom"))
    return rows.select(*keys, "atom", *(F.element_at("_c", F.col("atom") * 3 + k).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))))


def groups(atoms: DataFrame, keys: list[str], name: str, ordinal: str) -> DataFrame:
    """Groups in order of first appearance, with their first name and size."""
    out = atoms.groupBy(*keys).agg(F.min(ordinal).alias("first_atom"), F.min_by(name, ordinal).alias(name), F.count("*").alias("n_atoms"))
    return out.withColumn("ordinal", F.row_number().over(Window.orderBy("first_atom")) - 1)


def heavy(name: Column) -> Column:
    return ~F.upper(F.trim(name)).like("H%")


def fluctuations(df: DataFrame, by: list[str], values: list[str], weight: str | None = None) -> DataFrame:
    """Root mean square fluctuation about the (weighted) mean: sqrt of the summed population variances."""
    if weight is None:
        return df.groupBy(*by).agg(F.sqrt(sum((F.var_pop(F.col(v).cast("double")) for v in values), F.lit(0.0))).alias("rmsf"))
    w = F.col(weight).cast("double")
    total = F.sum(w)

    def variance(v: str) -> Column:
        x = F.col(v).cast("double")
        return F.sum(w * x * x) / total - F.pow(F.sum(w * x) / total, 2)

    return df.groupBy(*by).agg(F.sqrt(sum((variance(v) for v in values), F.lit(0.0))).alias("rmsf"))


def per_group(atoms: DataFrame, by: list[str], value: str = "rmsf") -> DataFrame:
    """Root mean square over the atoms of each group."""
    return atoms.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(value))


def correlations(long: DataFrame, sample: str, item: str, value: str) -> DataFrame:
    """(i, j, c): normalised covariance of every two items over samples, from one self-join on the sample. Items without motion give null."""
    a, b = long.select(sample, F.col(item).alias("i"), F.col(value).alias("x")), long.select(sample, F.col(item).alias("j"), F.col(value).alias("y"))
    out = a.join(b, sample).groupBy("i", "j").agg(F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return out.select("i", "j", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))).alias("c"))


def contacts(a: DataFrame, b: DataFrame, frame: str, group: str, axes: list[str], cutoff: float, box: list | None = None) -> DataFrame:
    """(frame, group, min_distance, in_contact): the nearest of `b`'s points to each group of `a`'s in every frame; see `near.contacts`."""
    return near.contacts(a, b, frame, group, axes, cutoff, box)


def persistence(c: DataFrame, group: str, weight: str | None = None, least: float = 0.0) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = F.when(F.col("in_contact"), w).otherwise(0.0)
    return c.groupBy(group).agg((F.sum(hit) / F.sum(w)).alias("persistence"), F.avg("min_distance").alias("mean_min_distance"), F.count("*").alias("n_frames")).where(F.col("persistence") >= least)


def centroid(df: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    w = F.col(weight).cast("double")
    total = F.sum(w)
    refused = F.raise_error(F.lit("weights do not add up to more than 0")).cast("double")
    return df.groupBy(*by).agg(*(F.when(total > 0, F.sum(w * F.col(v)) / total).otherwise(refused).alias(v) for v in values))


def gyration(df: DataFrame, by: list[str], values: list[str], mass: str) -> DataFrame:
    """Mass-weighted radius of gyration of each frame."""
    m = F.col(mass).cast("double")
    spread = sum((F.sum(m * F.col(v) * F.col(v)) / F.sum(m) - F.pow(F.sum(m * F.col(v)) / F.sum(m), 2) for v in values), F.lit(0.0))
    return df.groupBy(*by).agg(F.sqrt(F.greatest(spread, F.lit(0.0))).alias("rg"))


def deviations(df: DataFrame, reference: DataFrame, item: list[str], by: list[str], values: list[str]) -> DataFrame:
    """Root mean square deviation of each frame from a reference table of the same items."""
    ref = reference.select(*item, *(F.col(v).alias(f"_{v}") for v in values))
    square = sum(((F.col(v) - F.col(f"_{v}")) * (F.col(v) - F.col(f"_{v}")) for v in values), F.lit(0.0))
    return df.join(F.broadcast(ref), item).groupBy(*by).agg(F.sqrt(F.avg(square)).alias("rmsd"))


def state_differences(df: DataFrame, state: str, item: list[str], values: list[str], a: str, b: str) -> DataFrame:
    """By item: fluctuation in two states, their difference, and how far the mean moved."""
    def part(s: str, tag: str) -> DataFrame:
        rows = df.where(F.col(state) == s)
        return rows.groupBy(*item).agg(F.count("*").alias(f"n_{tag}"), F.sqrt(sum((F.var_pop(v) for v in values), F.lit(0.0))).alias(f"rmsf_{tag}"), *(F.avg(v).alias(f"{tag}_{v}") for v in values))

    both = part(a, "a").join(part(b, "b"), item)
    moved = F.sqrt(sum((F.pow(F.col(f"b_{v}") - F.col(f"a_{v}"), 2) for v in values), F.lit(0.0)))
    return both.select(*item, "n_a", "n_b", "rmsf_a", "rmsf_b", (F.col("rmsf_b") - F.col("rmsf_a")).alias("delta_rmsf"), moved.alias("displacement"))


def all_state_differences(moves: DataFrame, state: str, residue: str, atom: str, axes: list[str], weight: str | None = None, reference: str | None = None) -> DataFrame:
    """(residue, state_a, state_b, n_atoms, rmsf_a, rmsf_b, delta_rmsf, mean_rmsd, centroid_displacement, n_frames_a, n_frames_b): every state against the
    reference, the state of most frames (the least name on ties). Weights count within each state.

    One aggregation gives each atom's mean and fluctuation in each state; what is compared is as many rows as atoms and states.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = {c: F.sum(w * F.col(c)) / F.sum(w) for c in axes}
    spread = sum((F.sum(w * F.col(c) * F.col(c)) / F.sum(w) - mean[c] * mean[c] for c in axes), F.lit(0.0))
    per = moves.groupBy(state, residue, atom).agg(F.count("*").alias("_n"), F.greatest(spread, F.lit(0.0)).alias("_msf"), *(m.alias(f"_{c}") for c, m in mean.items()))
    if reference is None:
        sizes = per.groupBy(state).agg(F.max("_n").alias("_n")).orderBy(F.desc("_n"), state).first()
        if sizes is None:
            return per.select(residue, *(F.lit(None).cast("double").alias(c) for c in ("delta_rmsf", "mean_rmsd", "centroid_displacement"))).limit(0)
        reference = sizes[state]
    a = per.where(F.col(state) == reference).select(residue, atom, F.col("_n").alias("_na"), F.col("_msf").alias("_fa"), *(F.col(f"_{c}").alias(f"_a{c}") for c in axes))
    both = per.where(F.col(state) != reference).join(a, [residue, atom])
    moved = [F.col(f"_{c}") - F.col(f"_a{c}") for c in axes]
    out = both.groupBy(residue, F.col(state).alias("state_b")).agg(
        F.count("*").alias("n_atoms"),
        F.sqrt(F.avg("_fa")).alias("rmsf_a"),
        F.sqrt(F.avg("_msf")).alias("rmsf_b"),
        F.sqrt(F.avg(sum((m * m for m in moved), F.lit(0.0)))).alias("mean_rmsd"),
        F.sqrt(sum((F.pow(F.avg(m), 2) for m in moved), F.lit(0.0))).alias("centroid_displacement"),
        F.max("_na").alias("n_frames_a"),
        F.max("_n").alias("n_frames_b"),
    )
    columns = [residue, F.lit(reference).alias("state_a"), "state_b", "n_atoms", "rmsf_a", "rmsf_b", (F.col("rmsf_b") - F.col("rmsf_a")).alias("delta_rmsf"), "mean_rmsd", "centroid_displacement", "n_frames_a", "n_frames_b"]
    return out.select(*columns)


def broken_chains(atoms: DataFrame, frame: str, segment: str, order: str, axes: list[str], limit: float = 4.5) -> DataFrame:
    """Consecutive atoms of a segment farther apart than `limit`."""
    w = Window.partitionBy(frame, segment).orderBy(order)
    d = F.sqrt(sum((F.pow(F.lead(c).over(w) - F.col(c), 2) for c in axes), F.lit(0.0)))
    return atoms.withColumn("gap", d).where(F.col("gap") > limit)


def dihedral(p: list[list[Column]]) -> Column:
    """Signed angle in degrees of four points given as [x, y, z] columns."""
    def sub(a, b):
        return [x - y for x, y in zip(a, b, strict=True)]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def inner(a, b):
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(inner(b1, n2) * F.sqrt(inner(b2, b2)), inner(n1, n2)))


def with_lookup(states: DataFrame, intervals: DataFrame, state: str, columns: list[str]) -> DataFrame:
    """States with the columns of their intervals, null where there are none."""
    return states.join(F.broadcast(intervals.select(state, *columns)), state, "left")


def masked(atoms: DataFrame, residue: str, names: list[str], keep: bool = True) -> DataFrame:
    """Atoms of the named residues, or of all others."""
    hit = F.coalesce(F.col(residue).isin(names), F.lit(False))
    return atoms.where(hit if keep else ~hit)


def persistence_by_state(c: DataFrame, group: str, state: str, weight: str | None = None, least: float = 0.0) -> DataFrame:
    """(group, state, persistence, overall, most): shares of frames in contact by state, the share in all frames and the largest of all; groups whose largest is below `least` go."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = F.when(F.col("in_contact"), w).otherwise(0.0)
    each = c.groupBy(group, state).agg(F.sum(hit).alias("_h"), F.sum(w).alias("_w"))
    every = Window.partitionBy(group)
    share = F.try_divide("_h", "_w")
    overall = F.try_divide(F.sum("_h").over(every), F.sum("_w").over(every))
    out = each.select(group, state, share.alias("persistence"), overall.alias("overall"), F.greatest(F.max(share).over(every), overall).alias("most"))
    return out.where(F.col("most") >= least)


def site_fluctuations(fluctuation: DataFrame, site: DataFrame, group: str, value: str = "rmsf") -> DataFrame:
    """Fluctuations of the residues of a site, with null for those that were not measured."""
    return site.select(group).distinct().join(fluctuation.select(group, value), group, "left")

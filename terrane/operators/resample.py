"""Block bootstrap with a counter-based random number generator: the same resamples on any cluster, in any order, after any retry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import R, bin_index, counter_uniform
from terrane.operators import ranges


def ordinals(df: DataFrame, replicate: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(replicate)
    return df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)


#: Draws that a task of `block_indices` makes, at about; blocks that it draws in a row; frames whose draws are counted together.
TASK_DRAWS, CHUNK, STRETCH = 2_000_000, 20_000, 100_000


def block_indices(sizes: DataFrame, replicate: str, n_boot: int, length: int, seed: int = 0) -> DataFrame:
    """(b, replicate, _i, times): circular blocks of `length` frames, ceil(n/length) starts a resample, cut to n frames.

    `times` counts how often a frame was drawn, so equal draws travel once. Tasks grow in number with the draws: chunks of blocks are dealt to
    tasks that draw them, blocks to tasks of the stretches of frames that they cover.
    """
    n, start, stretch = F.col("n"), F.col("start"), F.col("_stretch")
    draws = (sizes.agg(F.sum("n")).first()[0] or 0) * n_boot
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-draws // TASK_DRAWS))
    blocks = F.ceil(n / length).cast("long")
    dealt = sizes.select(replicate, "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    dealt = dealt.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((blocks - 1) / CHUNK)))).repartition(tasks, "b", replicate, "_chunk")
    starts = dealt.withColumn("k", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(blocks, (F.col("_chunk") + 1) * CHUNK) - 1)))
    starts = starts.withColumn("start", counter_uniform(n, F.lit(seed), F.col("b"), F.col(replicate), F.col("k")))
    stop = start + F.least(F.lit(length), n - F.col("k") * length)
    spans = F.array(F.struct(start.alias("a"), F.least(stop, n).alias("z")), F.struct(F.lit(0).cast("long").alias("a"), (stop - n).alias("z")))
    spans = starts.select("b", replicate, F.explode(F.filter(spans, lambda s: s["z"] > s["a"])).alias("s")).select("b", replicate, "s.a", "s.z")
    spans = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("a") / STRETCH), F.floor((F.col("z") - 1) / STRETCH)))).repartition(tasks, "b", replicate, "_stretch")
    own = F.sequence(F.greatest("a", stretch * STRETCH), F.least(F.col("z"), (stretch + 1) * STRETCH) - 1)
    rows = spans.select("b", replicate, "_stretch", F.explode(own).alias("_i"))
    return rows.groupBy("b", replicate, "_stretch", "_i").agg(F.count("*").alias("times")).drop("_stretch")


def resampled(df: DataFrame, replicate: str, order: list[str], n_boot: int, length: int, seed: int = 0) -> DataFrame:
    """`df` in resamples: columns b and times beside its own."""
    rows = ordinals(df, replicate, order)
    sizes = rows.groupBy(replicate).agg(F.count("*").alias("n"))
    return rows.join(block_indices(sizes, replicate, n_boot, length, seed), [replicate, "_i"]).drop("_i")


#: Draws of one replicate that a task makes by itself; the blocks of a replicate with more are dealt as rows.
DRAWS = 5_000_000


def block_counts(df: DataFrame, replicate: str, order: list[str], label: str, n_boot: int, length: int | DataFrame, seed: int = 0, within: list[str] | None = None) -> DataFrame:
    """(within, b, label, t): how often each label is drawn, by replicate, or by the columns `within` (all rows of a replicate in one) in parts that are still to be added up. `length` is one for all, or a table (replicate, length).

    A circular block is the difference of two running counts along the doubled series. Replicates go one after another, sorted, through tasks that draw,
    add up over all their replicates, and send counts only; the few that are too long for that are numbered and summed range by range instead.
    """
    within_ = [replicate] if within is None else within
    if len(within_) > 1:
        raise ValueError("one column at most")
    rows = df.select(*dict.fromkeys([replicate, *order, label, *within_]))
    rows = rows.withColumn("_length", F.lit(length)) if isinstance(length, int) else rows.join(length.select(replicate, F.col("length").alias("_length")), replicate)
    long = rows.groupBy(replicate).agg((F.count("*") / F.first("_length") * n_boot).alias("_d")).where(F.col("_d") > DRAWS).select(replicate)
    usual = rows
    if not long.isEmpty():
        usual = rows.join(long.withColumnRenamed(replicate, "_long"), F.col(replicate).eqNullSafe(F.col("_long")), "left_anti")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    key = F.concat(F.when(F.col(replicate).isNull(), "n").otherwise("r"), F.coalesce(F.col(replicate).cast("string"), F.lit("")))
    sent = ranges.dealt(usual, replicate).sortWithinPartitions(replicate, *order).select(key.alias("_r"), F.col("_length").cast("long").alias("_length"), F.col(label).alias("_label"), *(F.col(w).alias("_within") for w in within_))
    schema = T.StructType([*(T.StructField(w, kinds[w]) for w in within_), T.StructField("b", T.IntegerType()), T.StructField(label, kinds[label]), T.StructField("t", T.LongType())])

    def drawn(name: str, n: int, size: int) -> np.ndarray:
        """Where each block of each resample starts: what `counter_uniform` gives."""
        blocks = -(-n // size)
        own = "" if name == "n" else f"{name[1:]}:"
        digest, out = hashlib.md5, np.empty(n_boot * blocks, np.int64)
        at = 0
        for b in range(n_boot):
            head = f"{seed}:{b}:{own}"
            out[at : at + blocks] = [int(digest(f"{head}{k}".encode(), usedforsecurity=False).hexdigest()[:8], 16) for k in range(blocks)]
            at += blocks
        return (out % n).reshape(n_boot, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, totals = to_arrow_schema(schema), {}

        def add(name: str, size: int, group: object, labels: list[pa.Array]) -> None:
            found = pa.chunked_array(labels).combine_chunks().dictionary_encode()
            codes, n = np.asarray(found.indices.fill_null(-1)), len(found)
            starts = drawn(name, n, size)
            span = np.minimum(size, n - np.arange(starts.shape[1]) * size)
            for k, x in enumerate(found.dictionary.to_pylist()):
                count = np.concatenate([[0], np.cumsum(np.tile(codes == k, 2))])
                t = (count[starts + span] - count[starts]).sum(1)
                totals[group, x] = totals.get((group, x), 0) + t

        def flush() -> Iterator[pa.RecordBatch]:
            for (group, x), t in totals.items():
                hit = np.flatnonzero(t)
                columns = [*([[group] * len(hit)] if within_ else []), hit, [x] * len(hit), t[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            totals.clear()

        open_: tuple | None = None
        held: list[pa.Array] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch.column(0).dictionary_encode()
            codes = np.asarray(seen.indices)
            edge = np.flatnonzero(np.diff(codes, prepend=-1, append=-1))
            for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                name = seen.dictionary[int(codes[s])].as_py()
                if open_ is None or open_[0] != name:
                    if open_:
                        add(*open_, held)
                    open_, held = (name, batch.column(1)[s].as_py(), batch.column(3)[s].as_py() if within_ else None), []
                held.append(batch.column(2).slice(s, e - s))
            if len(totals) * n_boot > 5_000_000:
                yield from flush()
        if open_:
            add(*open_, held)
        yield from flush()

    out = sent.mapInArrow(run, schema)
    if usual is rows:
        return out
    few = rows.join(long.withColumnRenamed(replicate, "_long"), F.col(replicate).eqNullSafe(F.col("_long")), "left_semi")
    return out.unionByName(_by_rows(few, replicate, order, label, n_boot, seed, within_))


def _by_rows(rows: DataFrame, replicate: str, order: list[str], label: str, n_boot: int, seed: int, within: list[str]) -> DataFrame:
    """The same with a row for each end of each block; series are numbered and counted in ranges."""
    keys = [*dict.fromkeys([replicate, *within])]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_length").alias("length"))
    names = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect()]  # labels are few
    placed = ranges.numbered(rows, [replicate], order, name="_i").withColumn("_block", F.floor(F.col("_i") / ranges.ROWS))
    for k, x in enumerate(names):
        placed = ranges.running(placed, [replicate], "_block", ["_i"], F.when(F.col(label) == x, 1).otherwise(0), f"_h{k}")
    ends_at = placed.select(replicate, "_i", *(f"_h{k}" for k in range(len(names))))
    whole = rows.groupBy(replicate).agg(*(F.count(F.when(F.col(label) == x, 1)).alias(f"_a{k}") for k, x in enumerate(names)))
    starts = sizes.select(*keys, "n", "length", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("length")).cast("int") - 1)))
    start = counter_uniform(F.col("n"), F.lit(seed), F.col("b"), F.col(replicate), F.col("k"))
    span = F.least(F.col("length"), F.col("n") - F.col("k") * F.col("length"))
    ends = starts.withColumn("_s", start).withColumn("_e", F.col("_s") + span).select(*keys, "b", F.explode(F.array(F.struct((F.col("_e") % F.col("n")).alias("i"), F.lit(1).alias("sign"), F.floor(F.col("_e") / F.col("n")).alias("round")), F.struct(F.col("_s").alias("i"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("round")))).alias("x"))
    met = ends.select(*keys, "b", F.col("x.i").alias("_i"), "x.sign", "x.round").join(ends_at, [replicate, "_i"]).join(whole, replicate)
    sums = met.groupBy(*within, "b").agg(*(F.sum(F.col("sign") * (F.col(f"_h{k}") + F.col("round") * F.col(f"_a{k}"))).alias(f"_h{k}") for k in range(len(names))))
    each = F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"_h{k}").alias("t")) for k, x in enumerate(names)))
    return sums.select(*within, "b", F.explode(each).alias("_e")).select(*within, "b", F.col("_e.label").alias(label), F.col("_e.t").cast("long").alias("t")).where("t > 0")


def bootstrap_populations(df: DataFrame, replicate: str, order: list[str], label: str, n_boot: int, length: int | DataFrame, seed: int = 0) -> DataFrame:
    """(b, label, population): the share of frames of every resample, zeros included."""
    counts = block_counts(df, replicate, order, label, n_boot, length, seed, []).groupBy("b", label).agg(F.sum("t").alias("t"))
    frame = df.select(label).distinct().crossJoin(df.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("b")))
    full = frame.join(counts, ["b", label], "left").fillna(0, ["t"])
    return full.select("b", label, (F.col("t") / F.sum("t").over(Window.partitionBy("b"))).alias("population"))


def profile_bands(df: DataFrame, replicate: str, order: list[str], value: str, bins: int, bounds: tuple[float, float], n_boot: int, length: int, seed: int = 0, temperature: float = 300.0) -> DataFrame:
    """(bin, sd, lo, hi, support): the spread over resamples of the one-dimensional free energy in each bin, relative to the resample's densest bin."""
    lo, hi = bounds
    binned = df.withColumn("bin", bin_index(F.col(value).cast("double"), F.lit(float(lo)), F.lit(float(hi)), bins)).where("bin is not null")
    counts = block_counts(binned, replicate, order, "bin", n_boot, length, seed, []).groupBy("b", "bin").agg(F.sum("t").alias("t")).where("t > 0")
    energy = counts.select("b", "bin", (-R * temperature * F.log(F.col("t") / F.max("t").over(Window.partitionBy("b")))).alias("g"))
    out = energy.groupBy("bin").agg(F.stddev_pop("g").alias("sd"), F.percentile("g", F.lit(0.025)).alias("lo"), F.percentile("g", F.lit(0.975)).alias("hi"), F.count("*").alias("_k"))
    return out.select("bin", "sd", "lo", "hi", (F.col("_k") / n_boot).alias("support"))


def summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Standard deviation (population), 2.5 and 97.5 percentiles over resamples, nulls left out, and the share of resamples that have a value."""
    v = F.col(value)
    return samples.groupBy(*by).agg(F.stddev_pop(v).alias("sd"), F.percentile(v, F.lit(0.025)).alias("lo"), F.percentile(v, F.lit(0.975)).alias("hi"), (F.count(v) / F.count("*")).alias("support"))


def two_sided_p(samples: Column, n: Column) -> Column:
    """Of an array of differences: twice the smaller tail, between 1/n and 1."""
    below, above = F.size(F.filter(samples, lambda d: d <= 0)), F.size(F.filter(samples, lambda d: d >= 0))
    return F.least(F.lit(1.0), F.greatest(2 * F.least(below, above) / n, 1 / n))


def relative_energy(population: Column, reference: Column, temperature: float = 300.0) -> Column:
    return F.when((population > 0) & (reference > 0), -R * temperature * F.log(population / reference))


def bootstrap_landscapes(df: DataFrame, replicate: str, order: list[str], x: str, y: str, bins: int, bounds: DataFrame, n_boot: int, length: int, seed: int = 0, weight: str | None = None, temperature: float = 300.0) -> DataFrame:
    """(b, ix, iy, probability, free_energy) of every resample on fixed edges; a frame drawn several times counts as often."""
    from terrane.operators import landscape

    w = F.col("times") * (F.col(weight).cast("double") if weight else F.lit(1.0))
    drawn = resampled(df, replicate, order, n_boot, length, seed).withColumn("_w", w)
    return landscape.grid(drawn, x, y, bins, bounds, "_w", temperature, by=["b"])


def cell_intervals(samples: DataFrame, n_boot: int, least_support: float = 0.5) -> DataFrame:
    """Standard deviation and interval of every cell's energy; null where fewer than `least_support` of the resamples reached it."""
    out = samples.groupBy("ix", "iy").agg(F.stddev_pop("free_energy").alias("sd"), F.percentile("free_energy", F.lit(0.025)).alias("lo"), F.percentile("free_energy", F.lit(0.975)).alias("hi"), (F.count("free_energy") / F.lit(n_boot)).alias("support"))
    rare = F.col("support") < least_support
    return out.select("ix", "iy", "support", *(F.when(~rare, F.col(c)).alias(c) for c in ("sd", "lo", "hi")))


def bootstrap_systems(df: DataFrame, system: str, replicate: str, order: list[str], label: str, n_boot: int, length: int | DataFrame, seed: int = 0) -> DataFrame:
    """(system, b, label, population) with resamples drawn inside each system. `length` is one for all, or a table (system, replicate, length)."""
    keyed = df.withColumn("_rep", F.concat_ws("/", system, replicate))
    if not isinstance(length, int):
        length = length.select(F.concat_ws("/", system, replicate).alias("_rep"), "length")
    counts = block_counts(keyed, "_rep", order, label, n_boot, length, seed, [system]).groupBy(system, "b", label).agg(F.sum("t").alias("t"))
    frame = df.select(system, label).distinct().crossJoin(df.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("b")))
    full = frame.join(counts, [system, "b", label], "left").fillna(0, ["t"])
    return full.select(system, "b", label, (F.col("t") / F.sum("t").over(Window.partitionBy(system, "b"))).alias("population"))


def difference_spread(samples: DataFrame, system: str, reference: str, cell: list[str], value: str) -> DataFrame:
    """Standard deviation over resamples of each system's difference from the reference, cell by cell."""
    ref = samples.where(F.col(system) == reference).select("b", *cell, F.col(value).alias("_ref"))
    return samples.where(F.col(system) != reference).join(ref, ["b", *cell]).groupBy(system, *cell).agg(F.stddev_pop(F.col(value) - F.col("_ref")).alias("sd"))


def resegmented(samples: DataFrame, basins: DataFrame, bins: int, temperature: float = 300.0) -> DataFrame:
    """(b, basin_id, population, min_free_energy, n_states): every resampled landscape segmented anew, its basins matched to the reference's by overlap.

    One resample is one task's group of at most bins**2 rows, so resamples run in parallel. Basins without a match have a null id.
    """
    import pandas as pd

    from terrane.operators import segment

    reference = np.zeros((bins, bins), int)
    for r in basins.select("ix", "iy", "basin_id").collect():  # one landscape
        reference[r["iy"], r["ix"]] = r["basin_id"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, g = np.zeros((bins, bins)), np.full((bins, bins), np.nan)
        p[rows["iy"], rows["ix"]], g[rows["iy"], rows["ix"]] = rows["probability"], rows["free_energy"].astype(float)
        found = segment.segmented(p, g, p > 0, temperature=temperature)
        names = [int(k) for k in np.unique(found) if k]
        inside = {}
        for k in names:
            at = np.where(found == k, np.nan_to_num(g, nan=np.inf), np.inf)
            inside[k] = int(reference[np.unravel_index(at.argmin(), at.shape)])
        to = segment.matched(reference, found, p, inside)
        return pd.DataFrame({"b": key[0], "basin_id": pd.Series([to.get(k) for k in names], dtype="Int32"), "population": [float(p[found == k].sum()) for k in names], "min_free_energy": [float(np.nanmin(g[found == k])) for k in names], "n_states": len(names)})

    return samples.groupBy("b").applyInPandas(run, "b int, basin_id int, population double, min_free_energy double, n_states int")


def state_counts(resegmented_: DataFrame) -> DataFrame:
    """How many resamples had how many states."""
    n = resegmented_.select("b", "n_states").distinct().groupBy("n_states").agg(F.count("*").alias("resamples"))
    return n.withColumn("fraction", F.col("resamples") / F.sum("resamples").over(Window.partitionBy()))

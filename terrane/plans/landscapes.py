"""Landscapes, states and comparison over lineitem: quantity and price as the two variables, line numbers as replicates, return flags as systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.operators import compare, landscape, states
from terrane.plans.registry import FRAMES, RT, WEIGHTED, Tables, hist_sql, query, r

X, Y, N = "l_quantity", "l_extendedprice", 32


def frames(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("w", 1 + F.col("l_tax"))


def cells(g: DataFrame, *by: str) -> DataFrame:
    return g.select(*by, "ix", "iy", "x_center", "y_center", "frames", r("probability", 9).alias("probability"), r("free_energy").alias("free_energy"))


GRID = f"p AS (SELECT *, w / sum(w) OVER () AS p FROM h), g AS (SELECT *, -{RT} * ln(p / max(p) OVER ()) AS ge FROM p)"
CELLS = "ix, iy, xc AS x_center, yc AS y_center, frames, round(p, 9) AS probability, round(ge, 6) AS free_energy"


@query(f"WITH {hist_sql(FRAMES, N)}, {GRID} SELECT {CELLS} FROM g")
def fel_grid(t: Tables) -> DataFrame:
    return cells(landscape.grid(frames(t), X, Y, N))


@query(f"WITH {hist_sql(WEIGHTED, N)}, {GRID} SELECT {CELLS} FROM g")
def fel_grid_weighted(t: Tables) -> DataFrame:
    return cells(landscape.grid(frames(t), X, Y, N, weight="w"))


@query(f"WITH {hist_sql(FRAMES, N, 'SELECT 10.0::DOUBLE AS xlo, 40.0::DOUBLE AS xhi, 20000.0::DOUBLE AS ylo, 60000.0::DOUBLE AS yhi')}, {GRID} SELECT {CELLS} FROM g")
def fel_grid_fixed_range(t: Tables) -> DataFrame:
    return cells(landscape.grid(frames(t), X, Y, N, landscape.fixed_range(t.spark, 10, 40, 20000, 60000)))


KEYED = f"p AS (SELECT *, w / sum(w) OVER (PARTITION BY k) AS p FROM h), g AS (SELECT *, -{RT} * ln(p / max(p) OVER (PARTITION BY k)) AS ge FROM p)"


@query(f"WITH {hist_sql(FRAMES.replace('SELECT', 'SELECT l_linenumber AS k,'), 16, by='k')}, {KEYED} SELECT k AS replicate, {CELLS} FROM g")
def fel_grid_per_replicate(t: Tables) -> DataFrame:
    f = frames(t).withColumnRenamed("l_linenumber", "replicate")
    return cells(landscape.grid(f, X, Y, 16, by=["replicate"]), "replicate")


BLUR = f"""WITH {hist_sql(FRAMES, 16)}, n AS (SELECT ix, iy, w / sum(w) OVER () AS p FROM h),
k AS (SELECT k, exp(-0.5 * k * k) AS e FROM (SELECT unnest(range(-4, 5)) AS k)), kn AS (SELECT k, e / sum(e) OVER () AS e FROM k), t AS (SELECT unnest(range(0, 16)) AS t),
a AS (SELECT t AS ix, n.iy, sum(n.p * kn.e) AS p FROM t, kn, n WHERE n.ix = greatest(0, least(15, t + k)) GROUP BY t, n.iy),
b2 AS (SELECT a.ix, t AS iy, sum(a.p * kn.e) AS p FROM t, kn, a WHERE a.iy = greatest(0, least(15, t + k)) GROUP BY a.ix, t),
o AS (SELECT b2.ix, b2.iy, b2.p / sum(b2.p) OVER () AS p, n.p IS NOT NULL AS occupied FROM b2 LEFT JOIN n USING (ix, iy)),
m AS (SELECT *, max(CASE WHEN occupied THEN p END) OVER () AS top FROM o)
SELECT ix::INT AS ix, iy::INT AS iy, round(p, 9) AS probability, occupied, round(CASE WHEN p >= 1e-6 * top THEN -{RT} * ln(p / top) END, 6) AS free_energy FROM m"""


@query(BLUR)
def fel_grid_smoothed(t: Tables) -> DataFrame:
    g = landscape.smoothed(landscape.histogram(frames(t), X, Y, 16), 16, 1.0)
    return g.select("ix", "iy", r("probability", 9).alias("probability"), "occupied", r("free_energy").alias("free_energy"))


@query("""WITH q AS (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS b,
max(l_quantity) - min(l_quantity) AS ra, max(l_extendedprice) - min(l_extendedprice) AS rb, power(count(*)::DOUBLE, -1.0/3) AS c FROM lineitem)
SELECT least(128, greatest(16, ceil(ra / (2 * a * c)), ceil(rb / (2 * b * c))))::INT AS bins FROM q""")
def fd_bins(t: Tables) -> DataFrame:
    return landscape.automatic_bins(t.lineitem, X, Y)


def _marginal(axis: str) -> str:
    return f"WITH {hist_sql(FRAMES, N)}, {GRID}, m AS (SELECT i{axis}, {axis}c, sum(p) AS p FROM g GROUP BY ALL) SELECT i{axis}, {axis}c AS center, round(p, 9) AS probability, round(-{RT} * ln(p / max(p) OVER ()), 6) AS free_energy FROM m"


def _profile(t: Tables, axis: str) -> DataFrame:
    m = landscape.marginal(landscape.grid(frames(t), X, Y, N), axis)
    return m.select(f"i{axis}", F.col(f"{axis}_center").alias("center"), r("probability", 9).alias("probability"), r("free_energy").alias("free_energy"))


@query(_marginal("x"))
def marginal_profile_x(t: Tables) -> DataFrame:
    return _profile(t, "x")


@query(_marginal("y"))
def marginal_profile_y(t: Tables) -> DataFrame:
    return _profile(t, "y")


@query(f"""WITH f AS (SELECT value AS x, 1 + user_id % 3 AS w FROM events), b AS (SELECT min(x) AS lo, max(x) AS hi FROM f), s AS (SELECT *, (hi - lo) / 40 AS st FROM f, b),
i AS (SELECT *, floor((x - lo) / st) AS i0 FROM s), c AS (SELECT w, least(39, i0 - CASE WHEN x < lo + i0 * st THEN 1 ELSE 0 END + CASE WHEN x >= lo + (i0 + 1) * st THEN 1 ELSE 0 END)::INT AS ix FROM i),
h AS (SELECT ix, count(*) AS n, sum(w)::DOUBLE AS w FROM c GROUP BY ix), e AS (SELECT k::INT AS ix, lo + (k + 0.5) * ((hi - lo) / 40) AS center, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM b, (SELECT unnest(range(0, 40)) AS k) LEFT JOIN h ON h.ix = k),
p AS (SELECT *, w / sum(w) OVER () AS p FROM e)
SELECT ix, round(center, 6) AS center, n AS count, round(w, 6) AS weight_sum, round(p, 9) AS probability, round(CASE WHEN p > 0 THEN -{RT} * ln(p / max(p) OVER ()) END, 6) AS pmf FROM p""")
def pmf_1d(t: Tables) -> DataFrame:
    out = landscape.pmf(t.events.withColumn("w", 1 + F.col("user_id") % 3), "value", 40, "w")
    return out.select("ix", r("center").alias("center"), "count", r("weight_sum").alias("weight_sum"), r("probability", 9).alias("probability"), r("pmf").alias("pmf"))


# Basins of these queries are the four quarters of the grid, so that SQL can follow; `segmentation` uses the real kernel.
QUARTERS = "1 + ix // 16 + 2 * (iy // 16)"


def quartered(g: DataFrame) -> DataFrame:
    return g.withColumn("basin_id", (1 + F.floor(F.col("ix") / 16) + 2 * F.floor(F.col("iy") / 16)).cast("int"))


def placed(t: Tables) -> DataFrame:
    f = frames(t)
    b = landscape.binned(f, X, Y, N, landscape.value_range(f, X, Y))
    return states.assigned(b, quartered(landscape.grid(f, X, Y, N)))


@query(f"WITH {hist_sql(FRAMES, N)} SELECT ({QUARTERS})::INT AS basin_id, count(*) AS frames, round(sum(x), 2) AS total FROM c GROUP BY ALL")
def assign_basin(t: Tables) -> DataFrame:
    return placed(t).groupBy("basin_id").agg(F.count("*").alias("frames"), r(F.sum(X), 2).alias("total"))


POP = f"WITH {hist_sql(WEIGHTED, N)}, q AS (SELECT ({QUARTERS})::INT AS basin_id, count(*) AS frames, sum({{w}}) AS s FROM c GROUP BY ALL), p AS (SELECT basin_id, frames, s / sum(s) OVER () AS population FROM q)"


@query(POP.format(w="1.0::DOUBLE") + " SELECT basin_id, frames, round(population, 9) AS population FROM p")
def state_populations(t: Tables) -> DataFrame:
    return states.populations(placed(t)).select("basin_id", "frames", r("population", 9).alias("population"))


@query(POP.format(w="w") + " SELECT basin_id, frames, round(population, 9) AS population FROM p")
def state_populations_weighted(t: Tables) -> DataFrame:
    return states.populations(placed(t), weight="w").select("basin_id", "frames", r("population", 9).alias("population"))


@query(POP.format(w="1.0::DOUBLE") + ", k AS (SELECT *, row_number() OVER (ORDER BY population DESC, basin_id) AS n FROM p) SELECT basin_id, n::INT AS rank, chr((64 + n)::INT) AS state FROM k WHERE n = 1 OR (population >= 0.05 AND n <= 3)")
def major_states(t: Tables) -> DataFrame:
    return states.ranked(states.populations(placed(t)), most=3).select("basin_id", "rank", "state")


@query("SELECT event_type, n, chr((65 + (row_number() OVER (ORDER BY n DESC, event_type) - 1) % 26)::INT) AS label FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def state_labels(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("label", F.char(65 + (F.row_number().over(Window.orderBy(F.desc("n"), "event_type")) - 1) % 26))


BASINS = f"WITH {hist_sql(FRAMES, N)}, {GRID}, q AS (SELECT *, ({QUARTERS})::INT AS basin FROM g)"


@query(BASINS + ", m AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY ge, iy, ix) AS n FROM q) SELECT basin AS basin_id, ix, iy, round(ge, 6) AS min_free_energy FROM m WHERE n = 1")
def basin_minima(t: Tables) -> DataFrame:
    return states.minima(quartered(landscape.grid(frames(t), X, Y, N))).select("basin_id", "ix", "iy", r("min_free_energy").alias("min_free_energy"))


SADDLE = BASINS + """, n AS (SELECT a.basin AS a, b.basin AS b, greatest(a.ge, b.ge) AS s FROM q a JOIN q b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1) WHERE a.basin <> b.basin),
d AS (SELECT least(a, b) AS low, greatest(a, b) AS high, min(s) AS saddle FROM n GROUP BY 1, 2), m AS (SELECT basin, min(ge) AS g0 FROM q GROUP BY 1)"""


@query(SADDLE + " SELECT low, high, round(saddle, 6) AS saddle FROM d")
def saddles(t: Tables) -> DataFrame:
    return states.saddles(quartered(landscape.grid(frames(t), X, Y, N))).select("low", "high", r("saddle").alias("saddle"))


@query(SADDLE + " SELECT low, high, round(saddle, 6) AS saddle, round(saddle - m1.g0, 6) AS barrier_from_low, round(saddle - m2.g0, 6) AS barrier_from_high FROM d JOIN m m1 ON m1.basin = low JOIN m m2 ON m2.basin = high")
def barriers(t: Tables) -> DataFrame:
    return states.barriers(quartered(landscape.grid(frames(t), X, Y, N))).select("low", "high", *(r(c).alias(c) for c in ("saddle", "barrier_from_low", "barrier_from_high")))


@query()
def segmentation(t: Tables) -> DataFrame:
    """Watershed basins of every system's landscape."""
    from terrane.operators import segment

    f = frames(t)
    g = landscape.grid(f, X, Y, 24, landscape.value_range(f, X, Y, 0.05), by=["l_returnflag"])
    return segment.basins(g, "l_returnflag", 24)


SYSTEMS = f"WITH {hist_sql(FRAMES.replace('SELECT', 'SELECT l_returnflag AS k,'), 16, by='k')}, {KEYED}"


def system_grids(t: Tables) -> DataFrame:
    return landscape.grid(frames(t).withColumnRenamed("l_returnflag", "system"), X, Y, 16, by=["system"])


@query(SYSTEMS + """, a AS (SELECT ix, iy, ge FROM g WHERE k = 'A'), n AS (SELECT DISTINCT k FROM g WHERE k <> 'A'), l AS (SELECT n.k, a.ix, a.iy, a.ge FROM n, a), o AS (SELECT k, ix, iy, ge FROM g WHERE k <> 'A')
SELECT k AS system, ix, iy, round(l.ge, 6) AS g_ref, round(o.ge, 6) AS g_sys, round(o.ge - l.ge, 6) AS ddg FROM l FULL JOIN o USING (k, ix, iy)""")
def ddg_map(t: Tables) -> DataFrame:
    return compare.difference_map(system_grids(t), "system", "A").select("system", "ix", "iy", r("g_ref").alias("g_ref"), r("g_sys").alias("g_sys"), r("ddg").alias("ddg"))


@query(SYSTEMS + f""", e AS (SELECT k, ix, iy, exp(-ge / ({RT})) AS e FROM g), q AS (SELECT k, ix, iy, e / sum(e) OVER (PARTITION BY k) AS p FROM e),
n AS (SELECT x.k AS a, y.k AS b FROM (SELECT DISTINCT k FROM q) x, (SELECT DISTINCT k FROM q) y WHERE x.k < y.k),
l AS (SELECT n.a, n.b, q.ix, q.iy, q.p FROM n JOIN q ON q.k = n.a), m AS (SELECT n.a, n.b, q.ix, q.iy, q.p AS q FROM n JOIN q ON q.k = n.b),
j AS (SELECT a, b, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM l FULL JOIN m USING (a, b, ix, iy)), z AS (SELECT a, b, sum(sqrt(p * q)) AS bc,
 sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js, count(*) FILTER (p > 0 AND q > 0) / count(*) AS jc FROM j GROUP BY a, b)
SELECT a, b, round(bc, 6) AS bhattacharyya, round(sqrt(greatest(0, 1 - bc)), 6) AS hellinger, round(js, 6) AS js_bits, round(jc, 6) AS jaccard FROM z""")
def landscape_overlap(t: Tables) -> DataFrame:
    return compare.overlaps(system_grids(t), "system").select("a", "b", *(r(c).alias(c) for c in ("bhattacharyya", "hellinger", "js_bits", "jaccard")))


@query("SELECT a.l_returnflag AS a, b.l_returnflag AS b FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT l_returnflag FROM lineitem) b WHERE a.l_returnflag < b.l_returnflag")
def system_pairs(t: Tables) -> DataFrame:
    return compare.pairs_of(t.lineitem, "l_returnflag")


TABLE = """WITH n AS (SELECT l_returnflag AS s, l_linenumber AS k, count(*) AS total FROM lineitem GROUP BY 1, 2), h AS (SELECT l_returnflag AS s, l_linenumber AS k, l_linestatus AS st, count(*) AS c FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT s, st FROM h), f AS (SELECT n.s, d.st, n.total, coalesce(c, 0) AS c FROM n JOIN d USING (s) LEFT JOIN h USING (s, k, st)),
p AS (SELECT s, st, 100.0 * sum(c) / sum(total) AS pop, avg(100.0 * c / total) AS m, stddev_samp(100.0 * c / total) AS sd, count(*) AS n FROM f GROUP BY 1, 2)"""


@query(TABLE + " SELECT a.s AS system, a.st AS state, round(a.pop - b.pop, 6) AS difference FROM p a JOIN p b ON b.s = 'A' AND b.st = a.st WHERE a.s <> 'A'")
def population_difference(t: Tables) -> DataFrame:
    p = compare.population_table(t.lineitem, "l_returnflag", "l_linenumber", "l_linestatus")
    d = compare.against(p, "l_returnflag", "l_linestatus", "A")
    return d.select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("state"), r("difference").alias("difference"))


@query(TABLE + """ SELECT a.s AS system, a.st AS state, round((a.m - b.m) / sqrt(a.sd ** 2 / a.n + b.sd ** 2 / b.n), 5) AS welch_t,
round((a.sd ** 2 / a.n + b.sd ** 2 / b.n) ** 2 / ((a.sd ** 2 / a.n) ** 2 / (a.n - 1) + (b.sd ** 2 / b.n) ** 2 / (b.n - 1)), 5) AS welch_dof FROM p a JOIN p b ON b.s = 'A' AND b.st = a.st WHERE a.s <> 'A'""")
def welch_t(t: Tables) -> DataFrame:
    p = compare.population_table(t.lineitem, "l_returnflag", "l_linenumber", "l_linestatus")
    d = compare.against(p, "l_returnflag", "l_linestatus", "A")
    return d.select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("state"), r("welch_t", 5).alias("welch_t"), r("welch_dof", 5).alias("welch_dof"))


@query(SYSTEMS + ", q AS (SELECT k, ge, 1 + ix // 8 + 2 * (iy // 8) AS basin FROM g), m AS (SELECT k, basin, min(ge) AS g0 FROM q GROUP BY 1, 2) SELECT a.k AS system, a.basin::INT AS basin_id, round(a.g0, 6) AS min_free_energy, round(a.g0 - b.g0, 6) AS ddg FROM m a JOIN m b ON b.k = 'A' AND b.basin = a.basin")
def state_free_energy(t: Tables) -> DataFrame:
    g = system_grids(t).withColumn("basin_id", (1 + F.floor(F.col("ix") / 8) + 2 * F.floor(F.col("iy") / 8)).cast("int"))
    m = g.groupBy("system", "basin_id").agg(F.min("free_energy").alias("g0"))
    ref = F.broadcast(m.where("system = 'A'").select("basin_id", F.col("g0").alias("g1")))
    return m.join(ref, "basin_id").select("system", "basin_id", r("g0").alias("min_free_energy"), r(F.col("g0") - F.col("g1")).alias("ddg"))


@query("WITH n AS (SELECT l_returnflag AS s, l_linenumber AS k, count(*) AS t, count(*) FILTER (l_linestatus = 'F') AS c FROM lineitem GROUP BY 1, 2) SELECT s AS system, k AS replicate, round(100 * sqrt((c / t) * (1 - c / t) / t), 6) AS se FROM n")
def binomial_se(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_returnflag").alias("system"), F.col("l_linenumber").alias("replicate")).agg(F.count("*").alias("t"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("c"))
    p = F.col("c") / F.col("t")
    return n.select("system", "replicate", r(100 * F.sqrt(p * (1 - p) / F.col("t"))).alias("se"))


@query("SELECT round(sum(w) ** 2 / sum(w * w), 6) AS n_eff, count(*) AS n FROM (SELECT l_discount AS w FROM lineitem WHERE l_discount > 0)")
def kish_neff(t: Tables) -> DataFrame:
    w = t.lineitem.where("l_discount > 0").select(F.col("l_discount").alias("w"))
    return w.agg(r(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), F.count("*").alias("n"))


@query("SELECT l_linenumber AS replicate, round(sum(l_discount / s), 9) AS share, count(*) AS n FROM lineitem, (SELECT sum(l_discount) AS s FROM lineitem) GROUP BY 1")
def normalise_weights(t: Tables) -> DataFrame:
    """Weights as shares of their sum; one that is no weight is an error."""
    w = t.lineitem.select(F.col("l_linenumber").alias("replicate"), C.checked_weight(F.col("l_discount")).alias("w"))
    total = w.agg(F.sum("w").alias("s"))
    return w.crossJoin(F.broadcast(total)).groupBy("replicate").agg(r(F.sum(F.col("w") / F.col("s")), 9).alias("share"), F.count("*").alias("n"))


@query("SELECT l_quantity AS quantity, (CASE WHEN d >= 0.7 THEN 'high' WHEN d >= 0.5 THEN 'moderate' ELSE 'low' END) AS band, count(*) AS n FROM (SELECT l_quantity, l_quantity / 50.0 AS d FROM lineitem) GROUP BY ALL")
def describe_bands(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col(X).alias("quantity"), C.band(F.col(X) / 50.0).alias("band")).groupBy("quantity", "band").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT l_orderkey % 360 - l_partkey % 360 AS d FROM lineitem) SELECT d AS difference, round(d - 360.0 * round_even(d / 360.0, 0), 6) AS wrapped, count(*) AS n FROM d GROUP BY ALL")
def wrapped_diff(t: Tables) -> DataFrame:
    d = t.lineitem.select((F.col("l_orderkey") % 360 - F.col("l_partkey") % 360).alias("difference"))
    return d.groupBy("difference").agg(F.count("*").alias("n")).withColumn("wrapped", r(C.wrapped(F.col("difference"), 360.0)))


@query("SELECT l_linenumber AS replicate, round(sum(0.5 * 2.5 * (l_quantity - 25) * (l_quantity - 25)), 4) AS energy FROM lineitem GROUP BY 1")
def harmonic_bias(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_linenumber").alias("replicate")).agg(r(F.sum(C.harmonic(F.col(X), F.lit(25), F.lit(2.5))), 4).alias("energy"))


@query(r"SELECT p_name AS name, CASE WHEN s = '' THEN 'state' ELSE s END AS slug, count(*) AS n FROM (SELECT p_name, regexp_replace(regexp_replace(regexp_replace(trim(p_name), '^State\b', 'state'), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g') AS s FROM part) GROUP BY ALL")
def state_slug(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).withColumn("slug", C.slug(F.col("name")))


@query(SYSTEMS + ", q AS (SELECT k, ix, iy, ge, 1 + ix // 8 + 2 * (iy // 8) AS basin FROM g) SELECT k AS system, ix, iy, CASE WHEN basin = 1 THEN 'A' WHEN basin = 4 THEN 'B' ELSE 'minor' END AS label FROM q")
def bin_labels(t: Tables) -> DataFrame:
    """What each cell is called when two of four basins are states."""
    basin = (1 + F.floor(F.col("ix") / 8) + 2 * F.floor(F.col("iy") / 8)).cast("int")
    state = F.when(basin == 1, "A").when(basin == 4, "B")
    return system_grids(t).select("system", "ix", "iy", C.bin_label(state, basin, F.lit(True)).alias("label"))


@query(SYSTEMS + " SELECT round(least(35.0, quantile_cont(ge, 0.98)), 6) AS ceiling FROM g")
def colour_ceiling(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(round(landscape.colour_ceiling(system_grids(t)), 6),)], "ceiling double")


@query(SYSTEMS + """, m AS (SELECT ix, iy, avg(ge) AS m, stddev_pop(ge) AS sd, count(*) AS n FROM g GROUP BY 1, 2) SELECT g.k AS system, g.ix, g.iy, abs(round(ge - m, 9)) < 2 * round(sd, 9) AS insignificant FROM g JOIN m USING (ix, iy) WHERE n > 1""")
def insignificant_bins(t: Tables) -> DataFrame:
    """Cells in which a system lies within two deviations of the systems' mean."""
    g = system_grids(t)
    m = g.groupBy("ix", "iy").agg(F.avg("free_energy").alias("m"), F.stddev_pop("free_energy").alias("sd"), F.count("*").alias("n")).where("n > 1")
    rows = g.join(F.broadcast(m), ["ix", "iy"])
    return rows.select("system", "ix", "iy", C.insignificant(r(F.col("free_energy") - F.col("m"), 9), r("sd", 9)).alias("insignificant"))


@query(POP.format(w="1.0::DOUBLE").replace(" p AS (SELECT basin_id", " pops AS (SELECT basin_id").replace("1 + l_tax AS w", "1.0::DOUBLE AS w") + f""", {GRID}, k AS (SELECT *, row_number() OVER (ORDER BY population DESC, basin_id) AS n FROM pops), z AS (SELECT ({QUARTERS})::INT AS basin_id, ix, iy, ge, row_number() OVER (PARTITION BY ({QUARTERS}) ORDER BY ge, iy, ix) AS rk FROM g)
SELECT n::INT AS rank, chr((64 + n)::INT) AS state, format('{{:.1f}} %', 100 * population) AS share, ix, iy, round(ge, 4) + 0.0 AS depth FROM k JOIN z ON z.basin_id = k.basin_id AND rk = 1 WHERE n = 1 OR (population >= 0.05 AND n <= 3)""")
def state_records(t: Tables) -> DataFrame:
    """Major states as rows of a report."""
    pops = states.ranked(states.populations(placed(t)), most=3)
    return states.records(pops.join(states.minima(quartered(landscape.grid(frames(t), X, Y, N))), "basin_id"))

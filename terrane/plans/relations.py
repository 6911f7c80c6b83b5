"""Joins and dimension work: events against events, parts and suppliers as atoms, nations as residues."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import hills as hill_work
from terrane.operators import joins, representatives, residues, reweight, states, timeseries
from terrane.plans.registry import Tables, query, r
from terrane.plans.series import MICROS, ONE_SERIES


def side(t: Tables, kind: str) -> DataFrame:
    return t.events.where(F.col("event_type") == kind).select("user_id", F.expr(MICROS).alias("us"), "event_id", "value")


SIDES = "WITH l AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'view'), q AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'purchase')"
PICK = """, b AS (SELECT l.*, (SELECT max(q.us) FROM q WHERE q.user_id = l.user_id AND q.us {before} l.us) AS bu, (SELECT min(q.us) FROM q WHERE q.user_id = l.user_id AND q.us >= l.us) AS fu FROM l)"""


def _asof(which: str, before: str = "<=") -> str:
    return SIDES + PICK.format(before=before) + f", m AS (SELECT *, {which} AS mu FROM b) SELECT m.user_id, m.event_id, m.us, mu AS matched_time, q.value FROM m LEFT JOIN q ON q.user_id = m.user_id AND q.us = mu"


def _matched(t: Tables, **how) -> DataFrame:
    return joins.asof(side(t, "view"), side(t, "purchase"), ["user_id"], "us", "value", "event_id", **how)


@query(_asof("CASE WHEN bu IS NULL OR fu - us < us - bu THEN coalesce(fu, bu) ELSE bu END"))
def asof_nearest(t: Tables) -> DataFrame:
    return _matched(t, direction="nearest")


@query(_asof("fu"))
def asof_forward(t: Tables) -> DataFrame:
    return _matched(t, direction="forward")


@query(_asof("bu", "<"))
def asof_backward_strict(t: Tables) -> DataFrame:
    return _matched(t, direction="backward", strict=True)


@query(_asof("CASE WHEN us - bu <= 86400000000 THEN bu END"))
def asof_backward_tolerance(t: Tables) -> DataFrame:
    return _matched(t, direction="backward", tolerance=86400000000)


@query(SIDES + " SELECT l.user_id, l.event_id, round(coalesce(sum(q.value), 0), 4) AS total, count(q.us) AS n FROM l LEFT JOIN q ON q.user_id = l.user_id AND q.us < l.us GROUP BY 1, 2")
def range_join_accumulate(t: Tables) -> DataFrame:
    out = joins.accumulated_before(side(t, "view"), side(t, "purchase"), ["user_id"], "us", "value", "event_id")
    return out.select("user_id", "event_id", r("total", 4).alias("total"), "n")


def _once(t: Tables, kind: str) -> DataFrame:
    """One row a time: the greatest value."""
    return side(t, kind).groupBy("us").agg(F.max("value").alias("value"))


ONCE = "WITH l AS (SELECT epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'view'), q AS (SELECT epoch_us(ts) AS us, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)"


@query(ONCE + """, b AS (SELECT l.event_id, l.us, q.us AS bu, q.value AS bv FROM l ASOF LEFT JOIN q ON l.us >= q.us), f AS (SELECT l.event_id, q.us AS fu, q.value AS fv FROM l ASOF LEFT JOIN q ON l.us <= q.us)
SELECT event_id, us, CASE WHEN bu IS NULL OR fu - us < us - bu THEN coalesce(fu, bu) ELSE bu END AS matched_time, CASE WHEN bu IS NULL OR fu - us < us - bu THEN coalesce(fv, bv) ELSE bv END AS value FROM b JOIN f USING (event_id)""")
def asof_nearest_one_series(t: Tables) -> DataFrame:
    """The nearest purchase to every view, of whichever user, in ranges of time."""
    return joins.asof(side(t, "view"), _once(t, "purchase"), [], "us", "value", "event_id", "nearest", rows=ONE_SERIES)


@query("WITH l AS (SELECT epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'view'), q AS (SELECT epoch_us(ts) AS us, value FROM events WHERE event_type = 'purchase'), s AS (SELECT us, sum(sum(value)) OVER w AS total, sum(count(*)) OVER w AS n FROM q GROUP BY us WINDOW w AS (ORDER BY us)) SELECT l.event_id, round(coalesce(total, 0), 4) AS total, coalesce(n, 0)::BIGINT AS n FROM l ASOF LEFT JOIN s ON l.us > s.us")
def range_join_one_series(t: Tables) -> DataFrame:
    """Number and value of all purchases before every view, in ranges of time."""
    out = joins.accumulated_before(side(t, "view"), side(t, "purchase"), [], "us", "value", "event_id", rows=ONE_SERIES)
    return out.select("event_id", r("total", 4).alias("total"), "n")


@query("""WITH a AS (SELECT p_brand, p_type, min(p_partkey) AS first_order FROM part WHERE p_size < 25 GROUP BY 1, 2), b AS (SELECT p_brand, p_type, min(p_partkey) AS second_order FROM part WHERE p_size >= 25 GROUP BY 1, 2) SELECT * FROM a JOIN b USING (p_brand, p_type)""")
def common_key_mapping(t: Tables) -> DataFrame:
    return joins.common_keys(t.part.where("p_size < 25"), t.part.where("p_size >= 25"), ["p_brand", "p_type"], "p_partkey")


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND round(b.value, 1) = round(a.value, 1) AND b.user_id = a.user_id)")
def semi_join_rounded_time(t: Tables) -> DataFrame:
    key = ["user_id", F.round("value", 1).alias("k")]
    a, b = t.events.where("event_type = 'view'").select("event_id", *key), t.events.where("event_type = 'click'").select(*key)
    return a.join(b, ["user_id", "k"], "left_semi").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT upper(trim(p_name)) LIKE 'S%'")
def heavy_filter(t: Tables) -> DataFrame:
    return t.part.where(~F.upper(F.trim("p_name")).like("S%")).select("p_partkey", "p_name")


CONTACT = """WITH a AS (SELECT s_nationkey AS k, s_suppkey % 20 AS frame, s_acctbal / 1000.0 AS x, s_suppkey / 10.0 AS y FROM supplier), b AS (SELECT c_custkey % 20 AS frame, c_acctbal / 1000.0 AS x, c_custkey / 150.0 AS y FROM customer),
m AS (SELECT a.frame, k, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM a JOIN b USING (frame) GROUP BY 1, 2)"""


def contacts(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 20).alias("frame"), (F.col("s_acctbal") / 1000.0).alias("x"), (F.col("s_suppkey") / 10.0).alias("y"))
    b = t.customer.select((F.col("c_custkey") % 20).alias("frame"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") / 150.0).alias("y"))
    return residues.contacts(a, b, "frame", "k", ["x", "y"], 0.6)


@query(CONTACT + " SELECT frame, k AS nation, round(d, 6) AS min_distance, d < 0.6 AS in_contact FROM m")
def theta_contacts(t: Tables) -> DataFrame:
    return contacts(t).select("frame", F.col("k").alias("nation"), r("min_distance").alias("min_distance"), "in_contact")


PERSIST = CONTACT + ", p AS (SELECT k, count(*) FILTER (d < 0.6) / count(*) AS persistence, avg(d) AS mean_d, count(*) AS n FROM m GROUP BY 1)"


@query(PERSIST + " SELECT k AS nation, round(persistence, 9) AS persistence, round(mean_d, 6) AS mean_min_distance, n AS n_frames FROM p")
def contact_persistence(t: Tables) -> DataFrame:
    p = residues.persistence(contacts(t), "k")
    return p.select(F.col("k").alias("nation"), r("persistence", 9).alias("persistence"), r("mean_min_distance").alias("mean_min_distance"), "n_frames")


@query(PERSIST + " SELECT k AS nation FROM p WHERE persistence >= 0.5")
def binding_site(t: Tables) -> DataFrame:
    return residues.persistence(contacts(t), "k", least=0.5).select(F.col("k").alias("nation"))


@query(PERSIST + " SELECT n_name AS name, round(persistence, 9) AS persistence FROM nation LEFT JOIN p ON p.k = n_nationkey AND persistence >= 0.5")
def site_left_outer(t: Tables) -> DataFrame:
    p = residues.persistence(contacts(t), "k", least=0.5)
    return t.nation.join(F.broadcast(p), F.col("k") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("name"), r("persistence", 9).alias("persistence"))


@query("SELECT n_regionkey AS region, s_nationkey AS nation, min(s_suppkey) AS first_atom, arg_min(s_name, s_suppkey) AS s_name, count(*) AS n_atoms, row_number() OVER (ORDER BY min(s_suppkey)) - 1 AS ordinal FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")
def residue_groups(t: Tables) -> DataFrame:
    atoms = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    g = residues.groups(atoms, ["region", "nation"], "s_name", "s_suppkey")
    return g.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT l_returnflag AS k, round(sum(l_quantity * (1 + l_tax)) / sum(1 + l_tax), 6) AS x, round(sum(l_extendedprice * (1 + l_tax)) / sum(1 + l_tax), 4) AS y FROM lineitem GROUP BY 1")
def weighted_centroid(t: Tables) -> DataFrame:
    c = residues.centroid(t.lineitem.withColumn("w", 1 + F.col("l_tax")).withColumnRenamed("l_returnflag", "k"), ["k"], ["l_quantity", "l_extendedprice"], "w")
    return c.select("k", r("l_quantity").alias("x"), r("l_extendedprice", 4).alias("y"))


@query("WITH d AS (SELECT l_shipdate, l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS gap FROM lineitem) SELECT count(*) AS n, max(abs(gap)) AS widest FROM d WHERE abs(gap) > 40")
def dq_broken_chain(t: Tables) -> DataFrame:
    """Consecutive items of an order whose quantities differ by more than 40."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    gap = F.abs(F.col("l_quantity") - F.lag("l_quantity").over(w))
    return t.lineitem.select(gap.alias("gap")).where("gap > 40").agg(F.count("*").alias("n"), F.max("gap").alias("widest"))


TOP = "WITH c AS (SELECT l_returnflag AS k, avg(l_quantity) AS cx, avg(l_extendedprice) / 1000 AS cy FROM lineitem GROUP BY 1), f AS (SELECT l_returnflag AS k, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS row, l_linenumber, sqrt(power(l_quantity - cx, 2) + power(l_extendedprice / 1000 - cy, 2)) AS d FROM lineitem JOIN c ON c.k = l_returnflag)"


def _frames(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_returnflag").alias("k"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("row"))


def _centers(f: DataFrame) -> DataFrame:
    return f.groupBy("k").agg(F.avg("l_quantity").alias("cx"), F.avg("y").alias("cy"))


@query(TOP + ", n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d, 9), row) AS n FROM f) SELECT k, row, round(d, 6) AS distance FROM n WHERE n = 1")
def nearest_frame(t: Tables) -> DataFrame:
    f = _frames(t)
    return states.nearest_frame(f, _centers(f), "k", "l_quantity", "y", "row").select("k", "row", r("distance").alias("distance"))


@query(TOP + ", u AS (SELECT DISTINCT k, row, round(d, 6) AS d FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, row) AS n FROM u) SELECT k, row, n::INT AS rank, d AS distance FROM n WHERE n <= 5")
def topk_representatives(t: Tables) -> DataFrame:
    f = _frames(t)
    d = f.join(F.broadcast(_centers(f)), "k").select("k", "row", r(F.sqrt(F.pow(F.col("l_quantity") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))).alias("distance")).distinct()
    return states.top_k(d, "k", "distance", "row", 5)


@query("WITH d AS (SELECT a.s_nationkey AS k, a.s_suppkey AS i, avg(abs(a.s_acctbal - b.s_acctbal)) AS m FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(m, 6), i) AS n FROM d) SELECT k, i AS medoid, round(m, 4) AS mean_distance FROM n WHERE n = 1")
def medoid(t: Tables) -> DataFrame:
    """The supplier of each nation nearest to the others on average."""
    s = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    d = representatives.distance_sums(s, ["k"], "x", "i").withColumn("m", F.col("total") / F.col("n"))
    return d.groupBy("k").agg(F.min(F.struct(r("m").alias("m"), "i")).alias("s")).select("k", F.col("s.i").alias("medoid"), r("s.m", 4).alias("mean_distance"))


@query("WITH g AS (SELECT s_nationkey AS nation, stddev_pop(s_acctbal) AS rmsf FROM supplier GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY rmsf DESC, nation) AS n FROM g) SELECT nation, round(rmsf, 6) AS rmsf FROM n WHERE n <= 5")
def topk_residues(t: Tables) -> DataFrame:
    g = residues.fluctuations(t.supplier.withColumnRenamed("s_nationkey", "nation"), ["nation"], ["s_acctbal"])
    return g.orderBy(F.desc("rmsf"), "nation").limit(5).select("nation", r("rmsf").alias("rmsf"))


HILLS = """WITH k AS (SELECT value AS center, epoch_us(ts) AS us, 1 + user_id % 3 AS height, 2.0 + event_id % 5 AS sigma FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id, value AS x, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
v AS (SELECT event_id, sum(CASE WHEN q < 6.25 THEN height * (1 / (1 - exp(-6.25)) * exp(-q) + 1 - 1 / (1 - exp(-6.25))) ELSE 0 END) AS bias FROM (SELECT f.event_id, k.height, 0.5 * power((x - center) / sigma, 2) AS q FROM f LEFT JOIN k ON {when}) GROUP BY 1)"""


def hills(t: Tables) -> DataFrame:
    h = t.events.where("event_type = 'purchase'")
    return h.select(F.col("value").alias("center"), F.expr(MICROS).alias("hill_time"), (1 + F.col("user_id") % 3).alias("height"), (2.0 + F.col("event_id") % 5).alias("sigma"))


def samples(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").select("event_id", F.col("value").alias("x"), F.expr(MICROS).alias("us"))


@query(HILLS.format(when="k.us < f.us") + " SELECT event_id, round(coalesce(bias, 0), 6) AS bias FROM v")
def hills_bias(t: Tables) -> DataFrame:
    """The bias of purchases, as hills, at the time of every view."""
    return reweight.bias_by_join(samples(t), hills(t), "event_id", "x", "us").select("event_id", r("bias").alias("bias"))


@query(HILLS.format(when="true") + ", w AS (SELECT event_id, bias / 2.5 AS lw, count(*) OVER () AS n FROM v), s AS (SELECT *, exp(lw - max(lw) OVER ()) AS e FROM w) SELECT event_id, round(e / sum(e) OVER () * n, 6) AS weight FROM s")
def metad_weights_final_bias(t: Tables) -> DataFrame:
    v = reweight.bias_by_join(samples(t), hills(t), "event_id", "x", None)
    return reweight.log_weights(v.withColumn("lw", F.col("bias") / 2.5), "lw").select("event_id", r("weight").alias("weight"))


@query("SELECT round(min(center) - 4 * max(sigma), 6) AS lo, round(max(center) + 4 * max(sigma), 6) AS hi, 200 AS points FROM (SELECT value AS center, 2.0 + event_id % 5 AS sigma FROM events WHERE event_type = 'purchase')")
def bias_grid(t: Tables) -> DataFrame:
    h = hills(t)
    return h.agg(r(F.min("center") - 4 * F.max("sigma")).alias("lo"), r(F.max("center") + 4 * F.max("sigma")).alias("hi"), F.lit(200).alias("points"))


@query("""WITH h AS (SELECT value AS center, row_number() OVER (ORDER BY ts, event_id) AS i, 1.0 + user_id % 3 AS height, 2.0 + event_id % 5 AS sigma FROM events WHERE event_type = 'purchase'), g AS (SELECT unnest(range(0, 50)) * 4.0 AS s),
k AS (SELECT i, s, CASE WHEN 0.5 * power((s - center) / sigma, 2) < 6.25 THEN height * (1 / (1 - exp(-6.25)) * exp(-0.5 * power((s - center) / sigma, 2)) + 1 - 1 / (1 - exp(-6.25))) ELSE 0 END AS v FROM h, g),
c AS (SELECT i, s, sum(v) OVER (PARTITION BY s ORDER BY i) AS v FROM k), e AS (SELECT i, v / 2.5 AS b, max(v / 2.5) OVER (PARTITION BY i) AS top FROM c) SELECT i::INT AS hill, round(2.5 * (max(top) + ln(sum(exp(b - top))) - ln(count(*))), 6) AS c FROM e GROUP BY i""")
def metad_rct(t: Tables) -> DataFrame:
    """c(t) after each hill of an untempered run, by a running bias at every grid point."""
    h = t.events.where("event_type = 'purchase'").select(F.col("value").alias("center"), "ts", "event_id", (1.0 + F.col("user_id") % 3).alias("height"), (2.0 + F.col("event_id") % 5).alias("sigma"))
    h = timeseries.global_ordinals(h, F.expr(MICROS), ["ts", "event_id"], "hill").withColumn("hill", (F.col("hill") + 1).cast("int"))
    return hill_work.constants(h, "hill", [np.arange(50) * 4.0], 2.5).select(F.col("hill").cast("int").alias("hill"), r("c").alias("c"))


#: Purchases as hills in two variables: the value, and the hour of the day, which wraps.
TWO = """k AS (SELECT value AS c1, hour(ts) + minute(ts) / 60.0 AS c2, epoch_us(ts) AS us, event_id, 1 + user_id % 3 AS height, 2.0 + event_id % 5 AS s1, 0.5 + (event_id % 3) / 4.0 AS s2 FROM events WHERE event_type = 'purchase')"""


def two_variables(t: Tables, kind: str) -> DataFrame:
    e = t.events.where(F.col("event_type") == kind).withColumn("us", F.expr(MICROS)).withColumn("c1", F.col("value").cast("double")).withColumn("c2", F.hour("ts") + F.minute("ts") / 60.0)
    return e.select("event_id", "us", "c1", "c2", F.col("us").alias("hill_time"), (1.0 + F.col("user_id") % 3).alias("height"), (2.0 + F.col("event_id") % 5).alias("s1"), (0.5 + F.col("event_id") % 3 / 4.0).alias("s2"))


@query(f"""WITH {TWO}, f AS (SELECT event_id, value AS x1, hour(ts) + minute(ts) / 60.0 AS x2, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
d AS (SELECT f.event_id, k.height, (x1 - c1) / s1 AS d1, (x2 - c2) AS d2, s2 FROM f JOIN k ON k.us < f.us AND abs(x1 - c1) < 22), q AS (SELECT event_id, height, 0.5 * (d1 * d1 + power((d2 - 24 * round_even(d2 / 24, 0)) / s2, 2)) AS q FROM d),
v AS (SELECT event_id, sum(height * (1 / (1 - exp(-6.25)) * exp(-q) + 1 - 1 / (1 - exp(-6.25)))) AS bias FROM q WHERE q < 6.25 GROUP BY 1) SELECT f.event_id, round(coalesce(bias, 0), 6) AS bias FROM f LEFT JOIN v USING (event_id)""")
def hills_bias_two_variables(t: Tables) -> DataFrame:
    """The bias of purchases in value and hour of the day at the time of every view."""
    out = hill_work.bias(two_variables(t, "view"), two_variables(t, "purchase"), "event_id", ["c1", "c2"], "us", [None, 24.0], ["c1", "c2"], ["s1", "s2"])
    return out.select("event_id", r("bias").alias("bias"))


@query(f"""WITH {TWO}, h AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS i FROM k), g AS (SELECT a.i * 20.0 AS p1, b.i * 3.0 AS p2, a.i * 8 + b.i AS s FROM range(0, 11) a(i), range(0, 8) b(i)),
q AS (SELECT h.i, s, height, 0.5 * (power((p1 - c1) / s1, 2) + power(((p2 - c2) - 24 * round_even((p2 - c2) / 24, 0)) / s2, 2)) AS q FROM h, g),
w AS (SELECT i, s, CASE WHEN q < 6.25 THEN height * (1 / (1 - exp(-6.25)) * exp(-q) + 1 - 1 / (1 - exp(-6.25))) ELSE 0 END AS v FROM q), c AS (SELECT i, s, sum(v) OVER (PARTITION BY s ORDER BY i) / 2.5 AS b FROM w),
e AS (SELECT i, b, max(b) OVER (PARTITION BY i) AS top FROM c) SELECT i::INT AS hill, round(2.5 * (max(10.0 / 9 * top) + ln(sum(exp(10.0 / 9 * (b - top)))) - max(top / 9) - ln(sum(exp((b - top) / 9)))), 6) AS c FROM e GROUP BY i""")
def metad_rct_two_variables(t: Tables) -> DataFrame:
    """c(t) of a tempered run in two variables, one of them periodic, on a grid of 11 x 8 points."""
    h = timeseries.global_ordinals(two_variables(t, "purchase"), F.col("us"), ["us", "event_id"], "hill").withColumn("hill", F.col("hill") + 1)
    out = hill_work.constants(h, "hill", [np.arange(11) * 20.0, np.arange(8) * 3.0], 2.5, 10.0, [None, 24.0], ["c1", "c2"], ["s1", "s2"])
    return out.select(F.col("hill").cast("int").alias("hill"), r("c").alias("c"))


PERIODIC = """WITH k AS (SELECT value % 360 AS center, epoch_us(ts) AS us, 1 + user_id % 3 AS height, 5.0 + event_id % 5 AS sigma FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id, value % 360 - 180 AS x, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
d AS (SELECT event_id, height, sigma, x - center AS d FROM f LEFT JOIN k ON k.us < f.us), q AS (SELECT event_id, height, 0.5 * power((d - 360 * round_even(d / 360, 0)) / sigma, 2) AS q FROM d)
SELECT event_id, round(coalesce(sum(CASE WHEN q < 6.25 THEN height * (1 / (1 - exp(-6.25)) * exp(-q) + 1 - 1 / (1 - exp(-6.25))) ELSE 0 END), 0), 6) AS bias FROM q GROUP BY 1"""


@query(PERIODIC)
def hills_bias_periodic(t: Tables) -> DataFrame:
    """The bias of hills on an angle, at angles written in another turn."""
    h = hills(t).select((F.col("center") % 360).alias("center"), "hill_time", "height", (F.col("sigma") + 3.0).alias("sigma"))
    f = samples(t).withColumn("x", F.col("x") % 360 - 180)
    return reweight.bias_by_join(f, h, "event_id", "x", "us", 360.0).select("event_id", r("bias").alias("bias"))


UMBRELLA = """WITH s AS (SELECT event_id, value AS x, user_id % 3 AS k FROM events), w AS (SELECT 0 AS k, 10.0 AS c, 0.02 AS kp UNION ALL SELECT 1, 30.0, 0.02 UNION ALL SELECT 2, 60.0, 0.02), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
u AS (SELECT s.event_id, w.k, 0.5 * kp / 2.5 * (x - c) * (x - c) AS u, n.n FROM s, w JOIN n USING (k)), d AS (SELECT event_id, max(ln(n) - u) AS top FROM u GROUP BY 1), l AS (SELECT u.event_id, any_value(top) + ln(sum(exp(ln(n) - u - top))) AS d FROM u JOIN d USING (event_id) GROUP BY 1)"""


def umbrella(t: Tables) -> tuple[DataFrame, list[int]]:
    s = t.events.select("event_id", F.col("value").alias("x"), (F.col("user_id") % 3).alias("k"))
    n = {x["k"]: x["count"] for x in s.groupBy("k").count().collect()}  # three windows
    return reweight.umbrella_energies(s, "x", [10.0, 30.0, 60.0], [0.02] * 3, 2.5), [n.get(k, 0) for k in range(3)]


@query(UMBRELLA + " SELECT k::INT AS k, round(-ln(sum(exp(-u - d))), 8) AS f FROM u JOIN l USING (event_id) GROUP BY k")
def mbar_sc_step(t: Tables) -> DataFrame:
    e, n = umbrella(t)
    return reweight.mbar_step(e, [0.0] * 3, n).select("k", r("f", 8).alias("f"))


@query(UMBRELLA + " SELECT event_id, round(e / sum(e) OVER (), 10) AS weight FROM (SELECT event_id, exp(min(d) OVER () - d) AS e FROM l)")
def umbrella_weights(t: Tables) -> DataFrame:
    e, n = umbrella(t)
    return reweight.unbiased_weights(e, [0.0] * 3, n).select("event_id", r("weight", 10).alias("weight"))


@query()
def mbar_free_energies(t: Tables) -> DataFrame:
    """Converged free energies of three windows."""
    e, n = umbrella(t)
    f = reweight.mbar(e.persist(), n, steps=30)
    e.unpersist()
    return t.spark.createDataFrame([(k, float(x)) for k, x in enumerate(f)], "k int, f double")


@query("SELECT a.event_id, (SELECT arg_min(b.value, (abs(epoch_us(b.ts) - epoch_us(a.ts)), -epoch_us(b.ts))) FROM (SELECT ts, user_id, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) b WHERE b.user_id = a.user_id) AS value FROM events a WHERE a.event_type = 'view'")
def asof_nearest_later(t: Tables) -> DataFrame:
    """For every view, the value of the nearest click of the user, the later one on ties."""
    a = t.events.where("event_type = 'view'").select("user_id", F.expr(MICROS).alias("us"), "event_id")
    b = t.events.where("event_type = 'click'").groupBy("user_id", F.expr(MICROS).alias("us")).agg(F.max("value").alias("value"))
    return joins.asof(a, b, ["user_id"], "us", "value", "event_id", "nearest", ties="later").select("event_id", "value")


@query("SELECT s_suppkey, s_nationkey, 'ligand' AS side FROM supplier WHERE s_nationkey IN (3, 7) UNION ALL SELECT s_suppkey, s_nationkey, 'protein' FROM supplier WHERE s_nationkey NOT IN (3, 7)")
def ligand_and_protein(t: Tables) -> DataFrame:
    """Suppliers of two nations, and all others."""
    sides = [residues.masked(t.supplier, "s_nationkey", [3, 7], keep).select("s_suppkey", "s_nationkey", F.lit(name).alias("side")) for keep, name in ((True, "ligand"), (False, "protein"))]
    return sides[0].unionByName(sides[1])


@query("SELECT e.event_id, v.label, round(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS norm2 FROM events e JOIN embeddings v ON v.vec_id = e.event_id")
def frame_vectors(t: Tables) -> DataFrame:
    """Events with the vector of the same number, as frames with their coordinates."""
    from terrane.functions.columns import dot

    v = t.embeddings.select(F.col("vec_id").alias("event_id"), "label", r(dot(F.col("embedding"), F.col("embedding"))).alias("norm2"))
    return t.events.select("event_id").join(v, "event_id")


@query(CONTACT + """, s AS (SELECT k, frame % 2 AS st, count(*) FILTER (d < 0.6) AS h, count(*) AS n FROM m GROUP BY 1, 2), o AS (SELECT k, sum(h) / sum(n) AS overall, greatest(max(h / n), sum(h) / sum(n)) AS most FROM s GROUP BY 1)
SELECT k AS nation, st AS state, round(h / n, 9) AS persistence, round(overall, 9) AS overall, round(most, 9) AS most FROM s JOIN o USING (k) WHERE most >= 0.3""")
def contact_persistence_by_state(t: Tables) -> DataFrame:
    """Contact persistence in even and odd frames, of nations that reach 0.3 somewhere."""
    p = residues.persistence_by_state(contacts(t).withColumn("state", F.col("frame") % 2), "k", "state", least=0.3)
    return p.select(F.col("k").alias("nation"), "state", *(r(c, 9).alias(c) for c in ("persistence", "overall", "most")))


@query("WITH f AS (SELECT s_nationkey AS nation, stddev_pop(s_acctbal) AS rmsf FROM supplier GROUP BY 1 HAVING count(*) > 2), s AS (SELECT DISTINCT c_nationkey AS nation FROM customer) SELECT nation, round(rmsf, 6) AS rmsf FROM s LEFT JOIN f USING (nation)")
def site_rmsf(t: Tables) -> DataFrame:
    """Fluctuations of the nations that customers come from; those with few suppliers have none."""
    f = t.supplier.withColumnRenamed("s_nationkey", "nation").withColumn("n", F.count("*").over(Window.partitionBy("nation"))).where("n > 2")
    f = residues.fluctuations(f, ["nation"], ["s_acctbal"])
    return residues.site_fluctuations(f, t.customer.select(F.col("c_nationkey").alias("nation")), "nation").select("nation", r("rmsf").alias("rmsf"))


@query("""WITH a AS (SELECT n_regionkey AS residue, n_name[1] AS atom, min(n_nationkey) AS o FROM nation WHERE n_nationkey < 20 GROUP BY 1, 2), b AS (SELECT n_regionkey AS residue, n_name[1] AS atom, min(n_nationkey) AS o FROM nation WHERE n_nationkey > 3 GROUP BY 1, 2), c AS (SELECT n_regionkey AS residue, n_name[1] AS atom, min(n_nationkey) AS o FROM nation GROUP BY 1, 2)
SELECT a.residue, a.atom, a.o AS order_0, b.o AS order_1, c.o AS order_2 FROM a JOIN b USING (residue, atom) JOIN c USING (residue, atom)""")
def common_atoms_of_three(t: Tables) -> DataFrame:
    """Keys that three tables with different chains have, by region and first letter."""
    n = t.nation.select(F.col("n_regionkey").alias("residue"), F.substring("n_name", 1, 1).alias("atom"), F.col("n_nationkey").alias("o"))
    three = [n.where("o < 20").withColumn("chain", F.lit("A")), n.where("o > 3").withColumn("chain", F.lit("B")), n.withColumn("chain", F.lit("A"))]
    return joins.common_to_all(three, "chain", "residue", "atom", "o").drop("chain")

"""Ordered, labelled series over events: users as replicates, event types as states with `error` unassigned, values as an observable."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.operators import compare, joins, kinetics, msm, resample, residues, timeseries
from terrane.plans.registry import QUERIES, Tables, query, r

STATES = ["click", "purchase", "signup", "view"]
CODE = "CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END"
ORDER = ["ts", "event_id"]
MAJOR = "SELECT user_id, ts, event_id, event_type AS st FROM events WHERE event_type <> 'error'"
STEPS = f"m AS ({MAJOR}), p AS (SELECT * FROM (SELECT user_id, st AS source, lead(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM m) WHERE target IS NOT NULL), l AS (SELECT DISTINCT st FROM m)"


#: Microseconds since 1970 of a timestamp without zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def steps(t: Tables) -> DataFrame:
    return kinetics.pairs(t.events, "user_id", ORDER, "event_type", STATES)


@query("SELECT user_id, count(*) AS n_frames, epoch_us(min(ts)) / 1e6 AS start, epoch_us(max(ts)) / 1e6 AS stop, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0), 6) AS dt FROM events GROUP BY 1")
def trajectory_summary(t: Tables) -> DataFrame:
    e = t.events.withColumn("us", F.expr(MICROS)).withColumn("s", F.col("us") / 1e6)
    out = e.groupBy("user_id").agg(F.count("*").alias("n_frames"), F.min("s").alias("start"), F.max("s").alias("stop"), (F.max("us") - F.min("us")).alias("span"))
    return out.withColumn("dt", r(F.col("span") / 1e6 / F.nullif(F.col("n_frames") - 1, F.lit(0)))).drop("span")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) SELECT event_id, user_id, frame FROM n WHERE frame % 3 = 0 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20'")
def time_window_stride(t: Tables) -> DataFrame:
    """Every third frame from the first one on, then the window."""
    n = t.events.withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))
    return n.where("frame % 3 = 0 and ts >= timestamp_ntz'2024-01-03 00:00:00' and ts <= timestamp_ntz'2024-01-20 00:00:00'").select("event_id", "user_id", "frame")


@query(f"WITH {STEPS}, n AS (SELECT source, target, count(*) AS n FROM p GROUP BY 1, 2) SELECT a.st AS source, b.st AS target, coalesce(n, 0) AS n FROM l a, l b LEFT JOIN n ON n.source = a.st AND n.target = b.st")
def transition_counts(t: Tables) -> DataFrame:
    return kinetics.transition_counts(steps(t), STATES)


@query(f"WITH {STEPS}, n AS (SELECT user_id, source, target, count(*) AS n FROM p GROUP BY 1, 2, 3), u AS (SELECT DISTINCT user_id FROM p) SELECT u.user_id, a.st AS source, b.st AS target, coalesce(n, 0) AS n FROM u, l a, l b LEFT JOIN n ON n.user_id = u.user_id AND n.source = a.st AND n.target = b.st")
def transition_counts_per_replicate(t: Tables) -> DataFrame:
    return kinetics.transition_counts(steps(t), STATES, "user_id")


@query(f"WITH {STEPS} SELECT user_id, source, target, count(*) AS n FROM p GROUP BY GROUPING SETS ((source, target), (user_id, source, target))")
def transition_counts_grouping_sets(t: Tables) -> DataFrame:
    return kinetics.grouped_counts(steps(t), "user_id")


@query(f"WITH {STEPS}, n AS (SELECT source, target, count(*) AS n FROM p GROUP BY 1, 2), f AS (SELECT a.st AS source, b.st AS target, coalesce(n, 0) AS n FROM l a, l b LEFT JOIN n ON n.source = a.st AND n.target = b.st) SELECT source, target, n, round(n / sum(n) OVER (PARTITION BY source), 9) AS probability FROM f")
def transition_matrix(t: Tables) -> DataFrame:
    m = kinetics.transition_matrix(kinetics.transition_counts(steps(t), STATES))
    return m.withColumn("probability", r("probability", 9))


VISITS = f"""{STEPS}, o AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
v AS (SELECT user_id, run::BIGINT AS run, any_value(st) AS state, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frames FROM g GROUP BY user_id, run), w AS (SELECT *, frames * 10.0::DOUBLE AS dwell, run = min(run) OVER (PARTITION BY user_id) OR run = max(run) OVER (PARTITION BY user_id) AS censored FROM v)"""


@query(f"WITH {VISITS} SELECT * REPLACE (epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time) FROM w")
def dwell_times(t: Tables) -> DataFrame:
    return kinetics.visits(t.events.withColumn("us", F.expr(MICROS)), "user_id", ORDER, "event_type", "us", STATES, 10.0)


#: Frames of a range of the queries that take all users as one series.
ONE_SERIES = 2000
WHOLE = "n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events)"


def as_one(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr(MICROS).alias("us"), "event_type", F.lit(0).alias("one"), F.expr(CODE).alias("micro"))


@query(f"WITH {WHOLE}, m AS (SELECT event_type AS st, lead(event_type) OVER (ORDER BY ts, event_id) AS target FROM events WHERE event_type <> 'error'), l AS (SELECT DISTINCT st FROM m), c AS (SELECT st AS source, target, count(*) AS n FROM m WHERE target IS NOT NULL GROUP BY ALL) SELECT a.st AS source, b.st AS target, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.source = a.st AND c.target = b.st")
def transition_counts_one_series(t: Tables) -> DataFrame:
    """Transitions of all events as one long replicate, cut in ranges with halos."""
    return kinetics.transition_counts(kinetics.pairs(as_one(t), "one", ["us", "event_id"], "event_type", STATES, rows_each=ONE_SERIES), STATES)


@query("""WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events WHERE event_type <> 'error'), g AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT run::BIGINT AS run, any_value(event_type) AS state, epoch_us(min(ts)) AS start_time, epoch_us(max(ts)) AS end_time, count(*) AS frames, count(*) * 10.0::DOUBLE AS dwell, run = 1 OR run = max(run) OVER () AS censored FROM g GROUP BY run""")
def dwell_times_one_series(t: Tables) -> DataFrame:
    """Visits of all events as one long replicate, stitched at the cuts of ranges."""
    return kinetics.visits(as_one(t), "one", ["us", "event_id"], "event_type", "us", STATES, 10.0, rows_each=ONE_SERIES).drop("one")


@query(f"WITH {WHOLE}, t AS (SELECT unnest([1, 7, 40]) AS lag), i AS (SELECT k, {CODE} AS i FROM n) SELECT lag::INT AS lag, a.i, b.i AS j, count(*) AS c FROM i a, t, i b WHERE b.k = a.k + lag AND a.i >= 0 AND b.i >= 0 AND a.k % lag = 0 GROUP BY ALL")
def msm_counts_one_series(t: Tables) -> DataFrame:
    """Strided counts at three lags of all events as one long replicate."""
    return msm.lagged_counts(as_one(t), "one", ["us", "event_id"], "micro", [1, 7, 40], sliding=False, rows_each=ONE_SERIES)


@query(f"""WITH {VISITS}, s AS (SELECT state, count(*) AS visits, count(*) FILTER (NOT censored) AS visits_uncensored, avg(dwell) FILTER (NOT censored) AS mean_dwell, quantile_cont(dwell, 0.5) FILTER (NOT censored) AS median_dwell, max(dwell) AS max_dwell, sum(dwell) AS total_time FROM w GROUP BY 1),
i AS (SELECT target AS state, count(*) AS n FROM p WHERE source <> target GROUP BY 1), o2 AS (SELECT source AS state, count(*) AS n FROM p WHERE source <> target GROUP BY 1)
SELECT state, visits, visits_uncensored, round(mean_dwell, 6) AS mean_dwell, median_dwell, max_dwell, total_time, coalesce(o2.n, 0) AS transitions_out, coalesce(i.n, 0) AS transitions_in, round(CASE WHEN o2.n > 0 THEN total_time / o2.n ELSE 'inf'::DOUBLE END, 6) AS lifetime FROM s LEFT JOIN o2 USING (state) LEFT JOIN i USING (state)""")
def dwell_summary(t: Tables) -> DataFrame:
    v = kinetics.visits(t.events, "user_id", ORDER, "event_type", "ts", STATES, 10.0)
    s = kinetics.visit_summary(v, steps(t))
    return s.withColumn("mean_dwell", r("mean_dwell")).withColumn("lifetime", r("lifetime"))


@query()
def mean_first_passage(t: Tables) -> DataFrame:
    """Mean first passage times from the pooled transition matrix."""
    import numpy as np

    rows = kinetics.transition_matrix(kinetics.transition_counts(steps(t), STATES)).collect()
    p = np.zeros((len(STATES), len(STATES)))
    for x in rows:
        p[STATES.index(x["source"]), STATES.index(x["target"])] = x["probability"] or 0
    m = kinetics.mean_first_passage(p, 10.0)
    return t.spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(STATES) for j, b in enumerate(STATES)], "source string, target string, mfpt double")


@query("WITH g AS (SELECT epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events) SELECT quantile_cont(gap, 0.5)::DOUBLE AS dt FROM g WHERE gap > 0")
def median_dt(t: Tables) -> DataFrame:
    return kinetics.frame_spacing(t.events.select("user_id", F.expr(MICROS).alias("us")), "us", "user_id")


@query("WITH u AS (SELECT DISTINCT epoch_us(ts) AS us FROM events), g AS (SELECT lead(us) OVER (ORDER BY us) - us AS gap FROM u) SELECT quantile_cont(gap, 0.5)::DOUBLE AS dt FROM g WHERE gap > 0")
def median_dt_unique(t: Tables) -> DataFrame:
    return kinetics.frame_spacing(t.events.select(F.expr(MICROS).alias("us")), "us")


def coded(t: Tables) -> DataFrame:
    return t.events.withColumn("micro", F.expr(CODE))


def _counts(lags: str, strided: str = "") -> str:
    return f"""WITH n AS (SELECT user_id, {CODE} AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), t AS (SELECT unnest([{lags}]) AS lag),
c AS (SELECT lag, a.i, b.i AS j FROM n a, t, n b WHERE b.user_id = a.user_id AND b.k = a.k + lag AND a.i >= 0 AND b.i >= 0 {strided}) SELECT lag::INT AS lag, i, j, count(*) AS c FROM c GROUP BY ALL"""


@query(_counts("1, 2, 5"))
def msm_counts_sliding(t: Tables) -> DataFrame:
    return msm.lagged_counts(coded(t), "user_id", ORDER, "micro", [1, 2, 5])


@query(_counts("1, 2, 5", "AND a.k % lag = 0"))
def msm_counts_strided(t: Tables) -> DataFrame:
    return msm.lagged_counts(coded(t), "user_id", ORDER, "micro", [1, 2, 5], sliding=False)


@query(_counts("2").replace("SELECT lag::INT AS lag, i, j, count(*) AS c FROM c GROUP BY ALL", ", d AS (SELECT i, j, count(*) AS c FROM c GROUP BY ALL) SELECT i, j, round(c / sum(c) OVER (PARTITION BY i), 9) AS p FROM d"))
def msm_transition_matrix(t: Tables) -> DataFrame:
    c = msm.lagged_counts(coded(t), "user_id", ORDER, "micro", [2])
    return c.select("i", "j", r(F.col("c") / F.sum("c").over(Window.partitionBy("i")), 9).alias("p"))


@query()
def msm_estimate(t: Tables) -> DataFrame:
    """Reversible estimates at several lags: stationary distribution and timescales."""
    c = msm.lagged_counts(coded(t), "user_id", ORDER, "micro", [1, 2, 5]).toPandas()
    rows = []
    for lag in (1, 2, 5):
        e = msm.estimate(msm.matrix(c[c.lag == lag], [0, 1, 2, 3]), lag)
        rows += [(lag, int(s), float(e["pi"][k]), float(e["timescales"][k - 1]) if k else None) for k, s in enumerate(e["active"])]
    return t.spark.createDataFrame(rows, "lag int, state int, stationary double, timescale double")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT * FROM e WHERE b IS NOT NULL),
t(a, b) AS (SELECT a, b FROM g UNION SELECT t.a, g.b FROM t JOIN g ON g.a = t.b) SELECT x.a AS state, min(x.b) AS component FROM t x JOIN t y ON y.a = x.b AND y.b = x.a GROUP BY 1""")
def scc_closure(t: Tables) -> DataFrame:
    """Strongly connected sets of states, named by their least member. States are few; their edges come from one aggregation."""
    edges = kinetics.pairs(t.events, "user_id", ORDER, "event_type").select("source", "target").distinct().collect()
    names = sorted({x for e in edges for x in e})
    import numpy as np

    c = np.zeros((len(names), len(names)))
    for a, b in edges:
        c[names.index(a), names.index(b)] = 1
    rows = [(names[i], names[min(s)]) for s in msm.connected(c) for i in s]
    return t.spark.createDataFrame(rows, "state string, component string")


@query("WITH n AS (SELECT event_type, user_id % 4 AS basin, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, basin, n, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS fraction, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, basin) = 1 AS best FROM n")
def overlap_crosstab(t: Tables) -> DataFrame:
    return msm.crosstab(t.events.withColumn("basin", F.col("user_id") % 4), "event_type", "basin").withColumn("fraction", r("fraction", 9))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type AS modal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) WHERE k = 1")
def modal_basin(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct(-F.col("n"), "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("modal"))


ACF = """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1),
c AS (SELECT a.user_id, b.k - a.k AS lag, sum((a.value - m) * (b.value - m)) / ((any_value(n) - (b.k - a.k)) * any_value(v)) AS c, any_value(n) AS n FROM o a JOIN o b ON b.user_id = a.user_id AND b.k > a.k {lags} JOIN s ON s.user_id = a.user_id GROUP BY a.user_id, b.k - a.k)"""


@query(ACF.format(lags="AND b.k - a.k <= 5") + " SELECT user_id, lag::INT AS lag, round(c, 6) AS c, n FROM c")
def acf_lags(t: Tables) -> DataFrame:
    return timeseries.autocorrelation(t.events, "user_id", ORDER, "value", 5).select("user_id", "lag", r("c").alias("c"), "n")


G = ACF.format(lags="") + """, z AS (SELECT user_id, min(lag) AS stop FROM c WHERE c <= 0 AND lag > 3 GROUP BY 1),
g AS (SELECT s.user_id, any_value(s.n) AS n, CASE WHEN any_value(s.n) < 4 THEN 1.0 ELSE greatest(1.0, 1 + 2 * coalesce(sum(c * (1 - lag / s.n)) FILTER (lag < coalesce(stop, s.n - 1)), 0)) END AS g FROM s LEFT JOIN c ON c.user_id = s.user_id LEFT JOIN z ON z.user_id = s.user_id GROUP BY s.user_id)"""


@query(G + " SELECT user_id, n, round(g, 5) AS g FROM g")
def statistical_inefficiency(t: Tables) -> DataFrame:
    return timeseries.effective_samples(t.events, "user_id", ORDER, "value").select("user_id", "n", r("g", 5).alias("g"))


@query(G.replace("PARTITION BY user_id ", "").replace("SELECT user_id, value, row_number()", "SELECT 0 AS user_id, value, row_number()").replace("SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1", "SELECT 0 AS user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events").replace("b.k > a.k ", "b.k BETWEEN a.k + 1 AND a.k + 150 ") + " SELECT n, round(g, 5) AS g, round(n / g, 4) AS n_eff FROM g WHERE EXISTS (FROM z)")
def n_eff_one_series(t: Tables) -> DataFrame:
    """Effective samples of all events as one long replicate, from blocks; in SQL, from lags to 150."""
    e = t.events.select(F.lit(0).alias("one"), F.expr(MICROS).alias("us"), "event_id", F.col("value").cast("double").alias("value"))
    return timeseries.effective_samples(e, "one", ["us", "event_id"], "value", ONE_SERIES).select("n", r("g", 5).alias("g"), r("n_eff", 4).alias("n_eff"))


@query(G + " SELECT user_id, round(n / g, 4) AS n_eff FROM g")
def n_eff(t: Tables) -> DataFrame:
    return timeseries.effective_samples(t.events, "user_id", ORDER, "value").select("user_id", r("n_eff", 4).alias("n_eff"))


@query(G + " SELECT user_id, greatest(1, least(ceil(2 * round(g, 5)), greatest(1, n // 5)))::BIGINT AS block_length FROM g")
def block_length(t: Tables) -> DataFrame:
    g = timeseries.effective_samples(t.events, "user_id", ORDER, "value")
    return g.select("user_id", timeseries.block_length(r("g", 5), F.col("n")).alias("block_length"))


#: Every start's series, its correlations to lag n - 2 and the first that is not positive; as pairs of frames, so in time of the cube of a series.
STARTS = """WITH o AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, {x} AS x FROM events)),
t AS (SELECT DISTINCT user_id, k AS t0, n - k AS len, n FROM o WHERE n >= 10 AND k < floor(0.9 * n)),
m AS (SELECT t.user_id, t0, any_value(len) AS len, any_value(t.n) AS n, avg(x) AS m, var_pop(x) AS v, min(x) < max(x) AS moves FROM t JOIN o ON o.user_id = t.user_id AND o.k >= t0 GROUP BY t.user_id, t0),
c AS (SELECT m.user_id, t0, b.k - a.k AS lag, sum((a.x - m) * (b.x - m)) / (any_value(len - (b.k - a.k)) * any_value(v)) AS c FROM m JOIN o a ON a.user_id = m.user_id AND a.k >= t0 JOIN o b ON b.user_id = m.user_id AND b.k > a.k WHERE moves GROUP BY m.user_id, t0, b.k - a.k),
z AS (SELECT user_id, t0, min(lag) AS stop FROM c WHERE c <= 0 AND lag > 3 GROUP BY 1, 2),
g AS (SELECT m.user_id, m.t0, any_value(n) AS n, CASE WHEN any_value(len) < 4 THEN 1.0 ELSE greatest(1.0, 1 + 2 * coalesce(sum(c * (1 - lag / len)) FILTER (lag < coalesce(stop, len - 1)), 0)) END AS g FROM m LEFT JOIN c USING (user_id, t0) LEFT JOIN z ON z.user_id = m.user_id AND z.t0 = m.t0 WHERE moves GROUP BY m.user_id, m.t0)"""


@query(STARTS.format(x="value") + " SELECT user_id, round(max((n - t0) / g), 5) AS n_eff, count(*) AS starts FROM g GROUP BY 1")
def equilibration_best(t: Tables) -> DataFrame:
    """The most effective samples that any start leaves, over users of ten frames or more, and how many starts were compared."""
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 10")
    best = timeseries.equilibrated(t.events, "user_id", ORDER, ["value"]).where("observable = 'value'")
    return best.join(n, "user_id").select("user_id", r("n_eff", 5).alias("n_eff"), F.floor(F.col("n") * 0.9).alias("starts"))


#: Two observables' starts; ends that do not move leave no start, and a user whose observable never moves keeps all frames.
BOTH = f"""WITH a AS (SELECT 'value' AS observable, * FROM ({STARTS.format(x="value")} SELECT * FROM g) UNION ALL SELECT 'hour', * FROM ({STARTS.format(x="hour(ts)::DOUBLE")} SELECT * FROM g)),
k AS (SELECT user_id, observable, arg_min(t0, (-round((n - t0) / g, 7), t0)) AS t0 FROM a GROUP BY 1, 2), w AS (SELECT k.*, g, n FROM k JOIN a USING (user_id, observable, t0)),
l AS (SELECT user_id, arg_max(observable, (t0, observable)) AS observable FROM w GROUP BY 1), j AS (SELECT user_id, t0, max(g) AS g, any_value(n) AS n FROM a GROUP BY 1, 2 HAVING count(*) = 2), i AS (SELECT user_id, arg_min(t0, (-round((n - t0) / g, 7), t0)) AS t0 FROM j GROUP BY 1)
SELECT user_id, observable, t0::INT AS t0, round(g, 5) AS g, round((n - t0) / g, 4) AS n_eff FROM (SELECT user_id, observable, t0, g, n FROM w UNION ALL SELECT user_id, 'latest', t0, g, n FROM w JOIN l USING (user_id, observable) UNION ALL SELECT user_id, 'joint', t0, g, n FROM j JOIN i USING (user_id, t0))"""


@query(BOTH)
def equilibration(t: Tables) -> DataFrame:
    """Start of the equilibrated part of each user's series: of two observables, the later one and the joint one."""
    e = t.events.withColumn("hour", F.hour("ts").cast("double"))
    out = timeseries.equilibrated(e.select("user_id", *ORDER, "value", "hour"), "user_id", ORDER, ["value", "hour"])
    return out.select("user_id", "observable", "t0", r("g", 5).alias("g"), r("n_eff", 4).alias("n_eff"))


@query(f"""WITH o AS (SELECT value AS p, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n, avg(value) OVER () AS m FROM events)
SELECT max(n) AS n, round(2.0 / max(n) * power(sum((p - m) * cos(1 * {math.pi} * k / (n - 1))), 2) / sum((p - m) * (p - m)), 8) AS cosine_content FROM o""")
def cosine_content(t: Tables) -> DataFrame:
    return timeseries.cosine_content(t.events, ORDER, "value", 1, key=F.expr(MICROS)).select("n", r("cosine_content", 8).alias("cosine_content"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS fraction),
k AS (SELECT fraction, event_type FROM o, f WHERE k <= greatest(1, floor(n * fraction))), c AS (SELECT fraction, event_type, count(*) AS n FROM k GROUP BY 1, 2) SELECT fraction, event_type, n, round(n / sum(n) OVER (PARTITION BY fraction), 9) AS population FROM c""")
def population_stability(t: Tables) -> DataFrame:
    k = timeseries.leading_fraction(t.events, "user_id", ORDER, [0.25, 0.5, 0.75, 1.0])
    c = k.groupBy("fraction", "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("population", r(F.col("n") / F.sum("n").over(Window.partitionBy("fraction")), 9))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(avg(value) FILTER (k <= n // 2), 6) AS first_half, round(avg(value) FILTER (k > n // 2), 6) AS second_half FROM o GROUP BY 1""")
def half_split_means(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    o = t.events.withColumn("k", F.row_number().over(w.orderBy(*ORDER))).withColumn("n", F.count("*").over(w))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    return o.groupBy("user_id").agg(r(F.avg(F.when(first, F.col("value")))).alias("first_half"), r(F.avg(F.when(~first, F.col("value")))).alias("second_half"))


@query("SELECT user_id, CASE WHEN n < 50 THEN 'Insufficient' WHEN a >= 0.7 AND b < 0.5 THEN 'Good' WHEN a >= 0.5 AND b < 0.7 THEN 'Mixed' ELSE 'Poor' END AS verdict FROM (SELECT user_id, count(*) AS n, (user_id % 10) / 10.0 AS a, (user_id % 7) / 7.0 AS b FROM events GROUP BY user_id)")
def sampling_verdict(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", timeseries.verdict((F.col("user_id") % 10) / 10.0, (F.col("user_id") % 7) / 7.0, F.col("n")).alias("verdict"))


REPLICATE = "WITH n AS (SELECT l_linenumber AS k, count(*) AS t, count(*) FILTER (l_returnflag = 'A') AS c FROM lineitem GROUP BY 1), p AS (SELECT 100.0 * c / t AS x FROM n)"


@query(REPLICATE + " SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(stddev_samp(x) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM p")
def replicate_population_stats(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_linenumber").agg((100.0 * F.count(F.when(F.col("l_returnflag") == "A", 1)) / F.count("*")).alias("x"))
    return p.agg(r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("sd"), r(F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


#: Student's quantiles at 97.5 % for one to eight degrees of freedom (fixed values).
STUDENT = "[12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135]"


@query(f"""WITH n AS (SELECT l_returnflag AS state, l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1, 2), t AS (SELECT l_linenumber AS k, count(*) AS t FROM lineitem GROUP BY 1), f AS (SELECT DISTINCT state, t.k, t FROM n, t), x AS (SELECT f.state, 100.0 * coalesce(c, 0) / t AS x FROM f LEFT JOIN n ON n.state = f.state AND n.k = f.k),
s AS (SELECT state, avg(x) AS m, stddev_samp(x) / sqrt(count(*)) AS sem, count(*) AS n FROM x GROUP BY 1) SELECT state, round(m, 6) AS mean, n, round(greatest(0, m - {STUDENT}[n - 1] * sem), 5) AS ci_low, round(least(100, m + {STUDENT}[n - 1] * sem), 5) AS ci_high FROM s""")
def replicate_population_intervals(t: Tables) -> DataFrame:
    """Means over replicates with Student intervals by state."""
    p = compare.population_table(t.lineitem.withColumn("s", F.lit("all")), "s", "l_linenumber", "l_returnflag")
    p = p.withColumn("sem", F.col("replicate_sd") / F.sqrt("n_replicates"))
    p = compare.replicate_intervals(p, "replicate_mean", "sem", "n_replicates")
    return p.select(F.col("l_returnflag").alias("state"), r("replicate_mean").alias("mean"), F.col("n_replicates").alias("n"), r("ci_low", 5).alias("ci_low"), r("ci_high", 5).alias("ci_high"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT *, least(k // greatest(1, n // 4), 3) AS block FROM o),
s AS (SELECT user_id, block, 100.0 * count(*) FILTER (event_type = 'view') / count(*) AS x FROM b GROUP BY 1, 2) SELECT user_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS block_sd, count(*) AS n_blocks FROM s GROUP BY 1""")
def block_population_stats(t: Tables) -> DataFrame:
    b = timeseries.in_blocks(t.events, "user_id", ORDER, 4)
    s = b.groupBy("user_id", "block").agg((100.0 * F.count(F.when(F.col("event_type") == "view", 1)) / F.count("*")).alias("x"))
    return s.groupBy("user_id").agg(r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("block_sd"), F.count("*").alias("n_blocks"))


DRAWS = """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT unnest(range(0, {n})) AS b),
k AS (SELECT b, user_id, n, unnest(range(0, ((n + 4) // 5)::BIGINT)) AS k FROM n, b), s AS (SELECT *, ('0x' || substr(md5('0:' || b || ':' || user_id || ':' || k), 1, 8))::BIGINT % n AS start FROM k),
d AS (SELECT b, user_id, (start + off) % n AS i FROM s, (SELECT unnest(range(0, 5)) AS off) WHERE k * 5 + off < n)"""


@query(DRAWS.replace("{n}", "20") + " SELECT b::INT AS b, user_id, i, count(*) AS times FROM d GROUP BY ALL")
def circular_blocks(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return resample.block_indices(n, "user_id", 20, 5).withColumnRenamed("_i", "i")


BOOT = DRAWS.replace("{n}", "200")
SHARES = BOOT + ", c AS (SELECT d.b, event_type, count(*) AS n FROM d JOIN o USING (user_id, i) GROUP BY 1, 2), f AS (SELECT b.b, e.event_type, coalesce(n, 0) AS n FROM b, (SELECT DISTINCT event_type FROM o) e LEFT JOIN c ON c.b = b.b AND c.event_type = e.event_type), p AS (SELECT b, event_type, n / sum(n) OVER (PARTITION BY b) AS population FROM f)"


def shares(t: Tables) -> DataFrame:
    return resample.bootstrap_populations(t.events, "user_id", ORDER, "event_type", 200, 5)


@query(SHARES + " SELECT b::INT AS b, event_type, round(population, 9) AS population FROM p")
def bootstrap_populations(t: Tables) -> DataFrame:
    return shares(t).withColumn("population", r("population", 9))


@query(SHARES + " SELECT event_type, round(stddev_pop(population), 8) AS sd, round(quantile_cont(population, 0.025), 8) AS lo, round(quantile_cont(population, 0.975), 8) AS hi, count(population) / count(*) AS support FROM p GROUP BY 1")
def bootstrap_ci(t: Tables) -> DataFrame:
    return resample.summary(shares(t), ["event_type"], "population").select("event_type", r("sd", 8).alias("sd"), r("lo", 8).alias("lo"), r("hi", 8).alias("hi"), "support")


@query(SHARES + ", d2 AS (SELECT x.event_type, x.population - y.population AS d FROM p x JOIN p y ON y.b = x.b AND y.event_type = 'view' WHERE x.event_type <> 'view') SELECT event_type, least(1.0, greatest(2 * least(count(*) FILTER (d <= 0), count(*) FILTER (d >= 0)) / count(*), 1 / count(*)))::DOUBLE AS p FROM d2 GROUP BY 1")
def bootstrap_pvalue(t: Tables) -> DataFrame:
    p = shares(t)
    d = p.join(p.where("event_type = 'view'").select("b", F.col("population").alias("q")), "b").where("event_type != 'view'")
    d = d.groupBy("event_type").agg(F.collect_list(F.col("population") - F.col("q")).alias("d"))
    return d.select("event_type", resample.two_sided_p(F.col("d"), F.size("d")).alias("p"))


@query("WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, k FROM o WHERE k IN (SELECT floor(i * (n - 1) / 99.0)::BIGINT FROM (SELECT unnest(range(0, 100)) AS i), (SELECT count(*) AS n FROM events))")
def even_subsample(t: Tables) -> DataFrame:
    """One hundred frames evenly over the series."""
    return timeseries.even_subsample(t.events, F.expr(MICROS), ORDER, 100).select("event_id", "k")


@query("SELECT 'Rep' || user_id AS replicate, event_id, value FROM events WHERE user_id < 5 UNION ALL SELECT 'Rep' || user_id, event_id, value FROM events WHERE user_id >= 5")
def union_all_systems(t: Tables) -> DataFrame:
    e = t.events.select(F.concat(F.lit("Rep"), "user_id").alias("replicate"), "event_id", "value", "user_id")
    return e.where("user_id < 5").unionByName(e.where("user_id >= 5")).drop("user_id")


@query("SELECT user_id FROM events WHERE event_type = 'signup' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def union_distinct(t: Tables) -> DataFrame:
    pick = lambda s: t.events.where(F.col("event_type") == s).select("user_id")
    return pick("signup").union(pick("purchase")).distinct()


@query("SELECT user_id, hour(ts) AS h FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id, hour(ts) FROM events WHERE event_type = 'purchase'")
def intersect_keys(t: Tables) -> DataFrame:
    pick = lambda s: t.events.where(F.col("event_type") == s).select("user_id", F.hour("ts").cast("long").alias("h"))
    return pick("signup").intersect(pick("purchase"))


@query("SELECT user_id, hour(ts) AS h FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id, hour(ts) FROM events WHERE event_type = 'purchase'")
def except_keys(t: Tables) -> DataFrame:
    pick = lambda s: t.events.where(F.col("event_type") == s).select("user_id", F.hour("ts").cast("long").alias("h"))
    return pick("signup").subtract(pick("purchase"))


@query("SELECT user_id, event_id, round(energy, 6) + 0.0 AS energy FROM (SELECT user_id, event_id, -0.008314462618 * 300.0 * ln(p / max(p) OVER ()) AS energy FROM (SELECT user_id, event_id, value / sum(value) OVER () AS p FROM events WHERE value > 0))")
def relative_energies(t: Tables) -> DataFrame:
    e = t.events.where("value > 0")
    top = e.agg(F.max("value").alias("top"))
    rows = e.crossJoin(F.broadcast(top))
    return rows.select("user_id", "event_id", (r(C.free_energy(F.col("value"), F.col("top"))) + 0.0).alias("energy"))


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM o WHERE k >= CASE WHEN user_id % 2 = 0 THEN user_id % 5 ELSE 0 END GROUP BY 1")
def transient_discard(t: Tables) -> DataFrame:
    """Frames after each replicate's transient; odd users have none."""
    starts = t.events.where("user_id % 2 = 0").select("user_id", (F.col("user_id") % 5).alias("t0")).distinct()
    return timeseries.production(t.events, starts, "user_id", ORDER).groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("SELECT user_id, greatest(1, floor((floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 + 1e-9) + 1) / 3))::BIGINT AS frames FROM events GROUP BY 1")
def frames_in_window(t: Tables) -> DataFrame:
    """Frames an hour apart that each user's span would hold, every third one."""
    e = t.events.withColumn("us", F.expr(MICROS))
    return e.groupBy("user_id").agg(C.frames_in_window(F.min("us"), F.max("us"), F.lit(3.6e9), 3).alias("frames"))


@query("SELECT s.event_type, coalesce(any_value(m.label), 'inactive') AS label, count(*) AS n FROM events s LEFT JOIN (SELECT 'view' AS event_type, 'MS1' AS label UNION ALL SELECT 'click', 'MS2') m USING (event_type) GROUP BY 1")
def inactive_states(t: Tables) -> DataFrame:
    """Left lookup of set names; microstates outside all sets are inactive."""
    sets = t.spark.createDataFrame([("view", "MS1"), ("click", "MS2")], "event_type string, label string")
    return t.events.join(F.broadcast(sets), "event_type", "left").groupBy("event_type").agg(F.coalesce(F.first("label"), F.lit("inactive")).alias("label"), F.count("*").alias("n"))


@query(BOOT + f""", v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(19, floor(value / 25))::INT AS bin FROM events WHERE value BETWEEN 0 AND 500),
n2 AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), k2 AS (SELECT b, user_id, n, unnest(range(0, ((n + 4) // 5)::BIGINT)) AS k FROM n2, b), s2 AS (SELECT *, ('0x' || substr(md5('0:' || b || ':' || user_id || ':' || k), 1, 8))::BIGINT % n AS start FROM k2),
d2 AS (SELECT b, user_id, (start + off) % n AS i FROM s2, (SELECT unnest(range(0, 5)) AS off) WHERE k * 5 + off < n), c2 AS (SELECT d2.b, bin, count(*) AS t FROM d2 JOIN v USING (user_id, i) GROUP BY 1, 2), g2 AS (SELECT b, bin, -0.008314462618 * 300.0 * ln(t / max(t) OVER (PARTITION BY b)) AS g FROM c2)
SELECT bin, round(stddev_pop(g), 6) AS sd, round(quantile_cont(g, 0.025), 6) + 0.0 AS lo, round(quantile_cont(g, 0.975), 6) + 0.0 AS hi, round(count(*) / 200, 6) AS support FROM g2 GROUP BY 1""")
def profile_bands(t: Tables) -> DataFrame:
    """Bootstrap bands of the one-dimensional profile of a value."""
    b = resample.profile_bands(t.events, "user_id", ORDER, "value", 20, (0.0, 500.0), 200, 5)
    return b.select("bin", r("sd").alias("sd"), (r("lo") + 0.0).alias("lo"), (r("hi") + 0.0).alias("hi"), r("support").alias("support"))


@query("""WITH o AS (SELECT user_id % 2 AS sys, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT sys, user_id, count(*) AS n FROM o GROUP BY 1, 2), b AS (SELECT unnest(range(0, 50)) AS b),
k AS (SELECT b, sys, user_id, n, unnest(range(0, ((n + 3) // 4)::BIGINT)) AS k FROM n, b), s AS (SELECT *, ('0x' || substr(md5('0:' || b || ':' || sys || '/' || user_id || ':' || k), 1, 8))::BIGINT % n AS start FROM k),
d AS (SELECT b, user_id, (start + off) % n AS i FROM s, (SELECT unnest(range(0, 4)) AS off) WHERE k * 4 + off < n), c AS (SELECT sys, d.b, event_type, count(*) AS t FROM d JOIN o USING (user_id, i) GROUP BY 1, 2, 3), p AS (SELECT sys, b, event_type, t / sum(t) OVER (PARTITION BY sys, b) AS population FROM c)
SELECT sys AS system, event_type, round(avg(population), 8) AS mean, round(stddev_pop(population), 8) AS sd FROM p GROUP BY 1, 2""")
def bootstrap_by_system(t: Tables) -> DataFrame:
    """Resampled populations of two systems, each drawn from its own replicates."""
    e = t.events.withColumn("system", F.col("user_id") % 2)
    p = resample.bootstrap_systems(e, "system", "user_id", ORDER, "event_type", 50, 4)
    return p.groupBy("system", "event_type").agg(r(F.avg("population"), 8).alias("mean"), r(F.stddev_pop("population"), 8).alias("sd"))


@query("WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20') SELECT event_id, user_id, k FROM w WHERE k % 3 = 0")
def window_then_stride(t: Tables) -> DataFrame:
    """The window first, then every third of its frames."""
    w = t.events.where("ts >= timestamp_ntz'2024-01-03 00:00:00' and ts <= timestamp_ntz'2024-01-20 00:00:00'")
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long")
    return w.withColumn("k", k).where("k % 3 = 0").select("event_id", "user_id", "k")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, arg_min(event_type, (ts, event_id)) AS first_event_type, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY 1")
def first_and_last(t: Tables) -> DataFrame:
    return joins.ends(t.events, ["user_id"], "ts", ["event_id"], ["value", "event_type"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50.0), ts, event_id) AS n FROM events) WHERE n = 1")
def frame_for_time(t: Tables) -> DataFrame:
    """The event of each user whose value, as a time, is nearest to 50."""
    return joins.at_time(t.events, ["user_id"], "value", ORDER, 50.0).select("user_id", "event_id", "value")


@query("""WITH s AS (SELECT event_type AS state, count(*) AS frames FROM events GROUP BY 1), c AS (SELECT event_type AS state, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS sem FROM (SELECT user_id, event_type, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS x FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1)
SELECT state, frames, round(mean, 6) AS mean, round(sem, 6) AS sem FROM s LEFT JOIN c USING (state)""")
def state_intervals_join(t: Tables) -> DataFrame:
    """States with the statistics of those that have any."""
    s = t.events.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("frames"))
    n = t.events.where("event_type != 'error'").groupBy("user_id", F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    x = n.withColumn("x", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    c = x.groupBy("state").agg(r(F.avg("x")).alias("mean"), r(F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("sem"))
    return residues.with_lookup(s, c, "state", ["mean", "sem"])


@query(G + """, b AS (SELECT user_id, n, greatest(3, least(10, floor(n / greatest(1, ceil(10 * round(g, 5))))))::INT AS blocks FROM g), e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
x AS (SELECT o.user_id, blocks, event_type, least(k // greatest(1, n // blocks), blocks - 1) AS block FROM e AS o JOIN b USING (user_id)), y AS (SELECT user_id, block, 100.0 * count(*) FILTER (event_type = 'view') / count(*) AS x FROM x GROUP BY 1, 2)
SELECT user_id, count(*) AS n_blocks, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS block_sd FROM y GROUP BY 1""")
def block_statistics_from_g(t: Tables) -> DataFrame:
    """Block statistics with as many blocks as the correlation of the series allows."""
    g = timeseries.effective_samples(t.events, "user_id", ORDER, "value")
    blocks = g.select("user_id", timeseries.blocks_of(r("g", 5), F.col("n")).alias("blocks"))
    s = timeseries.in_own_blocks(t.events, "user_id", ORDER, blocks).groupBy("user_id", "block").agg((100.0 * F.count(F.when(F.col("event_type") == "view", 1)) / F.count("*")).alias("x"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_blocks"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("block_sd"))


@query("""WITH o AS (SELECT user_id % 3 AS sys, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT sys, user_id, count(*) AS n FROM o GROUP BY 1, 2), b AS (SELECT unnest(range(0, 100)) AS b),
k AS (SELECT b, sys, user_id, n, unnest(range(0, ((n + 4) // 5)::BIGINT)) AS k FROM n, b), s AS (SELECT *, ('0x' || substr(md5('0:' || b || ':' || sys || '/' || user_id || ':' || k), 1, 8))::BIGINT % n AS start FROM k),
d AS (SELECT b, user_id, (start + off) % n AS i FROM s, (SELECT unnest(range(0, 5)) AS off) WHERE k * 5 + off < n), c AS (SELECT sys, d.b, event_type, count(*) AS t FROM d JOIN o USING (user_id, i) GROUP BY 1, 2, 3), p AS (SELECT sys, b, event_type, t / sum(t) OVER (PARTITION BY sys, b) AS q FROM c),
e AS (SELECT x.sys, x.event_type, x.q - y.q AS d FROM p x JOIN p y ON y.b = x.b AND y.event_type = x.event_type AND y.sys = 0 WHERE x.sys <> 0)
SELECT sys AS system, event_type, round(quantile_cont(d, 0.025), 8) AS lo, round(quantile_cont(d, 0.975), 8) AS hi, least(1.0, greatest(2 * least(count(*) FILTER (d <= 0), count(*) FILTER (d >= 0)) / count(*), 1 / count(*)))::DOUBLE AS p FROM e GROUP BY 1, 2""")
def population_difference_intervals(t: Tables) -> DataFrame:
    """Population differences between systems with bootstrap intervals and p values."""
    e = t.events.withColumn("system", F.col("user_id") % 3)
    p = resample.bootstrap_systems(e, "system", "user_id", ORDER, "event_type", 100, 5)
    d = compare.differences_by_bootstrap(p, "system", "event_type", 0)
    return d.select("system", "event_type", r("lo", 8).alias("lo"), r("hi", 8).alias("hi"), "p")


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT event_type, n / sum(n) OVER () AS p FROM n), t AS (SELECT arg_max(event_type, (p, event_type)) AS top, max(p) AS share, count(*) FILTER (p >= 0.05) AS k FROM p), m AS (SELECT max(value) / 1000 AS a, min(value) AS b FROM events)
SELECT format('{} major states; {} holds {:.1f} % of the frames. Overlap between halves is {} and cosine content is {}.', k, top, 100 * share, CASE WHEN a >= 0.7 THEN 'high' WHEN a >= 0.5 THEN 'moderate' ELSE 'low' END, CASE WHEN b >= 0.7 THEN 'high' WHEN b >= 0.5 THEN 'moderate' ELSE 'low' END) AS text FROM t, m""")
def interpretation(t: Tables) -> DataFrame:
    """A landscape in words; values stand for overlap and cosine content."""
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    top = p.agg(F.max(F.struct("p", "event_type")).alias("m"), F.count(F.when(F.col("p") >= 0.05, 1)).alias("k"))
    m = t.events.agg((F.max("value") / 1000).alias("a"), F.min("value").alias("b"))
    return top.crossJoin(m).select(C.sentence(F.col("k"), F.col("m.event_type"), F.col("m.p"), F.col("a"), F.col("b")).alias("text"))


#: Survival of chains that have not reached their target, step by step: mean first passage times as sums of a geometric series.
PASSAGE = f"""WITH RECURSIVE {STEPS}, n AS (SELECT source, target, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS q FROM n),
s(k, i, j, s) AS (SELECT 0, a.st, b.st, 1.0::DOUBLE FROM l a, l b WHERE a.st <> b.st UNION ALL SELECT any_value(s.k) + 1, q.source, s.j, sum(q.q * s.s) FROM s JOIN q ON q.target = s.i WHERE s.k < 400 AND q.source <> s.j GROUP BY q.source, s.j)
SELECT i AS source, j AS target, round(10.0 * sum(s), 4) AS mfpt FROM s GROUP BY 1, 2"""


@query(PASSAGE)
def first_passage_times(t: Tables) -> DataFrame:
    """Mean first passage times between different states."""
    m = QUERIES["mean_first_passage"](t.spark, t.folder)
    return m.where("source != target").select("source", "target", r("mfpt", 4).alias("mfpt"))


#: One window's energies of every event, and its self-consistent free energies after thirty steps.
SELF_CONSISTENT = """WITH RECURSIVE s AS (SELECT value AS x, user_id % 3 AS k FROM events), n AS (SELECT count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2 FROM s),
u AS (SELECT 0.004 * (x - 10) * (x - 10) AS u0, 0.004 * (x - 30) * (x - 30) AS u1, 0.004 * (x - 60) * (x - 60) AS u2 FROM s),
f(k, f0, f1, f2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, 0.0, g1 - g0, g2 - g0 FROM (SELECT any_value(k) AS k, -ln(sum(exp(-u0 - d))) AS g0, -ln(sum(exp(-u1 - d))) AS g1, -ln(sum(exp(-u2 - d))) AS g2 FROM (SELECT *, top + ln(exp(a - top) + exp(b - top) + exp(c - top)) AS d FROM (SELECT *, greatest(a, b, c) AS top FROM (SELECT f.k, u0, u1, u2, ln(n0) + f0 - u0 AS a, ln(n1) + f1 - u1 AS b, ln(n2) + f2 - u2 AS c FROM f, u, n WHERE f.k < 30)))) WHERE k IS NOT NULL)
SELECT unnest([0, 1, 2])::INT AS k, unnest([0.0, round(f1, 6), round(f2, 6)])::DOUBLE AS f FROM f WHERE k = 30"""


@query(SELF_CONSISTENT)
def mbar_after_thirty_steps(t: Tables) -> DataFrame:
    """Free energies of three windows over all events after thirty self-consistent steps."""
    from terrane.operators import reweight

    s = t.events.select(F.col("value").alias("x"), (F.col("user_id") % 3).alias("k"))
    n = {x["k"]: x["count"] for x in s.groupBy("k").count().collect()}  # three windows
    energies = reweight.umbrella_energies(s, "x", [10.0, 30.0, 60.0], [0.02] * 3, 2.5).persist()  # read once a step
    f = reweight.mbar(energies, [n.get(k, 0) for k in range(3)], steps=30, tolerance=0.0, newton=False)
    energies.unpersist()
    return t.spark.createDataFrame([(k, round(float(x), 6) + 0.0) for k, x in enumerate(f)], "k int, f double")


#: Row sums of the reversible estimate by its fixed point, two hundred steps from even ones.
REVERSIBLE = _counts("1, 2, 5").replace("WITH n AS", "WITH RECURSIVE n AS", 1).replace("SELECT lag::INT AS lag, i, j, count(*) AS c FROM c GROUP BY ALL", """, m AS (SELECT lag, i, j, count(*)::DOUBLE AS c FROM c GROUP BY ALL), b AS (SELECT a.lag, a.i, a.j, a.c + z.c AS c FROM m a JOIN m z ON z.lag = a.lag AND z.i = a.j AND z.j = a.i),
t AS (SELECT lag, i, sum(c) AS t FROM m GROUP BY 1, 2), s(k, lag, i, x) AS (SELECT 0, lag, i, 0.25::DOUBLE FROM t UNION ALL SELECT k + 1, lag, i, x / sum(x) OVER (PARTITION BY lag) FROM (SELECT any_value(p.k) AS k, b.lag, b.i, sum(b.c / (u.t / p.x + v.t / q.x)) AS x FROM b JOIN s p ON p.lag = b.lag AND p.i = b.i JOIN s q ON q.lag = b.lag AND q.i = b.j JOIN t u ON u.lag = b.lag AND u.i = b.i JOIN t v ON v.lag = b.lag AND v.i = b.j WHERE p.k < 200 GROUP BY b.lag, b.i))
SELECT lag::INT AS lag, i::INT AS state, round(x, 7) AS stationary FROM s WHERE k = 200""").replace("t AS (SELECT unnest([1, 2, 5]) AS lag)", "lags AS (SELECT unnest([1, 2, 5]) AS lag)").replace("FROM n a, t, n b", "FROM n a, lags, n b")


@query(REVERSIBLE)
def reversible_stationary(t: Tables) -> DataFrame:
    """Stationary distributions of reversible estimates at several lags."""
    e = QUERIES["msm_estimate"](t.spark, t.folder)
    return e.select("lag", "state", r("stationary", 7).alias("stationary"))

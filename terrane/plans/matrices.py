"""Vector work over embeddings (64 numbers, labels as replicates) and atom-like work over suppliers and customers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.columns import dot, sentence
from terrane.operators import decompose, msm, overlaps, residues, timeseries, wide
from terrane.plans.registry import Tables, query, r

LONG = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.where("embedding is not null")


def long(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


#: Covariances of all numbers, frames weighing equally.
COVARIANCE = f"l AS ({LONG}), c AS (SELECT a.d AS i, b.d AS j, covar_pop(a.x, b.x) AS c FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2)"


#: As atoms of three numbers: 64 numbers and two zeros are 22 atoms.
PADDED = f"{LONG} UNION ALL SELECT vec_id, label, 0.0::DOUBLE, unnest([64, 65]) FROM embeddings WHERE embedding IS NOT NULL"


def padded(t: Tables, name: str = "v") -> DataFrame:
    return vectors(t).withColumn(name, F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0), F.lit(0.0))))


def pooled_covariance(t: Tables) -> np.ndarray:
    v = vectors(t).select(F.lit(0).alias("one"), "embedding")
    return decompose.covariance(decompose.collected(decompose.moments(v, "embedding", "one"), "one"))[1]


@query(f"WITH {COVARIANCE} SELECT i, j, round(c, 8) AS c FROM c WHERE i <= j")
def covariance_long(t: Tables) -> DataFrame:
    """Covariances of all numbers with equal weight for each frame, from merged moments."""
    v = vectors(t).select(F.lit(0).alias("one"), "embedding")
    return decompose.entries(decompose.moments(v, "embedding", "one"), "one").where("i <= j").select("i", "j", r("c", 8).alias("c"))


@query(f"WITH l AS ({LONG}) SELECT d, round(avg(x), 8) AS mean, round(var_pop(x) * count(*), 6) AS m2, count(*) AS n FROM l GROUP BY 1")
def moments_merge(t: Tables) -> DataFrame:
    """Moments merged over partitions and replicates: the diagonal of M2."""
    states = decompose.collected(decompose.moments(vectors(t), "embedding", "label"), "label")
    total = None
    for m in states.values():
        total = m if total is None else decompose.merged(total, m)
    rows = [(k, round(float(total[1][k]), 8), round(float(total[2][k, k]), 6), int(total[0])) for k in range(len(total[1]))]
    return t.spark.createDataFrame(rows, "d long, mean double, m2 double, n long")


@query(f"WITH l AS ({LONG}), m AS (SELECT label, d, avg(x) AS x FROM l GROUP BY 1, 2) SELECT d, round(avg(x), 8) AS mean FROM m GROUP BY 1")
def replicate_weighted_mean(t: Tables) -> DataFrame:
    m = long(t).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return m.groupBy(F.col("d").cast("long").alias("d")).agg(r(F.avg("x"), 8).alias("mean"))


@query(f"WITH {COVARIANCE}, s AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON b.i = a.j GROUP BY 1, 2), m AS (SELECT sum(c) FILTER (i = j) AS p1, sum(c * c) AS p2 FROM c), q AS (SELECT sum(s.c * c.c) AS p3 FROM s JOIN c ON c.i = s.j AND c.j = s.i) SELECT round(p1, 8) AS total, round(p2, 8) AS squares, round(p3, 8) AS cubes FROM m, q")
def explained_variance(t: Tables) -> DataFrame:
    """Sums of the first three powers of all eigenvalues; in SQL, traces of powers of the covariance matrix."""
    v = vectors(t).select(F.lit(0).alias("one"), "embedding")
    e = decompose.pca(v, "embedding", "one", 64)["eigenvalues"]
    return t.spark.createDataFrame([tuple(round(float((e**k).sum()), 8) for k in (1, 2, 3))], "total double, squares double, cubes double")


@query(f"WITH {COVARIANCE} SELECT round(sum(c) FILTER (i = j), 8) AS total, round(sum(c * c), 8) AS squares, count(DISTINCT i) AS modes, true AS settled FROM c")
def wide_spectrum(t: Tables) -> DataFrame:
    """Modes without a covariance matrix: trace and squares of all eigenvalues of a range finder, which SQL takes from the matrix."""
    p = wide.pca(vectors(t), "embedding", k=64, block=16)
    e = p["eigenvalues"]
    return t.spark.createDataFrame([(round(float(e.sum()), 8), round(float((e**2).sum()), 8), len(e), bool(p["residual"] < 1e-8 * e[0]))], "total double, squares double, modes long, settled boolean")


@query()
def pca_modes(t: Tables) -> DataFrame:
    """Ten modes of all dimensions with equal weight for each replicate."""
    p = decompose.pca(vectors(t), "embedding", "label", 10)
    rows = [(k + 1, float(p["eigenvalues"][k]), float(p["explained"][k]), float(p["cumulative"][k]), p["vectors"][:, k].tolist()) for k in range(len(p["eigenvalues"]))]
    return t.spark.createDataFrame(rows, "mode int, eigenvalue double, explained double, cumulative double, vector array<double>")


@query()
def mode_overlaps(t: Tables) -> DataFrame:
    """Overlaps of the modes of halves, of leading parts with all frames, and of replicates, labels being replicates; and their sampling verdict."""
    found = overlaps.convergence(vectors(t), "embedding", "label", ["vec_id"], 10)
    rows = [("halves", None if k == 0 else float(a), None, float(x)) for k, (a, x) in enumerate(found["halves"])]
    rows += [("leading", float(f), None, float(x)) for f, x in found["progressive"]] + [("pair", float(a), float(b), float(x)) for a, b, x in found["pairs"]]
    return t.spark.createDataFrame(rows, "kind string, a double, b double, rmsip double")


#: Sums of the even and the odd numbers of a vector, in order within labels; a half's leading axis of two numbers has a closed form.
TWO = f"""l AS ({LONG}), e AS (SELECT vec_id, label, sum(x) FILTER (d % 2 = 0) AS x, sum(x) FILTER (d % 2 = 1) AS y FROM l GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, x - avg(x) OVER (PARTITION BY label) AS p FROM e),
h AS (SELECT label, k >= n // 2 AS late, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle FROM o WHERE n >= 4 GROUP BY 1, 2),
s AS (SELECT label, abs(cos(max(angle) FILTER (late) - max(angle) FILTER (NOT late))) AS rmsip FROM h GROUP BY 1),
w AS (SELECT label, any_value(n) AS n, CASE WHEN any_value(n) < 3 THEN 0 ELSE 2.0 / any_value(n) * power(sum(p * cos(pi() * k / (n - 1))), 2) / sum(p * p) END AS cosine, var_pop(x) AS v FROM o GROUP BY 1),
c AS (SELECT a.label, b.k - a.k AS lag, sum(a.p * b.p) / ((any_value(a.n) - (b.k - a.k)) * any_value(w.v)) AS c FROM o a JOIN o b ON b.label = a.label AND b.k > a.k AND b.k - a.k <= a.n - 2 JOIN w ON w.label = a.label GROUP BY 1, 2),
z AS (SELECT label, min(lag) AS stop FROM c WHERE c <= 0 AND lag > 3 GROUP BY 1),
g AS (SELECT w.label, w.n, w.cosine, CASE WHEN w.n < 4 THEN 1 ELSE greatest(1, 1 + 2 * coalesce((SELECT sum(c.c * (1 - c.lag / w.n)) FROM c LEFT JOIN z ON z.label = c.label WHERE c.label = w.label AND c.lag < coalesce(z.stop, w.n - 1)), 0)) END AS g FROM w)"""


@query(f"""WITH {TWO} SELECT g.label, round(s.rmsip, 6) AS rmsip, round(g.cosine, 6) AS cosine_content, round(g.n / g.g, 3) AS n_eff,
CASE WHEN g.n / g.g < 50 THEN 'Insufficient' WHEN coalesce(s.rmsip, 0) >= 0.7 AND g.cosine < 0.5 THEN 'Good' WHEN coalesce(s.rmsip, 0) >= 0.5 AND g.cosine < 0.7 THEN 'Mixed' ELSE 'Poor' END AS verdict FROM g LEFT JOIN s USING (label)""")
def sampling_by_label(t: Tables) -> DataFrame:
    """How well each label samples two collective numbers: overlap of the leading modes of its halves, cosine content and effective samples, and the verdict that they give."""
    two = two_numbers(t)
    both = sampled(two).join(timeseries.effective_samples(two, "label", ["vec_id"], "x").drop("n"), "label")
    verdict = timeseries.verdict(F.coalesce("rmsip", F.lit(0.0)), F.col("cosine_content"), F.col("n_eff"))
    return both.select("label", r("rmsip", 6).alias("rmsip"), r("cosine_content", 6).alias("cosine_content"), r("n_eff", 3).alias("n_eff"), verdict.alias("verdict"))


@query(f"""WITH {TWO}, q AS (SELECT label, CASE WHEN x < 0 THEN 'low' ELSE 'high' END || '-' || CASE WHEN y < 0 THEN 'low' ELSE 'high' END AS state, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM q),
m AS (SELECT label, arg_max(state, (p, state)) AS top, max(p) AS share, count(*) FILTER (p >= 0.05) AS k FROM p GROUP BY 1)
SELECT label, format('{{}} major states; {{}} holds {{:.1f}} % of the frames. Overlap between halves is {{}} and cosine content is {{}}.', k, top, 100 * share, CASE WHEN coalesce(rmsip, 0) >= 0.7 THEN 'high' WHEN coalesce(rmsip, 0) >= 0.5 THEN 'moderate' ELSE 'low' END, CASE WHEN cosine >= 0.7 THEN 'high' WHEN cosine >= 0.5 THEN 'moderate' ELSE 'low' END) AS text
FROM m JOIN g USING (label) LEFT JOIN s USING (label)""")
def interpretation_by_label(t: Tables) -> DataFrame:
    """Each label's states, the quadrants of two collective numbers, in words, with the overlap of its halves and its cosine content."""
    two = two_numbers(t)
    side = lambda c: F.when(F.col(c) < 0, "low").otherwise("high")
    n = two.groupBy("label", F.concat_ws("-", side("x"), side("y")).alias("state")).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    top = p.groupBy("label").agg(F.max(F.struct("p", "state")).alias("m"), F.count(F.when(F.col("p") >= 0.05, 1)).alias("k")).join(sampled(two), "label")
    return top.select("label", sentence(F.col("k"), F.col("m.state"), F.col("m.p"), F.coalesce("rmsip", F.lit(0.0)), F.col("cosine_content")).alias("text"))


def two_numbers(t: Tables) -> DataFrame:
    """Sums of the even and of the odd numbers of each vector, x and y, and both as a vector v."""
    number = lambda odd: F.expr(f"aggregate(filter(transform(embedding, (v, i) -> CASE WHEN i % 2 = {odd} THEN CAST(v AS DOUBLE) END), v -> v IS NOT NULL), 0D, (a, v) -> a + v)")
    return vectors(t).select("vec_id", "label", number(0).alias("x"), number(1).alias("y")).withColumn("v", F.array("x", "y"))


def sampled(two: DataFrame) -> DataFrame:
    """(label, rmsip of its halves' leading modes, cosine_content); labels are few."""
    halves = overlaps.convergence(two, "v", "label", ["vec_id"], 1)["halves"][1:]
    found = two.sparkSession.createDataFrame([(int(k), float(v)) for k, v in halves], "label int, rmsip double")
    return timeseries.cosine_content(two, ["vec_id"], "x", 1, by=["label"]).drop("n").join(found, "label", "left")


@query()
def tica_modes(t: Tables) -> DataFrame:
    """Slow modes at a lag of five frames."""
    p = decompose.tica(vectors(t), "embedding", "label", ["vec_id"], 5, 4)
    return t.spark.createDataFrame([(k + 1, float(p["eigenvalues"][k]), float(p["timescales"][k])) for k in range(len(p["eigenvalues"]))], "mode int, eigenvalue double, timescale double")


@query(f"WITH l AS ({LONG}), v AS (SELECT d + 1 AS mode, var_pop(x) AS e FROM l GROUP BY 1) SELECT mode, round(e, 9) AS variance, round(100 * sum(e) OVER (ORDER BY mode) / sum(e) OVER (), 6) AS cumulative FROM v")
def cumulative_variance(t: Tables) -> DataFrame:
    v = long(t).groupBy((F.col("d") + 1).cast("long").alias("mode")).agg(F.var_pop("x").alias("e"))
    run = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)
    return v.select("mode", r("e", 9).alias("variance"), r(100 * F.sum("e").over(run) / F.sum("e").over(Window.partitionBy())).alias("cumulative"))


AXES = "((d * 7 + k * 13) % 11 - 5) / 10.0"


@query(f"WITH l AS ({LONG}), a AS (SELECT unnest(range(0, 3)) AS k), m AS (SELECT d, avg(x) AS m FROM l GROUP BY 1), p AS (SELECT vec_id, k, sum((x - m) * {AXES}) AS p FROM l JOIN m USING (d), a GROUP BY 1, 2) SELECT vec_id, round(max(p) FILTER (k = 0), 6) AS PC1, round(max(p) FILTER (k = 1), 6) AS PC2, round(max(p) FILTER (k = 2), 6) AS PC3 FROM p GROUP BY 1")
def project_fixed_axes(t: Tables) -> DataFrame:
    """(x - mean) . v for three fixed axes, as plain expressions."""
    means = [x["m"] for x in long(t).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()]  # one number a dimension
    axes = np.array([[((d * 7 + k * 13) % 11 - 5) / 10.0 for k in range(3)] for d in range(len(means))])
    p = decompose.projected(vectors(t), "embedding", np.array(means), axes)
    return p.select("vec_id", *(r(f"PC{k}").alias(f"PC{k}") for k in (1, 2, 3)))


@query(f"WITH l AS ({LONG}), o AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM l) SELECT a.d AS i, b.d AS j, round(avg(a.x * b.x), 8) AS c, count(*) AS n FROM o a JOIN o b ON b.label = a.label AND b.n = a.n + 5 GROUP BY 1, 2")
def lagged_covariance(t: Tables) -> DataFrame:
    """Mean products of all numbers at a lag of five frames within replicates."""
    n, c = decompose.lagged_moments(vectors(t), "embedding", "label", ["vec_id"], 5)
    return decompose.long_table(t.spark, {0: c}).select("i", "j", r("value", 8).alias("c"), F.lit(n).cast("long").alias("n"))


@query(f"""WITH l AS ({LONG}), m AS (SELECT label, d, avg(x) AS m FROM l GROUP BY 1, 2), g AS (SELECT d, avg(m) AS g FROM m GROUP BY 1), u AS (SELECT label, d, m - g AS u FROM m JOIN g USING (d)), n AS (SELECT label, sqrt(sum(u * u)) AS n FROM u GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sum(a.u * b.u) / any_value(x.n * y.n) AS p FROM u a JOIN u b ON b.d = a.d AND b.label > a.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2) SELECT a, b, round(abs(p), 6) AS rmsip FROM p""")
def rmsip_fixed(t: Tables) -> DataFrame:
    """Overlap of the one-dimensional subspaces that two replicates' mean displacements span."""
    means = {k: m[1] for k, m in decompose.collected(decompose.moments(vectors(t), "embedding", "label"), "label").items()}
    center = np.mean(list(means.values()), axis=0)
    axes = {k: ((m - center) / np.linalg.norm(m - center))[:, None] for k, m in sorted(means.items())}
    return t.spark.createDataFrame([(a, b, round(decompose.rmsip(axes[a], axes[b]), 6)) for a in axes for b in axes if a < b], "a long, b long, rmsip double")


#: Atoms of these queries are three numbers each, and residues four atoms.
MODES = f"WITH l AS ({PADDED}), v AS (SELECT d // 3 AS atom, var_pop(x) AS e FROM l GROUP BY d, d // 3)"


def mode_table(t: Tables, group: list[int] | None = None) -> DataFrame:
    """(item, moved): contributions to all modes, each weighed by its eigenvalue."""
    p = decompose.pca(padded(t).select(F.lit(0).alias("one"), "v"), "v", "one", 66)
    moved = np.sqrt((decompose.mode_contributions(p["vectors"], 3, group) ** 2 * p["eigenvalues"]).sum(1))
    return t.spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(moved)], "item long, moved double")


@query(MODES + " SELECT atom AS item, round(sqrt(sum(e)), 6) AS moved FROM v GROUP BY 1")
def mode_contributions(t: Tables) -> DataFrame:
    """Each atom's motion, put together from its contributions to all modes; in SQL, its variance."""
    return mode_table(t)


@query(MODES + " SELECT atom // 4 AS item, round(sqrt(sum(e)), 6) AS moved FROM v GROUP BY 1")
def residue_mode_contributions(t: Tables) -> DataFrame:
    return mode_table(t, [k // 4 for k in range(22)])


@query(f"WITH l AS ({LONG}) SELECT a.d AS i, b.d AS j, round(covar_pop(a.x, b.x) / sqrt(var_pop(a.x) * var_pop(b.x)), 7) AS c FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2")
def dccm_small(t: Tables) -> DataFrame:
    """Correlations of all numbers, as items of one number."""
    c = decompose.cross_correlations(vectors(t), "embedding", axes=1)[None]
    return decompose.long_table(t.spark, {0: c}).select("i", "j", r("value", 7).alias("c"))


#: Correlated motion of atoms by state: even and odd labels are the states.
DCCM = f"""WITH l AS (SELECT vec_id, label % 2 AS st, d // 3 AS atom, d % 3 AS axis, x FROM ({PADDED})), c AS (SELECT a.st, a.atom AS i, b.atom AS j, a.axis, covar_pop(a.x, b.x) AS c FROM l a JOIN l b ON b.vec_id = a.vec_id AND b.axis = a.axis GROUP BY 1, 2, 3, 4),
t AS (SELECT st, i, j, sum(c) AS c FROM c GROUP BY 1, 2, 3), d AS (SELECT st, i, c FROM t WHERE i = j), n AS (SELECT t.st, t.i, t.j, t.c / sqrt(x.c * y.c) AS c FROM t JOIN d x ON x.st = t.st AND x.i = t.i JOIN d y ON y.st = t.st AND y.i = t.j)"""


def state_matrices(t: Tables) -> dict[int, np.ndarray]:
    v = padded(t).select((F.col("label") % 2).alias("st"), "v")
    return decompose.cross_correlations(v, "v", "st")


@query(DCCM + " SELECT st AS state, i, j, round(c, 7) AS c FROM n")
def dccm_per_state(t: Tables) -> DataFrame:
    return decompose.long_table(t.spark, {int(k): m for k, m in state_matrices(t).items()}, "state").withColumn("value", r("value", 7)).withColumnRenamed("value", "c")


@query(DCCM + " SELECT st AS state, i // 4 AS i, j // 4 AS j, round(avg(c), 7) AS c FROM n GROUP BY ALL")
def dccm_residues(t: Tables) -> DataFrame:
    """The same, as means over the atoms of every two residues."""
    group = [k // 4 for k in range(22)]
    matrices = {int(k): decompose.collapsed(m, group) for k, m in state_matrices(t).items()}
    return decompose.long_table(t.spark, matrices, "state").withColumn("value", r("value", 7)).withColumnRenamed("value", "c")


@query(DCCM.replace("d // 3 AS atom, d % 3 AS axis, x FROM", "d // 3 AS atom, d % 3 AS axis, x, 1.0 + vec_id % 3 AS w FROM").replace("covar_pop(a.x, b.x) AS c", "sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * sum(a.w * b.x) / sum(a.w) AS c").replace("label % 2 AS st", "0 AS st") + " SELECT i, j, round(c, 7) AS c FROM n")
def dccm_weighted(t: Tables) -> DataFrame:
    v = padded(t).select((1.0 + F.col("vec_id") % 3).alias("w"), "v")
    return decompose.long_table(t.spark, {0: decompose.cross_correlations(v, "v", weight="w")[None]}).select("i", "j", r("value", 7).alias("c"))


#: Seven centres in all 64 numbers, by a rule that SQL has too.
CENTERS = [[(k - 3) * ((7 * d) % 11 - 5) / 100 for d in range(64)] for k in range(7)]
CENTER_SQL = f"WITH l AS ({LONG}), c AS (SELECT unnest(range(0, 7))::INT AS k), d AS (SELECT vec_id, k, sum(power(x - (k - 3) * ((7 * d) % 11 - 5) / 100.0, 2)) AS d FROM l, c GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), k) AS n FROM d)"
COORDINATES = [f"x{d:02d}" for d in range(64)]


def points(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(COORDINATES)))


@query(CENTER_SQL + " SELECT vec_id, k AS microstate FROM n WHERE n = 1")
def nearest_center(t: Tables) -> DataFrame:
    return msm.nearest_center(points(t), F.array(*COORDINATES), CENTERS).select("vec_id", "microstate")


@query(CENTER_SQL + " SELECT k AS microstate, l.d, count(*) AS n, round(avg(x), 7) AS center FROM n JOIN l USING (vec_id) WHERE n.n = 1 GROUP BY ALL")
def kmeans_step(t: Tables) -> DataFrame:
    """New centres after one step, a row for each number."""
    s = msm.lloyd(points(t), COORDINATES, CENTERS)
    long_ = s.select("microstate", "n", F.posexplode(F.array(*COORDINATES)).alias("d", "center"))
    return long_.select("microstate", F.col("d").cast("long").alias("d"), "n", r("center", 7).alias("center"))


@query(f"WITH l AS ({LONG}), p AS (SELECT l.vec_id, sqrt(avg(power(l.x - f.x, 2)) * 3) AS v FROM l JOIN l f ON f.vec_id = 0 AND f.d = l.d GROUP BY 1) SELECT vec_id, round(v, 6) AS rmsd FROM p")
def rmsd_series(t: Tables) -> DataFrame:
    """Deviation of each vector, as atoms of three numbers, from the first."""
    ref = long(t).where("vec_id = 0").select("d", "x")
    out = residues.deviations(long(t), ref, ["d"], ["vec_id"], ["x"])
    return out.select("vec_id", r(F.col("rmsd") * F.sqrt(F.lit(3.0))).alias("rmsd"))


ATOMS = "WITH a AS (SELECT vec_id, label, d // 3 AS atom, max(x) FILTER (d % 3 = 0) AS x, max(x) FILTER (d % 3 = 1) AS y, max(x) FILTER (d % 3 = 2) AS z FROM (" + PADDED + ") GROUP BY ALL)"


def atoms(t: Tables) -> DataFrame:
    return residues.long_form(padded(t, "c"), ["vec_id", "label"], "c").withColumn("mass", 12.0 + F.col("atom") % 3).withColumn("atom", F.col("atom").cast("long"))


@query(ATOMS + ", m AS (SELECT *, 12.0 + atom % 3 AS w FROM a), c AS (SELECT vec_id, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz FROM m GROUP BY 1) SELECT vec_id, round(sqrt(sum(w * (power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))) / sum(w)), 6) AS rg FROM m JOIN c USING (vec_id) GROUP BY 1")
def radius_of_gyration(t: Tables) -> DataFrame:
    return residues.gyration(atoms(t), ["vec_id"], ["x", "y", "z"], "mass").select("vec_id", r("rg").alias("rg"))


RMSF = ", f AS (SELECT label, atom, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf FROM a GROUP BY 1, 2)"


@query(ATOMS + RMSF + " SELECT label, atom, round(rmsf, 6) AS rmsf FROM f")
def rmsf(t: Tables) -> DataFrame:
    return residues.fluctuations(atoms(t), ["label", "atom"], ["x", "y", "z"]).withColumn("rmsf", r("rmsf"))


@query(ATOMS + RMSF + " SELECT label, atom // 4 AS residue, round(sqrt(avg(rmsf * rmsf)), 6) AS rmsf FROM f GROUP BY 1, 2")
def rmsf_per_residue(t: Tables) -> DataFrame:
    f = residues.fluctuations(atoms(t), ["label", "atom"], ["x", "y", "z"]).withColumn("residue", F.floor(F.col("atom") / 4))
    return residues.per_group(f, ["label", "residue"]).withColumn("rmsf", r("rmsf"))


@query(ATOMS + ", w AS (SELECT *, 1.0 + vec_id % 3 AS w FROM a), m AS (SELECT atom, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM w GROUP BY 1) SELECT atom, round(sqrt(sum(w * (power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2))) / sum(w)), 6) AS rmsf FROM w JOIN m USING (atom) GROUP BY 1")
def weighted_rmsf(t: Tables) -> DataFrame:
    f = residues.fluctuations(atoms(t).withColumn("w", 1.0 + F.col("vec_id") % 3), ["atom"], ["x", "y", "z"], "w")
    return f.select("atom", r("rmsf").alias("rmsf"))


@query(ATOMS + ", d AS (SELECT label, vec_id, sqrt(sum(x * x + y * y + z * z) / count(*)) AS v FROM a GROUP BY 1, 2) SELECT label, count(*) AS frames, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(max(v), 6) AS max FROM d GROUP BY 1")
def descriptor_summary(t: Tables) -> DataFrame:
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    d = atoms(t).groupBy("label", "vec_id").agg(F.sqrt(F.sum(square) / F.count("*")).alias("v"))
    return d.groupBy("label").agg(F.count("*").alias("frames"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), r(F.max("v")).alias("max"))


@query(ATOMS + """, s AS (SELECT *, CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS st FROM a), g AS (SELECT st, atom, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS f, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s GROUP BY 1, 2)
SELECT p.atom, p.n AS n_a, q.n AS n_b, round(p.f, 6) AS rmsf_a, round(q.f, 6) AS rmsf_b, round(q.f - p.f, 6) AS delta_rmsf, round(sqrt(power(q.mx - p.mx, 2) + power(q.my - p.my, 2) + power(q.mz - p.mz, 2)), 6) AS displacement FROM g p JOIN g q ON q.atom = p.atom AND p.st = 'A' AND q.st = 'B'""")
def state_differences(t: Tables) -> DataFrame:
    s = atoms(t).withColumn("st", F.when(F.col("label") < 5, "A").otherwise("B"))
    d = residues.state_differences(s, "st", ["atom"], ["x", "y", "z"], "A", "B")
    return d.select("atom", "n_a", "n_b", *(r(c).alias(c) for c in ("rmsf_a", "rmsf_b", "delta_rmsf", "displacement")))


@query(ATOMS + """, s AS (SELECT *, 1.0 + vec_id % 2 AS w FROM a), p AS (SELECT label % 3 AS st, atom, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz,
greatest(0, sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2) + sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2) + sum(w * z * z) / sum(w) - power(sum(w * z) / sum(w), 2)) AS msf FROM s GROUP BY 1, 2),
r AS (SELECT arg_min(st, (-n, st)) AS st FROM (SELECT st, max(n) AS n FROM p GROUP BY 1)) SELECT b.atom // 4 AS residue, b.st AS state, count(*) AS n_atoms, round(sqrt(avg(a.msf)), 6) AS rmsf_a, round(sqrt(avg(b.msf)), 6) AS rmsf_b, round(sqrt(avg(b.msf)) - sqrt(avg(a.msf)), 6) AS delta_rmsf,
round(sqrt(avg(power(b.mx - a.mx, 2) + power(b.my - a.my, 2) + power(b.mz - a.mz, 2))), 6) AS mean_rmsd, round(sqrt(power(avg(b.mx - a.mx), 2) + power(avg(b.my - a.my), 2) + power(avg(b.mz - a.mz), 2)), 6) AS displacement
FROM p b JOIN p a ON a.atom = b.atom AND a.st = (SELECT st FROM r) AND b.st <> a.st GROUP BY 1, 2""")
def residue_state_differences(t: Tables) -> DataFrame:
    """Every state's residues against those of the state of most frames, with weights."""
    m = atoms(t).withColumn("st", F.col("label") % 3).withColumn("residue", F.floor(F.col("atom") / 4)).withColumn("w", 1.0 + F.col("vec_id") % 2)
    d = residues.all_state_differences(m, "st", "residue", "atom", ["x", "y", "z"], "w")
    return d.select("residue", F.col("state_b").alias("state"), "n_atoms", *(r(c).alias(c) for c in ("rmsf_a", "rmsf_b", "delta_rmsf", "mean_rmsd")), r("centroid_displacement").alias("displacement"))


@query(ATOMS + """, c AS (SELECT label, vec_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM a GROUP BY 1, 2), g AS (SELECT a.label, a.vec_id, sqrt(avg(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2))) AS rg FROM a JOIN c USING (label, vec_id) GROUP BY 1, 2),
s AS (SELECT label, round(avg(rg), 6) AS rg_mean, round(stddev_samp(rg), 6) AS rg_sd, count(*) AS frames FROM g GROUP BY 1), f AS (SELECT label, atom, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf FROM a GROUP BY 1, 2), h AS (SELECT label, round(avg(rmsf), 6) AS rmsf_mean, round(max(rmsf), 6) AS rmsf_max FROM f GROUP BY 1) SELECT * FROM s JOIN h USING (label)""")
def state_ensemble_summary(t: Tables) -> DataFrame:
    a = atoms(t).withColumn("one", F.lit(1.0))
    g = residues.gyration(a, ["label", "vec_id"], ["x", "y", "z"], "one")
    s = g.groupBy("label").agg(r(F.avg("rg")).alias("rg_mean"), r(F.stddev_samp("rg")).alias("rg_sd"), F.count("*").alias("frames"))
    f = residues.fluctuations(a, ["label", "atom"], ["x", "y", "z"]).groupBy("label").agg(r(F.avg("rmsf")).alias("rmsf_mean"), r(F.max("rmsf")).alias("rmsf_max"))
    return s.join(f, "label")


ANGLE = ATOMS + """, p AS (SELECT vec_id, max(CASE WHEN atom = 0 THEN x END) AS ax, max(CASE WHEN atom = 0 THEN y END) AS ay, max(CASE WHEN atom = 0 THEN z END) AS az, max(CASE WHEN atom = 1 THEN x END) AS bx, max(CASE WHEN atom = 1 THEN y END) AS bb, max(CASE WHEN atom = 1 THEN z END) AS bz,
max(CASE WHEN atom = 2 THEN x END) AS cx, max(CASE WHEN atom = 2 THEN y END) AS cy, max(CASE WHEN atom = 2 THEN z END) AS cz, max(CASE WHEN atom = 3 THEN x END) AS dx, max(CASE WHEN atom = 3 THEN y END) AS dy, max(CASE WHEN atom = 3 THEN z END) AS dz FROM a GROUP BY 1),
e AS (SELECT vec_id, bx - ax AS x1, bb - ay AS y1, bz - az AS z1, cx - bx AS x2, cy - bb AS y2, cz - bz AS z2, dx - cx AS x3, dy - cy AS y3, dz - cz AS z3 FROM p),
n AS (SELECT *, y1 * z2 - z1 * y2 AS u1, z1 * x2 - x1 * z2 AS u2, x1 * y2 - y1 * x2 AS u3, y2 * z3 - z2 * y3 AS v1, z2 * x3 - x2 * z3 AS v2, x2 * y3 - y2 * x3 AS v3 FROM e)
SELECT vec_id, round(degrees(atan2((x1 * v1 + y1 * v2 + z1 * v3) * sqrt(x2 * x2 + y2 * y2 + z2 * z2), u1 * v1 + u2 * v2 + u3 * v3)), 5) AS angle FROM n"""


@query(ANGLE)
def dihedral_angle(t: Tables) -> DataFrame:
    """The dihedral of the first four points of each vector."""
    v = vectors(t)
    p = [[F.col("embedding")[3 * k + c].cast("double") for c in range(3)] for k in range(4)]
    return v.select("vec_id", r(residues.dihedral(p), 5).alias("angle"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", r(dot(F.col("embedding"), F.col("embedding"))).alias("norm2"))


@query()
def superposition(t: Tables) -> DataFrame:
    """Frames of 22 points fitted onto the first one."""
    v = padded(t, "c").select("vec_id", "c")
    ref = np.array(v.where("vec_id = 0").first()["c"]).reshape(-1, 3)
    return decompose.superposed(v, "c", ref).select("vec_id", "fit_rmsd")

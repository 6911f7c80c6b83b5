"""Approximate nearest neighbours with balanced posting lists.

Centroids are the means of cells of a bounded sample, made by cutting the largest cell in half across its two means until there are enough. Every vector goes to
the list of its nearest centroid, and near a boundary to up to `COPIES` lists, those at most `REPLICATE` times as far. Centroids are searched through a neighbour graph in memory, many vectors at a time. A query opens the lists whose
centroids are at most so many times as far as its nearest as the index needs: a bounded set of its queries is compared with every vector, and the ratio
is the one at which they would find the share `RECALL` of their true neighbours, `PROBE` at least. Members are compared exactly, in double precision.

Equal vectors are one entry of the index with their smallest ids, one more than a query can name, so a vector that a third of all rows share
is one member of its lists, and no result is lost. Large lists are dealt in parts and small ones together, up to `PART` members, so that a query travels once for many lists. Queries that found
fewer neighbours than there are search all lists.

Defined results: null, zero, non-finite vectors, and those whose length is not the commonest one, take no part;
rows with a null id neither; repeated ids name each vector they carry (a query id with several vectors gets the neighbours of each, an id once); ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import stored

NEAREST = 10
SAMPLE, LIST, MOST_LISTS = 40_000, 256, 4096
#: Queries that one task compares with a part of the lists.
QUERIES = 20_000
REPLICATE, COPIES, PROBE = 1.03, 4, 1.1
DEGREE, BEAM = 24, 64
PART = 20_000
#: Queries compared with every vector to measure the index, and the share of their neighbours that must be found. The margin over 0.9 covers the error of the measure.
MEASURED, RECALL = 200, 0.95


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))


class Centroids:
    """Balanced centroids with a neighbour graph."""

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 4):
        rng = np.random.default_rng(11)
        cells = [np.arange(len(sample))]
        while len(cells) < lists and max(map(len, cells)) > 1:  # the largest cell is cut in half across its two means
            cells.sort(key=len)
            own = cells.pop()
            x = sample[own]
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(rounds):
                side = x @ (a - b)
                half = side >= np.median(side)
                if half.all() or not half.any():
                    half = np.arange(len(x)) < len(x) // 2
                a, b = x[half].mean(0), x[~half].mean(0)
            side = np.argsort(x @ (a - b), kind="stable")
            cells += [own[side[: len(x) // 2]], own[side[len(x) // 2 :]]]
        self.at = np.array([sample[c].mean(0) for c in cells]) if len(sample) else np.zeros((1, 1))
        lists = len(self.at)
        near = [np.argsort(_distances(self.at[s : s + 512], self.at), axis=1)[:, 1 : DEGREE + 1] for s in range(0, lists, 512)]
        self.graph = np.concatenate(near)
        self.entries = np.unique(np.linspace(0, lists - 1, min(lists, BEAM)).astype(int))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the centroids found near each row, nearest first; walks the graph for all rows together."""
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        best = None
        while True:
            d = np.sqrt(((self.at[ids] - x[:, None, :]) ** 2).sum(2))
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            again = np.concatenate([np.zeros((len(x), 1), bool), ids[:, 1:] == ids[:, :-1]], 1)
            d = np.where(again, np.inf, d)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            if best is not None and np.array_equal(best, ids):
                return ids, d
            best = ids
            if self.graph.shape[1] == 0:
                return ids, d
            ids = np.concatenate([ids, self.graph[ids[:, : beam // 4]].reshape(len(x), -1)], 1)

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector."""
        out = []
        for s in range(0, len(x), 256):
            ids, d = self.search(x[s : s + 256])
            close = d <= REPLICATE * d[:, :1]
            out += [i[c][:COPIES].astype(np.int32) for i, c in zip(ids, close, strict=True)]
        return out

    def needed(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The least ratio at which the query in each row of x opens a list that holds the vector in the same row of v."""
        out = np.ones(len(x))
        for s in range(0, len(x), 256):
            d = _distances(x[s : s + 256], self.at)
            for k, (near, own) in enumerate(zip(d, self.lists(v[s : s + 256]), strict=True)):
                if near[own].min() > near.min():
                    out[s + k] = near[own].min() / near.min() if near.min() > 0 else np.inf
        return out

    def probes(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The lists that each query opens."""
        out = []
        for s in range(0, len(x), 256):
            if ratio == np.inf:
                out += [np.arange(len(self.at), dtype=np.int32)] * len(x[s : s + 256])
                continue
            d = _distances(x[s : s + 256], self.at)  # all of them: where many lists are opened, a walk would visit them all
            out += [np.flatnonzero(near <= ratio * near.min()).astype(np.int32) for near in d]
        return out


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of rows that take part, all of the commonest length."""
    v = df[vector].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[key].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common[0] if common else 0))


def _matrix(column: pa.Array | list) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f8") for x in column]) if len(column) else np.zeros((0, 1))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every distinct vector, as bytes, with its `keep` smallest ids; equal vectors meet batch by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same: dict[bytes, list[int]] = {}
            flat = np.asarray(b.column(1).flatten(), np.float64) + 0.0  # -0.0 becomes 0.0
            data, width = flat.tobytes(), 8 * (len(flat) // max(1, b.num_rows))
            for k, i in enumerate(b.column(0).to_pylist()):
                same.setdefault(data[k * width : (k + 1) * width], []).append(i)
            ids = [sorted(set(x))[:keep] for x in same.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(same), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["v", "ids"])

    part = rows.mapInArrow(run, "v binary, ids array<long>")
    return part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def true_neighbours(index: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> list[list[bytes]]:
    """For each query (id, vector) the vectors of its k nearest other rows, by comparison with all of them; a task keeps k + 1 a query."""
    at = np.array([q for _, q in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, rows = np.zeros((len(at), 0)), np.zeros((len(at), 0), object)
        for b in batches:
            if not b.num_rows:
                continue
            one = np.empty(b.num_rows, object)
            one[:] = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            d = np.concatenate([d, _distances(at, _matrix([v for v, _ in one]))], 1)
            rows = np.concatenate([rows, np.broadcast_to(one, (len(at), len(one)))], 1)
            if d.shape[1] > k + 1:
                best = np.argpartition(d, k, axis=1)[:, : k + 1]
                d, rows = np.take_along_axis(d, best, 1), np.take_along_axis(rows, best, 1)
        flat = rows.reshape(-1)
        columns = (np.repeat(np.arange(len(at)), d.shape[1]), d.reshape(-1), [v for v, _ in flat], [i for _, i in flat])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["q", "d", "v", "ids"])

    found = index.select("v", "ids").mapInArrow(run, "q int, d double, v binary, ids array<long>")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))).where(F.col("n") <= k + 1)
    out: list[list[bytes]] = [[] for _ in queries]
    for r in found.orderBy("q", "n").collect():  # k + 1 rows a query
        out[r["q"]] += [bytes(r["v"])] * sum(i != queries[r["q"]][0] for i in r["ids"])
    return [x[:k] for x in out]


def measured_ratio(index: DataFrame, asked: DataFrame, centroids: Centroids, k: int) -> float:
    """The ratio at which a bounded set of the queries asked finds the share `RECALL` of its true neighbours."""
    some = [(r["id"], np.array(r["v"]) + 0.0) for r in asked.orderBy(F.xxhash64("id", "v"), "id").limit(MEASURED).collect()]
    if len(centroids.at) < 2 or not some:
        return 1.0
    pairs = [(q, v) for (_, q), near in zip(some, true_neighbours(index, some, k), strict=True) for v in near]
    if not pairs:
        return 1.0
    need = centroids.needed(np.array([q for q, _ in pairs]), _matrix([v for _, v in pairs]))
    return float(np.quantile(need, RECALL, method="higher")) * (1 + 1e-9)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = NEAREST, probe: float = PROBE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k nearest other rows found."""
    rows = valid(df, key, vector)
    index = stored(distinct(rows, k + 1), "vectors")
    count = index.count()
    total = rows.agg(F.countDistinct("id")).first()[0]
    taken = index.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toPandas()["v"]
    lists = min(MOST_LISTS, max(1, count // LIST))
    centroids = Centroids(_matrix(taken.tolist()), lists)
    parts = max(1, count * 3 // (lists * PART))
    together = max(1, PART * lists // (3 * max(1, count)))  # small lists that one task compares

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                owned = centroids.lists(_matrix(b.column(0).to_pylist()))
                take = pa.array(np.repeat(np.arange(b.num_rows), [len(o) for o in owned]))
                one = np.concatenate(owned) if owned else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=["list", "v", "ids"])

    postings = stored(index.mapInArrow(post, "list int, v binary, ids array<long>").withColumn("dealt", F.floor(F.col("list") / together).cast("int")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")), "postings")
    asked = stored(rows.where(F.col("id") % every == 0).distinct(), "queries")

    def search(queries: DataFrame, ratio: float) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) + 0.0
                rows = [(int(g), i, o[o // together == g]) for i, o in enumerate(centroids.probes(x, ratio) if b.num_rows else []) for g in np.unique(o // together)]
                columns = ([g for g, _, _ in rows], b.column(0).take(pa.array([i for _, i, _ in rows], pa.int64())), [x[i].tobytes() for _, i, _ in rows], [o for _, _, o in rows])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, (pa.int32(), None, pa.binary(), pa.list_(pa.int32())), strict=True)], names=["dealt", "id", "q", "lists"])

        sides = max(1, -(-queries.count() // QUERIES))  # each has a copy of the postings that its queries open
        opened = queries.mapInArrow(ask, "dealt int, id long, q binary, lists array<int>").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"))
        copies = postings.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

        def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple] = []
            if len(left) and len(right):
                code, names = pd.factorize(right["v"])
                x, ids, first = _matrix(list(names)), right["ids"].to_numpy()[np.unique(code, return_index=True)[1]], key[0] * together
                member = np.zeros((len(x), together), bool)
                member[code, right["list"].to_numpy() - first] = True
                square = (x * x).sum(1)
                for s in range(0, len(left), 64):
                    some = left.iloc[s : s + 64]
                    at = _matrix(some["q"].tolist())
                    rough = square[:, None] - 2 * x @ at.T + (at * at).sum(1)
                    for i, (query, lists) in enumerate(zip(some["id"].tolist(), some["lists"], strict=True)):
                        rows = np.flatnonzero(member[:, np.asarray(lists) - first].any(1))
                        if not len(rows):
                            continue
                        r, kth = rough[rows, i], min(k, len(rows) - 1)  # k others, and the query's own vector
                        if np.isfinite(r).all():  # only what rounding cannot rule out is compared exactly
                            rows = rows[r <= np.partition(r, kth)[kth] + 1e-9 * (square.max() + (at[i] * at[i]).sum())]
                        d = np.sqrt(((x[rows] - at[i]) ** 2).sum(1))
                        near = np.flatnonzero(d <= np.partition(d, kth)[kth])
                        mine = sorted((float(d[n]), j) for n in near.tolist() for j in ids[rows[n]] if j != query)[:k]
                        found += [(query, j, score) for score, j in mine]
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        met = opened.groupBy("dealt", "part", "side").cogroup(copies.groupBy("dealt", "part", "side")).applyInPandas(compare, "query_id long, vec_id long, score double")
        once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = stored(search(asked, max(probe, measured_ratio(index, asked, centroids, k))), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1))
    short = asked.join(full.select(F.col("query_id").alias("id")), "id", "left_anti")
    if total > 1 and not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(stored(search(short, float("inf")), "found"))
    return found

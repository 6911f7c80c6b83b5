"""Near-duplicate detection by Order MinHash with verification by banded alignment.

Texts are lower-cased and cut into words (letters, digits and all non-ASCII characters), five words make a shingle, and each
shingle is labelled with its occurrence number. A sketch takes, under its own hash function, the few least labelled
shingles of a text and keeps them in text order: it agrees between two texts about as often as their
similarity to the power of that number, and only if the order agrees. Texts that agree in a sketch meet in a bucket.

Buckets are never multiplied out. Each member of a bucket is paired with two leaders, and in buckets of up to
`SMALL` with all others, which changes the order of work and no result; a leader is the member whose sketches are shared most widely, which in a family of
edited copies is their source. What that leaves open is done exactly: in larger buckets whose members ended in several
components, members are compared across components block by block, and every pair is verified, whatever the number of sketches it agrees in.

A pair is linked when its alignment within the band that the threshold allows matches so many shingles m that
m / (n1 + n2 - m) is at least 0.8: the Jaccard similarity of labelled shingles that stand in the same order.

Words are named by a keyed 64-bit digest, whole texts by one of 128 bits; texts of one name have the same words and are not aligned.

Defined results: null text counts as empty; texts with the same words (none included) are copies of each other; texts
shorter than five words make one shingle; the least key of a class names it; repeated keys are rows of their own; a null key is a
row like others and names a class only if all its keys are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WordNames, forget, kept_rows, mix64, named_words, only, row_name, sliced, stored, text_name, text_of
from terrane.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
SAMPLED = 4
#: Texts of so few shingles get further sketches of fewer shingles; a pair at the threshold with a longer text shares 16 shingles or more.
SHORT, MORE_SKETCHES, FEWER = 20, 12, 2
SMALL = 8
BLOCK = 1024
#: Cells in which a text's shingles are counted, for a bound on what two texts can have in common.
CELLS = 256
#: Nodes (16 bytes each) that may be broadcast to pick texts for verification; a join shuffles beyond that.
BROADCAST_NODES = 500_000
_BLANKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_SEEDS = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def shingled(texts: list[str], word_names: WordNames | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of all texts, where each text's begin, and a 128-bit name of each text's words."""
    words, at, names = named_words([t.lower().encode("utf-8", "surrogatepass") for t in texts], _BLANKS, WordNames() if word_names is None else word_names)
    count = np.diff(at)
    many = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    starts = np.repeat(at[:-1], many) + np.arange(begin[-1]) - np.repeat(begin[:-1], many)
    ends = np.repeat(at[1:], many)
    shingles = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            there = starts + k < ends
            word = words[np.minimum(starts + k, max(len(words) - 1, 0))] if len(words) else shingles
            shingles = np.where(there, mix64(shingles * np.uint64(0x9FB21C651E98DF25) + word), shingles)
    return shingles, begin, names


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle of a text with its occurrence number mixed in, so that all are distinct."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.flatnonzero(new)
    nth = np.empty(len(shingles), np.uint64)
    nth[order] = np.arange(len(shingles)) - np.repeat(run, np.diff(np.append(run, len(shingles))))
    with np.errstate(over="ignore"):
        return mix64(shingles + nth * np.uint64(0xA24BAED4963EE407))


def order_min_hash(keys: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED, first: int = 0) -> np.ndarray:
    """A 64-bit value for each sketch: the `sampled` least labelled shingles under its hash, in text order. `first`: number of the first sketch."""
    n, out = len(keys), np.zeros(sketches, np.uint64)
    take = min(sampled, n)
    step = max(1, min(sketches, 2_000_000 // max(n, 1)))
    with np.errstate(over="ignore"):
        for s in range(0, sketches, step):
            seeds = _SEEDS[first + s : first + min(s + step, sketches), None]
            hashed = keys[None, :] * seeds
            hashed ^= hashed >> np.uint64(32)
            places = np.argpartition(hashed, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), hashed.shape)
            places = np.sort(places, axis=1)
            value = np.full(len(places), take, np.uint64)
            for k in range(take):
                value = mix64(value * np.uint64(0x9FB21C651E98DF25) + keys[places[:, k]])
            out[s : s + len(places)] = mix64(value + np.arange(first + s, first + s + len(places), dtype=np.uint64))
    return out


def sketched(keys: np.ndarray) -> np.ndarray:
    """The sketches of a text; a short one has further sketches of fewer shingles, as few of its larger samples agree after one edit."""
    long = order_min_hash(keys)
    return np.concatenate([long, order_min_hash(keys, MORE_SKETCHES, FEWER, SKETCHES)]) if len(keys) <= SHORT else long


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Order-respecting similarity of two shingle sequences by alignment within the band that `similarity` allows; 0 if it is surely less.

    The longest common subsequence is found by bits, a shingle of `b` at a time: a zero bit of `row` is a place of `a` where the length
    grows. `row` holds the places near the shingle's own, wide enough for every alignment that reaches `similarity`.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return float(n == m)
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))  # in any order, so no alignment matches more
    if common < similarity * (n + m - common):
        return 0.0
    band = int((n + m) * (1 - similarity) / (1 + similarity)) + 1
    differ = a[: min(n, m)] != b[: min(n, m)]
    head = int(differ.argmax()) if differ.any() else min(n, m)
    a, b = a[head:], b[head:]
    differ = a[::-1][: min(len(a), len(b))] != b[::-1][: min(len(a), len(b))]
    tail = int(differ.argmax()) if differ.any() else len(differ)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return (same := head + tail + _common_run(a, b, band)) / (n + m - same)


def cell_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each cell: the cell-wise minima of two texts add up to no less than the shingles they have in common."""
    return np.bincount((mix64(shingles) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)


def _common_run(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches are at most about `band` places apart."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    first, last = np.searchsorted(ranked, b, "left").tolist(), np.searchsorted(ranked, b, "right").tolist()
    step, low, high, row, found = max(64, band), 0, 0, 0, 0
    for s in range(0, len(b), step):
        new_low, new_high = min(len(a), max(0, s - band)), min(len(a), s + step + band)
        row |= ((1 << (new_high - high)) - 1) << (high - low)
        gone = new_low - low
        found += gone - (row & ((1 << gone) - 1)).bit_count()
        row, low, high = row >> gone, new_low, new_high
        full, often = (1 << (high - low)) - 1, {}
        for x, y in zip(first[s : s + step], last[s : s + step], strict=True):
            if y == x + 1:
                at = int(order[x]) - low
                mask = 1 << at if 0 <= at < high - low else 0
            elif y > x:
                mask = often.get(x)
                if mask is None:
                    at = order[x:y] - low
                    bits = np.zeros(high - low, np.uint8)
                    bits[at[(at >= 0) & (at < high - low)]] = 1
                    mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                    if y - x > 64:  # few shingles are so frequent: their places are kept for the block
                        often[x] = mask
            else:
                continue
            hit = row & mask
            if hit:
                row = (row + hit | row - hit) & full
    return found + (high - low) - row.bit_count()


def _sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        word_names = WordNames()
        for whole in batches:
            for b in sliced(whole, 1):
                shingles, begin, names = shingled(b.column(1).to_pylist(), word_names)
                begin = begin.tolist()
                keys, known = [], {}
                for name, s, e in zip(names, begin, begin[1:], strict=False):
                    if name not in known:
                        known[name] = sketched(labelled(shingles[s:e])).view(np.int64) if e > s else np.zeros(0, np.int64)
                    keys.append(known[name])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((b.column(0), names, np.diff(begin), keys), types, strict=True)], names=["id", "node", "n", "keys"])

    return df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text")).mapInArrow(run, "id long, node binary, n int, keys array<long>")


def _sequences(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, seq): the shingles, 32 bits each, of the wanted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_names = WordNames()
        for whole in batches:
            for b in sliced(whole, 0):
                shingles, begin, names = shingled(b.column(0).to_pylist(), word_names)
                data = (shingles >> np.uint64(32)).astype("<u4").tobytes()
                begin = (begin * 4).tolist()
                rows = {name: data[s:e] for name, s, e in zip(names, begin, begin[1:], strict=False)}
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], names=["node", "seq"])

    few = wanted.count() <= BROADCAST_NODES
    found = df.select(text_of(df, text).alias("text")).mapInArrow(run, "node binary, seq binary")
    return found.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(df: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that the alignment accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [aligned(np.frombuffer(x, "<u4").astype(np.uint64), np.frombuffer(y, "<u4").astype(np.uint64)) >= SIMILARITY for x, y in zip((v.as_py() for v in b.column(2)), (v.as_py() for v in b.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes, "wanted")
    seqs = stored(_sequences(df, text, wanted), "sequences")
    both = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("x")), "a").join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("y")), "b")
    links = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "links")
    forget(wanted, seqs)
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs as (lesser, greater), once each, of lengths that the threshold allows."""
    fit = F.least("n1", "n2") >= SIMILARITY * F.greatest("n1", "n2")
    return pairs.where(fit & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open_links(df: DataFrame, text: str, large: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components within the larger buckets, found exactly.

    Members outside a bucket's commonest component are compared with all members of other components. Both sides
    are dealt in blocks, so no task holds a whole bucket, and only links leave a task. A pair is compared in the bucket of the first
    sketch it agrees in; if that bucket is small, the pair was compared before.
    """
    placed = large.join(members, "node", "left").select("bucket", "c", "node", "n", F.coalesce("component", "node").alias("comp"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("all")).where(F.col("main.k") < F.col("all"))
    mixed = mixed.select("bucket", F.col("main.comp").alias("main"), (F.col("all") - F.col("main.k")).alias("outside"))
    rest = stored(placed.join(mixed, "bucket"), "rest")
    wanted = stored(rest.select("node").distinct(), "wanted")
    seqs = _sequences(df, text, wanted).join(texts.select("node", "keys"), "node")
    many = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rest = rest.join(seqs, "node").withColumn("mb", many("c")).withColumn("ob", many("outside"))
    row = ["bucket", "i", "j", "outer", "node", "n", "comp", "keys", "seq"]
    inner = rest.withColumn("i", part(F.col("mb"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ob") - 1))).withColumn("outer", F.lit(False)).select(row)
    outer = rest.where("comp != main").withColumn("j", part(F.col("ob"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("outer", F.lit(True)).select(row)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        most = max(map(len, rows["keys"]))  # two texts agree in a sketch that both have, so what fills up is not met first
        keys, n, node = np.array([np.pad(k, (0, most - len(k))) for k in rows["keys"]], np.int64), rows["n"].to_numpy(), rows["node"].tolist()
        seq = [np.frombuffer(x, "<u4").astype(np.uint64) for x in rows["seq"]]
        comp, outer = pd.factorize(rows["comp"])[0], rows["outer"].to_numpy()
        outside = {node[k] for k in np.flatnonzero(outer)}
        cells = np.array([cell_counts(s) for s in seq])
        found = []
        for x in np.flatnonzero(outer).tolist():
            y = np.flatnonzero(~outer & (comp != comp[x]) & (np.minimum(n, n[x]) >= SIMILARITY * np.maximum(n, n[x])))
            y = y[keys[x][(keys[y] == keys[x]).argmax(1)] == key[0]]
            most = np.minimum(cells[y], cells[x]).sum(1)
            y = y[most >= SIMILARITY * (n[y] + n[x] - most)]
            for k in y.tolist():
                if comp[k] != comp[x] and not (node[k] in outside and node[k] < node[x]) and aligned(seq[x], seq[k]) >= SIMILARITY:
                    found.append((min(node[x], node[k]), max(node[x], node[k])))
                    comp[comp == comp[k]] = comp[x]
        return pd.DataFrame(found, columns=["a", "b"])

    links = stored(inner.unionByName(outer).groupBy("bucket", "i", "j").applyInPandas(run, "a binary, b binary"), "links")
    forget(wanted)
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: key, class_id, class_size, kept (one row of each class: its least key's first)."""
    return _classed(df, key, text).drop("node")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns."""

    @F.pandas_udf("binary")
    def name(texts: pd.Series) -> pd.Series:
        return pd.Series([text_name(t.lower().encode("utf-8", "surrogatepass"), _BLANKS) for t in texts], index=texts.index, dtype=object)

    decided = _classed(df, key, text)
    decided = decided.select(row_name(F.col(key), F.hex("node")).alias("_name"), "kept")
    return kept_rows(df, row_name(df[key].cast("long"), F.hex(name(text_of(df, text)))), decided)


def _classed(df: DataFrame, key: str, text: str) -> DataFrame:
    docs = stored(_sketched(df, key, text), "sketches")
    texts = stored(docs.groupBy("node").agg(F.min(F.struct("id", "n", "keys")).alias("r"), F.count("*").alias("copies"), F.min("id").alias("least")).select("node", "r.n", "r.keys", "copies", "least"), "texts")
    cells = texts.select("node", "n", F.explode("keys").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    cells = stored(cells.join(shared, "bucket"), "cells")
    rank = stored(cells.groupBy("node").agg(F.sum("c").alias("wide")), "rank")
    ranked = stored(cells.join(rank, "node"), "ranked")
    forget(cells, rank)
    small = ranked.where(F.col("c") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("node", "n")).alias("m"))
    small = small.select(F.explode(F.flatten(F.expr("transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.node as x, x.n as n1, y.node as y, y.n as n2)))"))).alias("p")).select("p.*")
    large = ranked.where(F.col("c") > SMALL)
    leaders = large.groupBy("bucket").agg(F.max(F.struct("wide", "node", "n")).alias("top"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "n")).alias("any"))
    leaders = stored(leaders.select("bucket", F.explode(F.array(F.struct("top.node", "top.n"), F.struct("any.node", "any.n"))).alias("l")).select("bucket", F.col("l.node").alias("x"), F.col("l.n").alias("n1")), "leaders")
    starred = large.join(leaders, "bucket").select("x", "n1", F.col("node").alias("y"), F.col("n").alias("n2"))
    pairs = stored(_ordered(small.unionByName(starred)), "pairs")
    links = _verified(df, text, pairs)
    members = stored(components(links), "members")
    more = _open_links(df, text, large, members, texts)
    if not more.isEmpty():
        members = stored(components(links.union(more)), "members")
    classed = texts.join(members, "node", "left").select("node", "copies", "least", F.coalesce("component", "node").alias("class"))
    classes = classed.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = stored(classed.join(classes, "class").select("node", "class_id", "class_size", "class"), "named")
    out = docs.select("id", "node").withColumn("row", F.monotonically_increasing_id())
    first = out.join(named, "node").where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("row").alias("first"))
    named = stored(named.join(first, "class").select("node", "class_id", "class_size", "first"), "named")
    return out.join(named, "node").select(F.col("id").alias(key), "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"), "node")

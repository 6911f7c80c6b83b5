"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Every partition hashes its normalised texts, and sends each owner (a range of hash values) its own
   hashes, sorted and Golomb-coded: the gaps of sorted hashes are geometric, so a Rice code with the
   right parameter takes about log2(gap) + 1.5 bits a hash.
2. An owner decodes what it got, finds hashes held more than once, and answers every sender with a
   bitmap over the sender's sorted distinct hashes.
3. Only suspects (rows whose bit is set) have their texts shuffled, and are grouped by the text itself, so equality is of
   bytes, never of hashes. The grouping aggregates inside each map task first: a text that a third of
   all rows share crosses the network once for each map task.

Defined results: a null text counts as empty; empty texts equal each other; ties go to the smaller key,
repeated keys are rows of their own (exactly one row of a group is kept); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import kept_rows, only, owners, row_name, stored, text_of

#: Rows whose hashes one owner answers for (some 100 bytes each while it does), so that owners grow with the table.
OWNER_ROWS = 2_000_000
WHITE = b" \t\n\x0b\x0c\r"
#: Suspect hashes that may be broadcast (8 bytes each); beyond that a sort-merge join finds the texts.
BROADCAST_HASHES = 1_000_000


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Rice-code sorted distinct integers in [0, span): returns the parameter and the packed bits."""
    n = len(values)
    if n == 0:
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, span / n * 0.69))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - (quotient + 1 + k)
    ones = np.repeat(starts, quotient) + (np.arange(quotient.sum()) - np.repeat(np.cumsum(quotient) - quotient, quotient))
    bits[ones] = 1
    for i in range(k):
        bits[starts + quotient + 1 + i] = ((gaps >> np.uint64(k - 1 - i)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(bits).tobytes()


def golomb_decode(k: int, n: int, data: bytes) -> np.ndarray:
    """Inverse of `golomb_encode`. The position of each unary end depends on the one before: a jump table over the zeros keeps it a loop over n."""
    if n == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    rank = np.searchsorted(zeros, np.arange(len(bits) + 1)).tolist()
    where, stops, at = zeros.tolist(), [], 0
    for _ in range(n):
        stop = where[rank[at]]
        stops.append(stop)
        at = stop + 1 + k
    stop = np.array(stops, np.int64)
    quotient = np.diff(stop + 1 + k, prepend=0) - 1 - k
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    for i in range(k):
        gaps |= bits[stop + 1 + i].astype(np.uint64) << np.uint64(k - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64)


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE)


def fingerprints(df: DataFrame, key: str, text: str, n_owners: int) -> DataFrame:
    """Rows of two kinds: one for each document (key, hash, sha256, length, where its hash stands in what
    its partition sends) and one for each owner that gets hashes from a partition."""
    span = 2**64 // n_owners + 1
    schema = "part long, seq int, owner int, pos int, id long, h long, sha binary, n_cp int, k int, n int, blob binary"
    names = ["part", "seq", "owner", "pos", "id", "h", "sha", "n_cp", "k", "n", "blob"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only()
        part = TaskContext.get().partitionId()
        ids, shas, sizes = [], [], []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                ids.append(i)
                shas.append(hashlib.sha256(normalised(t)).digest())
                sizes.append(len(t))
        if not ids:
            return
        h = np.frombuffer(b"".join(shas), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        sent = np.unique(h)
        owner = (sent // np.uint64(span)).astype(np.int64)
        first = np.searchsorted(owner, np.arange(n_owners + 1))
        at = np.searchsorted(sent, h)
        for s in range(0, len(ids), 20_000):
            e = min(s + 20_000, len(ids))
            own = owner[at[s:e]]
            columns = [[part] * (e - s), range(s, e), own, at[s:e] - first[own], ids[s:e], h[s:e].view(np.int64), shas[s:e], sizes[s:e], *[[None] * (e - s)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        for o in np.unique(owner).tolist():
            mine = sent[first[o] : first[o + 1]] - np.uint64(o * span)
            k, blob = golomb_encode(mine, span)
            row = (part, None, o, None, None, None, None, None, k, len(mine), blob)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text")).mapInArrow(run, schema)


def answer(blobs: DataFrame) -> DataFrame:
    """Owners: a bitmap for each sender, set where another sender or the sender's own other row has the hash.

    A sender sends distinct hashes, so copies inside one partition are found by the sender itself; see `suspects`.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sent = [golomb_decode(k, n, b) for k, n, b in zip(rows["k"], rows["n"], rows["blob"], strict=True)]
        values, count = np.unique(np.concatenate(sent), return_counts=True)
        twice = values[count > 1]
        maps = [np.packbits(np.isin(s, twice, assume_unique=True)).tobytes() for s in sent]
        return pd.DataFrame({"part": rows["part"], "owner": rows["owner"], "bits": maps})

    return blobs.groupBy("owner").applyInPandas(run, "part long, owner int, bits binary")


def repeated_hashes(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """Hashes of suspects: those whose bit is set in an owner's answer, and those that come again within one partition
    (a partition sends each hash once, so it sees these itself)."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, owner, bitmap in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int64)), pa.array(np.full(len(at), owner, np.int32)), pa.array(at)], names=["part", "owner", "pos"])

    hits = bits.mapInArrow(positions, "part long, owner int, pos int")
    crossing = docs.select("part", "owner", "pos", "h").join(hits, ["part", "owner", "pos"]).select("h")
    inside = docs.groupBy("part", "h").count().where("count > 1").select("h")
    return crossing.union(inside).distinct()


def texts_with_hash(df: DataFrame, text: str) -> DataFrame:
    """(h, norm): the hash and the normalised bytes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                norm = [normalised(t) for t in b.column(0).slice(s, 1000).to_pylist()]
                h = np.array([int.from_bytes(hashlib.sha256(x).digest()[:8], "big") for x in norm], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(norm, pa.binary())], names=["h", "norm"])

    return df.select(text_of(df, text).alias("text")).mapInArrow(run, "h long, norm binary")


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: key, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after deleting ASCII white space. Of equal texts the longest original (code
    points), then the smallest key, then the first row read stays; a null key is the smallest.
    """
    spark = df.sparkSession
    table = stored(fingerprints(df, key, text, max(owners(spark), -(-df.count() // OWNER_ROWS))), "fingerprints")
    docs = table.where("blob is null")
    bits = answer(table.where("blob is not null").select("part", "owner", "k", "n", "blob"))
    suspects = stored(repeated_hashes(docs, bits), "suspects")
    few = suspects.count() <= BROADCAST_HASHES
    wanted = F.broadcast(suspects) if few else suspects
    checked = texts_with_hash(df, text).join(wanted, "h", "left_semi").groupBy("norm").agg(F.count("*").alias("group_size")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    keepers = docs.join(wanted, "h", "left_semi").groupBy("sha").agg(F.min(F.struct((-F.col("n_cp")).alias("less"), "id", "part", "seq")).alias("keeper"), F.count("*").alias("n"))
    groups = keepers.join(checked, "sha", "left").select("sha", "keeper", F.when(F.col("group_size") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("texts of one sha256 differ"))).alias("n"))
    groups = stored(groups, "groups")  # so that the join below can split a large group's rows
    out = docs.select("id", "part", "seq", "sha").join(groups, "sha", "left")
    grouped = F.col("keeper").isNotNull()
    return out.select(
        F.col("id").alias(key),
        F.when(grouped, F.col("keeper.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (~grouped | ((F.col("keeper.part") == F.col("part")) & (F.col("keeper.seq") == F.col("seq")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(normalised(t)).hexdigest()).astype(object)

    decided = exact_duplicates(df, key, text)
    decided = decided.select(row_name(F.col(key), F.col("text_sha256")).alias("_name"), "kept")
    return kept_rows(df, row_name(df[key].cast("long"), digest(text_of(df, text))), decided)

"""Removal of passages that documents share, by common-prefix interval trees of suffix arrays.

A window is a string of `LENGTH` bytes. It is named by the least hash of the `GRAM`-byte strings in it, so equal windows have equal
names wherever they stand; large tables take longer strings (`_wider`). Neighbouring windows of one name make a stretch, some 70 bytes of text
with all its windows.

1. Tasks send the owners of hash ranges their names, 32 bits each, and get a bitmap back: which names other documents have, too.
2. Stretches of shared names are read again. A part of a task holds each of them once and asks the shards of their names about them,
   with the least and greatest of its documents that have it, compressed; where its documents have them it keeps to itself.
3. All stretches of a name meet in one chunk of a shard, equal ones as one. Suffixes that share `LENGTH` bytes make the buckets of its suffix
   array, which is refined eight bytes at a time; the common prefix of neighbours comes with each split. A stack scan over it closes the intervals of the common-prefix tree, and those whose members
   differ in the byte before them, or begin a stretch, are the maximal repeats: a group each, with all its members. Chunks are small and as
   many as the input needs; shards are few, so that the rows between parts and shards grow with the input.
4. Parts get an answer for each stretch: its least document, and which of its bytes an earlier one has. No row of any exchange stands for a
   single occurrence, so a stretch of a third of all documents costs a shard one entry a part.

A name with more than `HOT` distinct stretches (what stands around a passage of a large part of all documents) is dealt by whole windows
instead: its windows are grouped by their bytes, with map-side aggregation, in any number of tasks.

Defined results: a null text counts as empty; a null key comes after all others (as does the greatest long); rows of one key are one document
for what counts as smaller, and each is judged by itself; texts below `LENGTH` bytes stay whole; an empty table gives no rows; other columns are not read.
A span may cut a character, so what is kept is bytes. Memory: about ten times the longest text; a chunk takes some `CHUNK` bytes of text, and `OPEN`
of them are unpacked at a time; a task holds the compressed questions of one shard, `SHARD_CHUNKS` chunks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import forget, give_back, mix64, only, sliced, stored, text_of

LENGTH, GRAM = 50, 16
#: Windows of a stretch: texts of a short period have long stretches, which are cut.
WINDOWS = 64
#: Text (bytes) or rows whose names a task sends together; names that an owner answers for; bytes of stretches in a chunk.
BLOCK, BLOCK_ROWS, OWNER_NAMES, CHUNK = 64_000_000, 1_000_000, 2_000_000, 2_000_000
#: Shards, as long as none has more chunks than the second number: a part asks each shard in one row, so rows grow with parts times shards.
SHARDS, SHARD_CHUNKS = 256, 64
#: Chunks of a shard that are open together; rows of a batch of questions.
OPEN, ASKED = 16, 32
#: Distinct stretches that a task gathers before it asks about them.
PART = 100_000
#: Stretches of one name that meet in a shard at most, and names that may have more: the former grows so that the latter holds (8 bytes each).
HOT, MOST_HOT = 20_000, 1_000_000
#: Rows with what is known of a document (some 100 bytes each) that may be broadcast to texts; beyond that, texts are shuffled.
BROADCAST_DOCUMENTS = 400_000
LAST = 2**63 - 1
_DIVERSE = -1


def grams(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers."""
    if len(data) < 8:
        return np.empty(0, np.uint64)
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first windows, ends) of the stretches of windows of one name. Windows are numbered by their first byte."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = grams(data)
    with np.errstate(over="ignore"):
        low = eight[: len(eight) - (gram - 8)]
        for k in [*range(8, gram - 8, 8), gram - 8]:
            low = low * np.uint64(0x9FB21C651E98DF25) + eight[k : k + len(low)]
        low = mix64(low)
    span, wide = length - gram + 1, 1
    while 2 * wide <= span:
        low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    begin = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    size = np.diff(np.append(begin, len(low)))
    if size.max() > WINDOWS:
        pieces = -(-size // WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + nth * WINDOWS
        size = np.minimum(np.repeat(size, pieces) - nth * WINDOWS, WINDOWS)
    return low[begin], begin, begin + size


def _refined(text: bytes, at: np.ndarray, stop: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes [at, stop) of `length` bytes or more that share these bytes with another one of their kind, in order within each such group, and
    the common prefix of each with the one before it (0 across groups).

    Groups are found by a hash of kind and bytes and compared in full. Then places whose order is open are sorted by their next eight bytes, round
    by round; a place whose neighbours differ is settled.
    """
    eight = grams(text + bytes(16))
    parts = sorted({*range(0, length - 7, 8), max(length - 8, 0)})
    mask = np.uint64(2 ** (8 * min(length, 8)) - 1)
    name = kind.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in parts:
            name = name * np.uint64(0x9FB21C651E98DF25) + (eight[at + k] & mask)
    name = mix64(name)
    order = np.argsort(name)
    again = name[order[1:]] == name[order[:-1]]
    order = order[np.append(False, again) | np.append(again, False)]
    alike = lambda x: x[order[1:]] == x[order[:-1]]
    same = lambda: np.logical_and.reduce([alike(kind), *(alike(eight[at + k] & mask) for k in parts)])
    equal = same()
    if (alike(name) & ~equal).any():  # different bytes of one hash
        order = order[np.lexsort([*((eight[at + k] & mask)[order] for k in parts), kind[order]])]
        equal = same()
    prefix = np.append(np.zeros(min(len(order), 1), np.int64), np.where(equal, -1, 0))
    depth = length
    while True:
        open_ = prefix < 0
        live = np.flatnonzero(open_ | np.append(open_[1:], False))
        if not len(live):
            return order, prefix
        head = ~open_[live]
        segment = np.cumsum(head)
        p = order[live]
        left = np.clip(stop[p] - at[p] - depth, 0, 8)
        word = eight[np.minimum(at[p] + depth, len(eight) - 1)].byteswap()
        word &= np.where(left > 0, ~np.uint64(0) << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64), np.uint64(0))
        way = np.lexsort((left, word, segment))
        order[live], word, left = p[way], word[way], left[way]
        differ = word[1:] ^ word[:-1]
        common = sum(((differ >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8)) + (differ == 0)
        short = np.minimum(left[1:], left[:-1])
        split = ~head[1:] & ((differ != 0) | (short < 8))
        prefix[live[1:][split]] = depth + np.minimum(common, short)[split]
        depth += 8


def maximal_repeats(pieces: list[bytes], kinds: np.ndarray, least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Groups of maximal repeats among pieces of one kind: (piece of each suffix that another one shares `length` bytes with, in order, its place
    in the piece, groups), where a group (first, last, size, least) is the suffixes from first to last, which share `size` bytes, and the least of their pieces' numbers."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    many = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    if not len(piece):
        return piece, offset, []
    text = b"".join(pieces)
    at = begin[piece] + offset
    order, prefix = _refined(text, at, begin[piece + 1], kinds[piece], length)
    piece, offset, at = piece[order], offset[order], at[order]
    before = np.where(offset > 0, np.frombuffer(text, np.uint8)[np.maximum(at - 1, 0)].astype(np.int64), _DIVERSE)
    groups: list[tuple[int, int, int, int]] = []
    deep = np.concatenate([prefix >= length, [False]])
    inside = np.flatnonzero(deep[:-1])
    if not len(inside):
        return piece, offset, groups
    brk = np.flatnonzero(np.diff(inside) > 1)
    head, tail = inside[np.append(0, brk + 1)], inside[np.append(brk, len(inside) - 1)]
    two = head[head == tail]  # intervals of two suffixes need no stack
    two = two[(before[two - 1] != before[two]) | (before[two] == _DIVERSE)]
    groups += zip((two - 1).tolist(), two.tolist(), prefix[two].tolist(), np.minimum(least[piece[two - 1]], least[piece[two]]).tolist(), strict=True)
    for s, e in zip(head[head < tail].tolist(), tail[head < tail].tolist(), strict=True):
        low, left = least[piece[s - 1 : e + 1]].tolist(), before[s - 1 : e + 1].tolist()
        stack: list[list[int]] = []
        for k, common in enumerate([*prefix[s : e + 1].tolist(), -1]):
            first, smallest, byte = k, low[k], left[k]
            while stack and stack[-1][0] > common:
                size, first, smallest_, byte_ = stack.pop()
                smallest = min(smallest, smallest_)
                byte = byte if byte == byte_ else _DIVERSE
                if byte == _DIVERSE:
                    groups.append((s - 1 + first, s - 1 + k, size, smallest))
            if stack and stack[-1][0] == common:
                top = stack[-1]
                top[2] = min(top[2], smallest)
                top[3] = top[3] if top[3] == byte else _DIVERSE
            elif common >= 0:
                stack.append([common, first, smallest, byte])
    return piece, offset, groups


def _wider(gram: int, length: int, size: int) -> int:
    """Bytes of a gram for a table of so many bytes: one more at 128 MB and at each fourfold of it. Otherwise nearly all stretches of a large table
    would have names that others have by chance. Names only say where to look, so results do not depend on it."""
    return max(gram, min(gram + ((size >> 27).bit_length() + 1) // 2, length // 2))


def _identity(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, text): the key with null as the last one, a hash that tells texts of one key apart, the text."""
    out = df.select(F.coalesce(df[key].cast("long"), F.lit(LAST)).alias("id"), text_of(df, text).alias("text"))
    return out.select("id", F.xxhash64("text").alias("t"), "text")


def _names(docs: DataFrame, owners: int, length: int, gram: int) -> DataFrame:
    """Rows of two kinds: for each document (block, seq, id, t, ranks: where its names stand among the block's, three bytes each), and
    for each owner (block, owner, n, names: sorted, 32 bits each; twice: a bit for each that two of the block's documents have)."""
    span = 2**64 // owners + 1
    shift = np.uint64(max(0, span.bit_length() - 32))
    fields = [("block", pa.int64()), ("seq", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("ranks", pa.binary()), ("owner", pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("twice", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    def block_rows(block: int, ids: list, hashes: list, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = mix64(np.concatenate(found))  # the least of many hashes lie near 0; owners need them all over
        owner = names // np.uint64(span)
        names = owner << np.uint64(32) | (names - owner * np.uint64(span)) >> shift
        sizes = np.array([len(f) for f in found])
        order = np.argsort(names)
        names, doc = names[order], np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        new = np.append(True, names[1:] != names[:-1])
        first = np.flatnonzero(new)
        sent, twice = names[first], np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        rank = np.empty(len(order), "<u4")
        rank[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        three = rank.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        del order, names, doc, new, first, rank
        ends = (np.cumsum(sizes) * 3).tolist()
        for s in range(0, len(ids), 10_000):
            yield batch([(block, k, ids[k], hashes[k], three[ends[k - 1] if k else 0 : ends[k]], None, None, None, None) for k in range(s, min(s + 10_000, len(ids)))])
        own = (sent >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(own, prepend=-1, append=owners + 1))
        rows = []
        for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            rows.append((block, None, None, None, None, int(own[s]), e - s, sent[s:e].astype("<u4").tobytes(), np.packbits(twice[s:e]).tobytes()))
            if len(rows) == 1000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only()
        base, nth = TaskContext.get().partitionId() << 16, 0
        ids, hashes, found, size = [], [], [], 0
        for whole in batches:
            for b in sliced(whole, 2):
                for i, t, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if len(data) < length:
                        continue
                    ids.append(i)
                    hashes.append(t)
                    found.append(stretches(data, length, gram)[0])
                    size += len(data)
                    if size >= BLOCK or len(ids) >= BLOCK_ROWS:
                        yield from block_rows(base + nth, ids, hashes, found)
                        ids, hashes, found, size, nth = [], [], [], 0, nth + 1
                        give_back()
        if ids:
            yield from block_rows(base + nth, ids, hashes, found)
        ids, hashes, found = [], [], []
        give_back()

    return docs.mapInArrow(run, "block long, seq int, id long, t long, ranks binary, owner int, n int, names binary, twice binary")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array, looked up one by one: what it costs grows with the values, not with the array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _answers(sent: DataFrame) -> DataFrame:
    """(block, owner, n, bits): a bit for each name that a block sent, set if two documents have it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, "<u4") for x in rows["names"]]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(rows["twice"], rows["n"], strict=True)]
        values = np.concatenate(names)
        values.sort()
        again = values[1:][values[1:] == values[:-1]]
        shared = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
        bits = [np.packbits(t | _among(x, shared)).tobytes() for x, t in zip(names, twice, strict=True)]
        del names, twice, values, again, shared
        give_back()
        return pd.DataFrame({"block": rows["block"], "owner": rows["owner"], "n": rows["n"], "bits": bits})

    return sent.groupBy("owner").applyInPandas(run, "block long, owner int, n int, bits binary")


def _suspects(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(uid, id, t, n, flags): for each document with a shared name a bit for each of its stretches, of which n are set."""

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("owner")
        bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(told["bits"], told["n"], strict=True)] or [np.zeros(0, np.uint8)])
        flags, many = [], []
        for ranks in rows["ranks"]:
            three = np.zeros((len(ranks) // 3, 4), np.uint8)
            three[:, :3] = np.frombuffer(ranks, np.uint8).reshape(-1, 3)
            own = bits[three.view("<u4")[:, 0]]
            many.append(int(own.sum()))
            flags.append(np.packbits(own).tobytes())
        out = pd.DataFrame({"uid": rows["block"] * 2**24 + rows["seq"], "id": rows["id"], "t": rows["t"], "n": many, "flags": flags})
        del bits, flags
        give_back()
        return out[out["n"] > 0]

    found = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "uid long, id long, t long, n int, flags binary")
    return found.groupBy("id", "t").agg(F.min(F.struct("uid", "n", "flags")).alias("r")).select("r.uid", "id", "t", "r.n", "r.flags")


def _with_known(docs: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Texts with what a stored table knows of them."""
    return docs.join(F.broadcast(known) if known.count() <= BROADCAST_DOCUMENTS else known, ["id", "t"], how)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of known types, one behind the other, with their lengths in front."""
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unzip(data: bytes, *types: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    ends = np.cumsum(np.frombuffer(raw, "<i8", len(types))) + 8 * len(types)
    return [np.frombuffer(raw[e - n : e], t) for e, n, t in zip(ends.tolist(), np.frombuffer(raw, "<i8", len(types)).tolist(), types, strict=True)]


def _chunk(names: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of each name. Consecutive chunks make a shard."""
    return (mix64(names.view(np.uint64)) % np.uint64(chunks)).astype(np.int64)


def _shared_stretches(docs: DataFrame, shards: int, chunks: int, length: int, gram: int) -> DataFrame:
    """Rows of two kinds: what a part of a task asks a shard (part, shard, n, names, and packed: each distinct stretch once, with its least and
    greatest document), and the part's documents (part, packed: numbers, keys, where which of the part's stretches stand, and the stretches' lengths)."""
    fields = [("part", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("names", pa.list_(pa.int64())), ("packed", pa.binary())]

    def batch(*rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only()
        part = TaskContext.get().partitionId() << 20
        known: dict[bytes, int] = {}
        names, which, where = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
        uids, keys, many = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            texts, own = list(known), np.array(which, np.int64)
            name, lows, highs = np.empty(len(texts), np.int64), np.full(len(texts), LAST), np.full(len(texts), -LAST - 1)
            key = np.repeat(np.array(keys, np.int64), many)
            name[own] = np.concatenate(names).view(np.int64)
            np.minimum.at(lows, own, key)
            np.maximum.at(highs, own, key)
            chunk = _chunk(name, chunks)
            order = np.lexsort((name, chunk))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            texts, name, lows, highs, ranked = [texts[k] for k in order.tolist()], name[order], lows[order], highs[order], chunk[order] * shards // chunks
            extent = np.fromiter(map(len, texts), "<u2", len(texts))
            edge, rows = np.flatnonzero(np.diff(ranked, prepend=-1, append=shards)), []
            for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                rows.append((part, int(ranked[s]), e - s, name[s:e], _zip(extent[s:e], np.frombuffer(b"".join(texts[s:e]), np.uint8), lows[s:e], highs[s:e])))
                if len(rows) == ASKED:
                    yield batch(*rows)
                    rows = []
            yield batch(*rows, (part, None, None, None, _zip(np.array(uids, "<i8"), np.array(keys, "<i8"), np.array(many, "<i4"), place[own], np.concatenate(where).astype("<i4"), extent)))
            for x in (known, which, uids, keys, many):
                x.clear()
            del names[1:], where[1:], texts, own, name, lows, highs, key, chunk, order, place, ranked, extent, rows
            give_back()

        for whole in batches:
            for b in sliced(whole, 0):
                for data, i, uid, flags in zip(b.column(0).cast(pa.binary()).to_pylist(), *(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    found, begin, end = stretches(data, length, gram)
                    want = np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(found)))
                    begin = begin[want]
                    which += [known.setdefault(data[s:e], len(known)) for s, e in zip(begin.tolist(), (end[want] + length - 1).tolist(), strict=True)]
                    names.append(found[want])
                    where.append(begin)
                    uids.append(uid)
                    keys.append(i)
                    many.append(len(want))
                    if len(known) >= PART or len(which) >= 4 * PART:
                        yield from flush()
                        part += 1
        if uids:
            yield from flush()

    return docs.select("text", "id", "uid", "flags").mapInArrow(run, "part long, shard int, n int, names array<long>, packed binary")


def _unpacked(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, least documents, greatest documents) that a part asks about."""
    sizes, data, low, high = _unzip(packed, "<u2", "u1", "<i8", "<i8")
    ends, raw = np.cumsum(sizes, dtype=np.int64).tolist(), data.tobytes()
    return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)], low, high


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as its count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def _united(piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each piece, overlapping and touching ones as one."""
    order = np.lexsort((start, piece))
    piece, start, end = piece[order], start[order], end[order]
    base = piece * np.int64(2**32)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(piece), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(piece))[: len(first)] - 1
    return piece[first], start[first], reach[last] - base[last]


def _told(raw: bytes, begin: np.ndarray, size: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, every: bool) -> tuple[np.ndarray, ...]:
    """(least, count, start, size, group) of the stretches of a chunk: the least document of each and how many members of groups it has, and these
    in order; groups are numbered from 0."""
    known: dict[bytes, int] = {}
    ref = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(begin.tolist(), (begin + size).tolist(), strict=True)], np.int64)
    lows, highs, kind = np.full(len(known), LAST), np.full(len(known), -LAST - 1), np.empty(len(known), np.int64)
    np.minimum.at(lows, ref, low)
    np.maximum.at(highs, ref, high)
    kind[ref] = names
    texts = list(known)
    piece, offset, groups = maximal_repeats(texts, np.unique(kind, return_inverse=True)[1], lows, length)
    g = np.array(groups, np.int64).reshape(-1, 4)
    many = g[:, 1] - g[:, 0] + 1
    at = _spread(g[:, 0], many)
    who, start, extent, least = piece[at], offset[at], np.repeat(g[:, 2], many), np.repeat(g[:, 3], many)
    group = np.repeat(np.arange(len(g)), many)
    if every:
        alone = np.flatnonzero(lows < highs)  # a stretch of several documents is a repeat by itself
        sizes = np.array([len(texts[k]) for k in alone.tolist()], np.int64)
        who, start, extent = np.concatenate([who, alone]), np.concatenate([start, np.zeros(len(alone), np.int64)]), np.concatenate([extent, sizes])
        group = np.concatenate([group, len(g) + np.arange(len(alone))])
        order = np.argsort(who, kind="stable")
        who, start, extent, group = who[order], start[order], extent[order], group[order]
    else:
        before = least < lows[who]
        who, start, stop = _united(who[before], start[before], start[before] + extent[before])
        extent, group = stop - start, np.zeros(len(who), np.int64)
    first = np.searchsorted(who, np.arange(len(texts) + 1))
    count = np.diff(first)[ref]
    take = _spread(first[ref], count)
    return lows[ref], count, start[take], extent[take], group[take]


def _answered(asks: DataFrame, hot: int, shards: int, chunks: int, length: int, every: bool) -> DataFrame:
    """(part, shard, packed, hot): for each stretch that a part asks about its least document, and its members of groups of maximal repeats (place, size,
    group), a stretch that several documents have among them. Without `every`, members are united that another document before the least one has, too. Names
    that parts ask for more than `hot` times get no members; they are told in rows without a part.

    The chunks of a shard are worked on one after the other, `OPEN` of them unpacked at a time."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, groups, often = int(key[0]), 0, []
        names = [np.asarray(x, np.int64) for x in rows["names"]]
        place = [_chunk(x, chunks) for x in names]
        answers: list[list[tuple]] = [[] for _ in names]
        low_chunk, end_chunk = -(-shard * chunks // shards), -(-(shard + 1) * chunks // shards)
        for lower in range(low_chunk, end_chunk, OPEN):
            upper = min(lower + OPEN, end_chunk)
            found = []
            for packed, own in zip(rows["packed"], place, strict=True):
                a, b = np.searchsorted(own, (lower, upper)).tolist()
                sizes, data, low, high = _unzip(packed, "<u2", "u1", "<i8", "<i8")
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                found.append((data[ends[a] : ends[b]].tobytes(), sizes[a:b].astype(np.int64), low[a:b].copy(), high[a:b].copy(), (a, b)))
            raw = b"".join(x[0] for x in found)
            sizes, low, high = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
            ranges = [x[4] for x in found]
            del found, data
            name, own = (np.concatenate([x[a:b] for x, (a, b) in zip(c, ranges, strict=True)]) for c in (names, place))
            begin = np.cumsum(sizes) - sizes
            value, asked = np.unique(name, return_counts=True)
            often.append(value[asked > hot])
            usual = np.flatnonzero(~_among(name, often[-1]))
            order = usual[np.argsort(own[usual], kind="stable")]
            least, count = np.full(len(name), LAST), np.zeros(len(name), np.int64)
            members = []
            edge = np.searchsorted(own[order], np.arange(lower, upper + 1)).tolist()
            for s, e in zip(edge, edge[1:], strict=False):
                if s < e:
                    k = order[s:e]
                    least[k], count[k], *member, group = _told(raw, begin[k], sizes[k], name[k], low[k], high[k], length, every)
                    members.append((*member, (shard << 32) + groups + group if every else group))
                    groups += int(group.max(initial=-1)) + 1
            start, extent, group = (np.concatenate([m[k] for m in members] or [np.zeros(0, np.int64)]) for k in range(3))
            first = np.zeros(len(name), np.int64)
            first[order] = np.cumsum(count[order]) - count[order]
            take = _spread(first, count)
            least, start, extent, group = least.astype("<i8"), start[take].astype("<u2"), extent[take].astype("<u2"), group[take].astype("<i8")
            row, member = np.cumsum([0, *(b - a for a, b in ranges)]).tolist(), np.concatenate([[0], np.cumsum(count)])
            for out, s, e in zip(answers, row, row[1:], strict=False):
                x, y = int(member[s]), int(member[e])
                out.append(tuple(c.copy() for c in (least[s:e], count[s:e].astype("<u2"), start[x:y], extent[x:y], group[x:y] if every else group[:0])))
            del raw, sizes, low, high, name, own, begin, members, least, count, start, extent, group, take, first, order, usual, member
            give_back()
        packed = [_zip(*(np.concatenate(c) for c in zip(*out, strict=True))) for out in answers]
        del answers, names, place
        give_back()
        out = pd.DataFrame({"part": rows["part"].astype("Int64"), "shard": rows["shard"], "packed": packed})
        more = pd.DataFrame({"part": pd.array([None], "Int64"), "shard": [shard], "hot": [np.concatenate(often)]})
        return pd.concat([out.assign(hot=None), more.assign(packed=None)[["part", "shard", "packed", "hot"]]]) if len(more["hot"][0]) else out.assign(hot=None)

    return asks.groupBy("shard").applyInPandas(run, "part long, shard int, packed binary, hot array<long>")


def _hot_answers(asks: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """(part, at, start, least, grp): every window of a hot name that two stretches or two documents have, `at` the stretch's place in its part's question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for b in batches:
            names, many = b.column(2).flatten().to_numpy(), np.asarray(b.column(2).value_lengths())
            found = np.split(_among(names, hot), np.cumsum(many)[:-1])
            for nth, own in enumerate(found):
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                part, shard = b.column(0)[nth].as_py(), b.column(1)[nth].as_py()
                texts, low, high = _unpacked(b.column(3)[nth].as_py())
                for s in range(0, len(at), 1000):
                    rows = [(part, shard, k, i, texts[k][i : i + length], int(low[k]), int(high[k])) for k in at[s : s + 1000].tolist() for i in range(len(texts[k]) - length + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "shard", "at", "start", "window", "low", "high"])

    cut = stored(asks.select("part", "shard", "names", "packed").mapInArrow(run, "part long, shard int, at int, start int, window binary, low long, high long"), "windows")
    least = cut.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")).where("n > 1 or least < most")
    return cut.join(least, "window").select("part", "shard", "at", "start", "least", F.xxhash64("window").alias("grp"))


def _placed(parts: DataFrame, answers: DataFrame, length: int, every: bool) -> DataFrame:
    """A part's documents with its answers: (uid, cuts: first and last place of each run of bytes to remove), or, with `every`, (id, start, size, grp)."""

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told, out = told.sort_values(["shard"], kind="stable"), []
        usual = told[told["packed"].notna()]
        opened = [_unzip(x, "<i8", "<u2", "<u2", "<u2", "<i8") for x in usual["packed"]]
        low, count, start, size, group = (np.concatenate([o[k] for o in opened]).astype(np.int64) for k in range(5))
        begin = np.concatenate([[0], np.cumsum(count)])
        base = dict(zip(usual["shard"].tolist(), np.cumsum([0, *(len(o[0]) for o in opened[:-1])]).tolist(), strict=True))
        more = told[told["packed"].isna()]
        hot_at = np.array([base[s] for s in more["shard"]], np.int64) + more["at"].to_numpy(np.int64)
        order = np.argsort(hot_at, kind="stable")
        hot_at, hot_start, hot_least, hot_group = hot_at[order], *(more[c].to_numpy(np.int64)[order] for c in ("start", "least", "grp"))
        for packed in rows["packed"]:
            uids, keys, many, which, where, extent = _unzip(packed, "<i8", "<i8", "<i4", "<i4", "<i4", "<u2")
            doc = np.repeat(np.arange(len(uids)), many)
            which, where, key = which.astype(np.int64), where.astype(np.int64), keys[doc]
            n = count[which]
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
            spans = [(np.repeat(doc, n), np.repeat(where, n) + start[take], size[take], group[take] if every else take)]
            if not every:
                later = key > low[which]  # a document before this one has the whole stretch
                spans.append((doc[later], where[later], extent[which[later]].astype(np.int64), where[later]))
            a, b = np.searchsorted(hot_at, which, "left"), np.searchsorted(hot_at, which, "right")
            n = b - a
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            fit = np.ones(len(take), bool) if every else np.repeat(key, n) > hot_least[take]
            spans.append((np.repeat(doc, n)[fit], (np.repeat(where, n) + hot_start[take])[fit], np.full(int(fit.sum()), length), hot_group[take][fit]))
            d, s, z, g = (np.concatenate([x[k] for x in spans]) for k in range(4))
            if every:
                out.append(pd.DataFrame({"id": keys[d], "start": s, "size": z, "grp": g}))
                continue
            d, s, e = _united(d, s, s + z)
            edge = np.flatnonzero(np.diff(d, prepend=-1, append=-2))
            cuts = np.stack([s, e], 1).astype("<i8")
            out.append(pd.DataFrame({"uid": uids[d[edge[:-1]]], "cuts": [cuts[x:y].tobytes() for x, y in zip(edge.tolist(), edge[1:].tolist(), strict=False)]}))
        del opened, low, count, start, size, group, begin
        give_back()
        return pd.concat(out)

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(run, "id long, start long, size long, grp long" if every else "uid long, cuts binary")


def _found(df: DataFrame, key: str, text: str, length: int, gram: int, every: bool, hot: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as `_identity` gives them; documents with shared names; what `_placed` gives)."""
    docs = _identity(df, key, text)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gram = _wider(gram, length, total)
    names = stored(_names(docs, max(2, total * 2 // (length - gram + 2) // OWNER_NAMES + 1), length, gram), "names")
    answers = stored(_answers(names.where("owner is not null").select("block", "owner", "n", "names", "twice")), "answers")
    suspects = stored(_suspects(names.where("owner is null").select("block", "seq", "id", "t", "ranks"), answers), "suspects")
    forget(names, answers)
    about = suspects.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-about * (length + 18) // CHUNK))
    shards = min(chunks, max(SHARDS, -(-chunks // SHARD_CHUNKS)))
    shared = stored(_shared_stretches(_with_known(docs, suspects, "inner"), shards, chunks, length, gram), "stretches")
    asks, parts = shared.where("shard is not null"), shared.where("shard is null").select("part", "packed")
    many = asks.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT if hot is None else hot, many // MOST_HOT)
    told = stored(_answered(asks, limit, shards, chunks, length, every), "told")
    often = told.where("part is null").select("shard", "hot").collect()  # no more than MOST_HOT names
    hot_names = np.sort(np.array([x for r in often for x in r["hot"]], np.int64))
    told = told.where("part is not null").drop("hot").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("start", "int"), ("least", "long"), ("grp", "long"))))
    if len(hot_names):
        told = told.unionByName(_hot_answers(asks.where(F.col("shard").isin([r["shard"] for r in often])), hot_names, length).withColumn("packed", F.lit(None).cast("binary")))
    return docs, suspects, _placed(parts, told, length, every)


def repeat_groups(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """(grp, key, start, size): all occurrences, in bytes, of each maximal repeat of `length` bytes or more that two places share. A repeat is
    maximal within its stretches; a passage longer than a stretch shows as several groups that overlap by `length` - 1 bytes."""
    _, _, found = _found(df, key, text, length, gram, True, hot)
    return found.select("grp", F.when(F.col("id") < LAST, F.col("id")).alias(key), "start", "size").distinct()


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """One row for each row of `df`: key, n_bytes, spans (start, size of each maximal removed run of bytes), kept (the other bytes).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller key.
    """
    docs, suspects, found = _found(df, key, text, length, gram, False, hot)
    cuts = stored(found.join(suspects.select("uid", "id", "t"), "uid").drop("uid"), "cuts")
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 1):
                ids, sizes, spans, kept = b.column(0).to_pylist(), [], [], []
                for data, c in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    own = np.frombuffer(c or b"", "<i8").reshape(-1, 2).tolist()
                    edges = [0, *(x for s in own for x in s), len(data)]
                    sizes.append(len(data))
                    spans.append([{"start": s, "size": e - s} for s, e in own])
                    kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, sizes, spans, kept), types, strict=True)], names=["id", "n_bytes", "spans", "kept"])

    out = _with_known(docs, cuts, "left").select("id", "text", "cuts").mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, size: long>>, kept binary")
    return out.select(F.when(F.col("id") < LAST, F.col("id")).alias(key), "n_bytes", "spans", "kept")


def _total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["size"])


def digests(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers and digests of `remove_repeats`: key, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(key, "n_bytes", _total(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

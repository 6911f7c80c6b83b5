"""Runs of periodic words, found by convolution of blocks.

The words of a text are numbers. At every dyadic scale the text is cut into blocks, and each block is compared with the window behind it
at all distances of that scale at once: the sum of squared differences is two sums of squares less twice a
correlation, and the correlation is a number-theoretic transform modulo a prime that the sum cannot reach. So a sum of zero is
exactly "no mismatch", without rounding. A run of period q and length 2q or more holds a whole block of its scale whose copy stands
q words further on; such distances are seeds, which are extended to both sides word by word. Seeds of a multiple of a run's period end
in the same run and give way to its smallest period.

Work that can find nothing is left out, exactly: a block with a word that does not return within the scale's distances matches
nowhere, and a block deep inside a known run of a period up to its length matches only at that run's multiples.

Texts of a batch are laid end to end, with word numbers that no two texts share. Memory: some 100 bytes for each word of a batch of
about `CHUNK` words or of the longest text; transforms take `CELLS` numbers at a time.

Defined results: a null text counts as empty; an empty text has no runs and collapses to itself; repeated keys are rows of their own; a null key is
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import only, sliced, text_of

#: The least length of a run, in words; it is also twice its period at least.
LEAST = 12
CHUNK = 40_000
CELLS = 1 << 16
#: A prime of the form c * 2**23 + 1, and a generator of its multiplicative group.
PRIME, GENERATOR = 998_244_353, 3
_P = np.uint64(PRIME)
BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % _P])
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    rows, size = a.shape
    a = a.copy()
    half = size // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        up, low = v[:, :, 0], v[:, :, 1]
        total = up + low
        low[...] = (up + (_P - low)) * _roots(half, False) % _P
        up[...] = np.minimum(total, total - _P)
        half //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of `transform`."""
    rows, size = a.shape
    a = a.copy()
    half = 1
    while half < size:
        v = a.reshape(rows, -1, 2, half)
        up, low = v[:, :, 0].copy(), v[:, :, 1] * _roots(half, True) % _P
        total, less = up + low, up + (_P - low)
        v[:, :, 0] = np.minimum(total, total - _P)
        v[:, :, 1] = np.minimum(less, less - _P)
        half *= 2
    return a * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, greatest distance): every period up to half the longest text belongs to a scale whose block
    stands whole, at a multiple of its length, among the words of a run that have a word of the run one period behind."""
    yield 4, 1, 5
    yield 2, 6, 6
    block = 4
    while 2 * block - 1 <= longest // 2:
        yield block, 2 * block - 1, 4 * block - 2
        block *= 2


def matches(x: np.ndarray, at: np.ndarray, block: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which the blocks that begin `at` come again with no mismatch."""
    reach = most - least + block
    size = 1 << (max(reach, block) - 1).bit_length()
    wide = int(((PRIME - 1) // block) ** 0.5) + 1  # differences below it: no sum of squares reaches the prime
    small = np.concatenate([x % wide, np.zeros(most + block, x.dtype)]).astype(np.uint64)
    step = max(1, CELLS // size)
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(at), step):
        here = at[s : s + step, None]
        own, behind = small[here + np.arange(block)], small[here + np.arange(least, least + reach)]
        a, b = np.zeros((len(here), size), np.uint64), np.zeros((len(here), size), np.uint64)
        a[:, :block], b[:, :reach] = own[:, ::-1], behind
        product = inverse(transform(a) * transform(b) % _P)[:, block - 1 : reach]
        squares = np.concatenate([np.zeros((len(here), 1), np.uint64), np.cumsum(behind * behind, 1)], 1)
        sums = (own * own).sum(1, keepdims=True) + squares[:, block:] - squares[:, :-block]
        i, d = np.nonzero(sums % _P == product * np.uint64(2) % _P)
        found_at.append(here[i, 0])
        found.append(d + least)
    i, d = np.concatenate(found_at), np.concatenate(found)
    inside = i + d + block <= len(x)
    return i[inside], d[inside]


def extended(x: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """First place left of i, and place behind the last one from i on, up to which x[k] equals x[k + j - i]."""
    d, step, stop = j - i, 32, i
    while stop + d < len(x):
        differ = x[stop : stop + step][: len(x) - d - stop] != x[stop + d : stop + d + step]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, step = stop + len(differ), min(2 * step, 1 << 16)
    start, step = i, 32
    while start:
        low = max(0, start - step)
        differ = x[low:start] != x[low + d : start + d]
        if differ.any():
            start = low + int(np.flatnonzero(differ)[-1]) + 1
            break
        start, step = low, min(2 * step, 1 << 16)
    return start, stop


def runs(x: np.ndarray, longest: int | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs in order of start and period. Periods are looked for up to half of `longest`."""
    n = len(x)
    if n < least:
        return []
    order = np.argsort(x, kind="stable")
    near = np.full(n, n, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    near[order[:-1][same]] = (order[1:] - order[:-1])[same]
    known: dict[tuple[int, int], int] = {}
    for block, low, high in scales(n if longest is None else longest):
        hopeful = (near[: n // block * block] <= high).reshape(-1, block).all(1)
        inner = [(s, e, q) for (s, e), q in known.items() if q <= block and e - s >= low + 2 * block]
        for s, e, _ in inner:
            hopeful[-(-s // block) : max(0, (e - high - block) // block + 1)] = False
        at = np.flatnonzero(hopeful) * block
        if not len(at):
            continue
        i, d = matches(x, at, block, low, high)
        keep = np.ones(len(i), bool)
        for s, e, q in inner:
            a, b = np.searchsorted(i, [s, e])
            keep[a:b] &= (i[a:b] + d[a:b] + block > e) | (d[a:b] % q != 0)
        i, d = i[keep], d[keep]
        order = np.lexsort((i, d))
        i, d = i[order], d[order]
        first = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] - i[:-1] != block)])[: len(i)]
        last, done = 0, 0
        for a, q in zip(i[first].tolist(), d[first].tolist(), strict=True):
            if q == last and a < done:
                continue
            s, e = extended(x, a, a + q)
            last, done = q, e
            if e - s >= max(q, least - q):
                known[s, e + q] = min(q, known.get((s, e + q), q))
    return sorted((s, e, q) for (s, e), q in known.items())


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, none shared by two texts, and where each text begins (one entry more than texts)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.int64)
    base = 0
    for words, s in zip(texts, begin.tolist(), strict=False):
        names = dict(zip(dict.fromkeys(words), range(base, base + len(words)), strict=False))
        out[s : s + len(words)] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        base += len(names)
    return out, begin


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, less those that a run has beyond its first period, joined by blanks."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e, q in found:
        gone[s + q] += 1
        gone[e] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row for each row of `df`: key, n_words, runs (start, length, period, in words), and the text collapsed to one period a run.

    `rewrite` may put other words in place of a text's own, given its key.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.list_(item), pa.binary()]

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        x, begin = numbered(texts)
        found = runs(x, max(map(len, texts)), least)
        owner = (np.searchsorted(begin, [s for s, _, _ in found], "right") - 1).tolist()
        by: dict[int, list] = {}
        for k, (s, e, q) in zip(owner, found, strict=True):
            by.setdefault(k, []).append((s - int(begin[k]), e - int(begin[k]), q))
        spans = [[{"start": s, "length": e - s, "period": q} for s, e, q in by.get(k, ())] for k in range(len(ids))]
        columns = [ids, [len(t) for t in texts], spans, [collapsed(t, by.get(k, [])) for k, t in enumerate(texts)]]
        columns = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        columns[-1] = columns[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        ids, texts, size = [], [], 0
        for whole in batches:
            for b in sliced(whole, 1, 2_000_000):
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = t.translate(BLANKS).split()
                    words = rewrite(i, words) if rewrite else words
                    ids.append(i)
                    texts.append(words)
                    size += len(words) + 1
                    if size >= CHUNK:
                        yield rows(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)

    out = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text")).mapInArrow(run, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", key)


def repeated_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in place of their own, if the hash of the key ends in 0: what the query looks into."""
    import zlib

    h = zlib.crc32(b"" if key is None else str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * (-(-(n - a) // period)))[: n - a]


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers and digests of `periodic_runs`: key, n_runs, the longest run, runs_sha256, collapsed_sha256."""
    longest = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> if(a is null or r.length > a.length, r, a))")  # the first of equals: runs are in order
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(key, "n_runs", "r.start", "r.length", "r.period", F.expr("r.length * 1000 div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Every word that precedes another is the context of a restaurant; all of them share one parent, the corpus, below which lies the uniform
distribution over the known words and one unknown. A text begins in the context of the end token.

1. Texts are cut into blocks of tokens numbered within the block (`blocks`).
2. Words are numbered for the corpus, by their bytes and never by a hash: blocks send their words to `SLICES` slices, which add up counts and send numbers back (`numbered`).
3. Blocks send each owner the (context, word) pairs of its contexts with their counts, and where they stand (`entries`). An owner is some `OWNER_TOKENS` tokens, so their
   number grows with the corpus. A context of more than `COMMON` tokens is split among all owners by the word that follows; an owner's share is merged once (`merged`).
4. Owners seat customers by Gibbs sampling (`seated`). With a gamma variable for each restaurant (s given T tables: Gamma(strength / discount + T)) the tables t of its
   dishes are independent given s: p(t) ~ S(c, t) (discount s parent)^t, S the generalised Stirling numbers. So no total is guessed and no order matters; random
   numbers follow from the numbers of context and word, so results do not depend on partitions.
5. Tables are the customers of the parent, which is seated by word slices (`parents`); then contexts are seated anew given the parent, and the
   predictive probabilities of `SAMPLES` seatings are averaged (`scored`).

Restaurants that are split among owners follow the same rule: all that a sweep takes from other dishes is the restaurant's total, and after each sweep the totals of shares
are added up (`total_of`). So scores do not hang on `COMMON`. For dishes of more than `EXACT` customers
the conditional is taken from its limit (`opened_by_many`; at `EXACT` customers means differ by less than 2 %). Discounts are n1 / (n1 + 2 n2), n1 and n2 the
dishes of one and of two customers, over the whole corpus; strengths are constants.

Defined results: null text counts as empty, which is the one end token; repeated keys are rows of their own; with no
training text every score rests on the uniform distribution; an empty table gives no rows; other columns are not read. A text's tokens are held in memory at once.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import forget, mix64, remainder, stored, text_of, word_lists

DISCOUNT, STRENGTH = (0.5, 0.75), (10.0, 1.0)  # corpus, one word; discounts only until they are estimated
BURN_IN, SAMPLES, EXACT = 2, 2, 200
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 50_000
OWNER_TOKENS, COMMON, SLICES = 2_000_000, 200_000, 512
_BLANKS = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
_codec = pa.Codec("zstd", compression_level=1)


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of their bytes."""
    x = np.ascontiguousarray(x, "<i8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + _codec.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_codec.decompress(data[9:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(n)


def squeezed(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + _codec.compress(data, asbytes=True)


def loosened(data: bytes) -> bytes:
    return _codec.decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True)


class _Numbers(dict):
    """Numbers words from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def blocks(read: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each block of texts of `read` (id, text, held): its documents, words by falling frequency (0 is the end token), their training counts, and its tokens."""
    names = ["block", "ids", "nulls", "held", "lengths", "words", "counts", "tokens"]

    def pack(block: int, ids: list, held: list, parts: list[np.ndarray], lengths: list[int], numbers: _Numbers) -> pa.RecordBatch:
        tokens, length = np.concatenate(parts), np.array(lengths)
        uses = np.bincount(tokens, minlength=len(numbers) + 1)
        order = np.concatenate([[0], 1 + np.argsort(-uses[1:], kind="stable")])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        train = np.bincount(tokens[np.repeat(~np.array(held), length)], minlength=len(order))
        words = list(numbers)
        row = (
            block, np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array(held, np.uint8).tobytes(),
            packed(length), squeezed(b" ".join([words[k - 1] for k in order[1:].tolist()])), packed(train[order]), packed(rank[tokens]),
        )
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(row)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, end = TaskContext.get().partitionId() << 24, np.zeros(1, np.int32)
        ids, held, parts, lengths, numbers, size = [], [], [], [], _Numbers(), 0
        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), (v.as_py() for v in b.column(1)), b.column(2).to_pylist(), strict=True):
                n = 1
                for words in word_lists(t.encode("utf-8", "surrogatepass").lower(), _BLANKS):
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                parts.append(end)
                ids.append(i)
                held.append(h)
                lengths.append(n)
                size += n
                if size >= block_tokens or len(ids) >= BLOCK_DOCS:
                    yield pack(block, ids, held, parts, lengths, numbers)
                    block, ids, held, parts, lengths, numbers, size = block + 1, [], [], [], [], _Numbers(), 0
        if ids:
            yield pack(block, ids, held, parts, lengths, numbers)

    return read.mapInArrow(run, "block long, ids binary, nulls binary, held binary, lengths binary, words binary, counts binary, tokens binary")


def numbered(cut: DataFrame) -> DataFrame:
    """For each block and slice: where words stand in the block's list, their numbers in the corpus and their training counts.

    Block -1 has sums instead: training tokens, distinct ones, those of one and of two uses. A number is rank * SLICES + slice, ranks by falling count, then bytes.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, joined, counts = b.column(0)[k].as_py(), loosened(b.column(1)[k].as_py()), unpacked(b.column(2)[k].as_py())
                words = [b"", *joined.split(b" ")] if joined else [b""]
                slice_ = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % SLICES
                order = np.argsort(slice_, kind="stable")
                at = np.searchsorted(slice_[order], np.arange(SLICES + 1))
                some = [(s, order[at[s] : at[s + 1]]) for s in np.flatnonzero(np.diff(at)).tolist()]
                columns = zip(*((s, block, packed(o), squeezed(b" ".join([words[x] for x in o.tolist()])), packed(counts[o])) for s, o in some), strict=True)
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["slice", "block", "at", "words", "counts"])

    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen, places = _Numbers(), []
        for joined in rows["words"]:
            words = loosened(joined).split(b" ")  # an empty one is the end token
            places.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) - 1)
        counts = np.zeros(len(seen), np.int64)
        for p, c in zip(places, rows["counts"], strict=True):
            counts[p] += unpacked(c)
        names = list(seen)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))] = np.arange(len(names))
        sums = np.array([counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()])
        out = [(b, at, packed(rank[p] * SLICES + key[0]), packed(counts[p])) for b, at, p in zip(rows["block"], rows["at"], places, strict=True)]
        return pd.DataFrame([*out, (-1, b"", b"", packed(sums))], columns=["block", "at", "numbers", "counts"])

    dealt = cut.select("block", "words", "counts").mapInArrow(deal, "slice int, block long, at binary, words binary, counts binary")
    return dealt.groupBy("slice").applyInPandas(number, "block long, at binary, numbers binary, counts binary")


def runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start, and how long they are, given where new ones begin."""
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


_ENTRY = "kind int, owner int, block long, context binary, total binary, run binary, word binary, count binary, uses binary, docs binary, times binary"


def dishes_row(context: np.ndarray, total: np.ndarray, word: np.ndarray, count: np.ndarray) -> dict[str, bytes]:
    """Dishes in order of contexts and words, packed as `Dishes` reads them."""
    start, run = runs(changes(context))
    step = np.diff(word, prepend=0)
    step[start] = word[start]
    return {"context": packed(np.diff(context[start], prepend=0)), "total": packed(total[start]), "run": packed(run), "word": packed(step), "count": packed(count)}


def entries(cut: DataFrame, dictionary: DataFrame, n_owners: int, common: int = COMMON) -> DataFrame:
    """Rows of four kinds: 0, a block's documents with what follows from counts alone; 1, an owner's pairs in a block, of contexts that it holds whole; 3, its shares of the others; 2, both with the documents they stand in."""
    names = ["kind", "owner", "block", "context", "total", "run", "word", "count", "uses", "docs", "times"]

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        row, token = left.iloc[0], unpacked(left["tokens"].iloc[0]).astype(np.int32)
        length, held = unpacked(row["lengths"]), np.frombuffer(row["held"], np.uint8) > 0
        number, count = np.zeros((2, sum(struct.unpack_from("<Q", x)[0] for x in right["at"])), np.int64)
        for at, n, c in zip(right["at"], right["numbers"], right["counts"], strict=True):
            at = unpacked(at)
            number[at], count[at] = unpacked(n), unpacked(c)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        doc, many = np.repeat(np.arange(len(length), dtype=np.int32), length), len(number)
        known, base = np.add.reduceat((count > 0)[token].astype(np.int64), first), np.add.reduceat(np.log10(count + 0.5)[token], first)
        out = [dict.fromkeys(names) | {"kind": 0, "owner": -1, "block": row["block"], "context": row["ids"], "total": row["nulls"], "run": row["held"], "word": row["lengths"], "count": packed(known), "docs": base.astype("<f8").tobytes()}]
        before = np.concatenate([np.zeros(1, np.int32), token[:-1]])  # a text ends with the end token, so the next one begins after it
        mixed = mix64(number.astype(np.uint64))
        with np.errstate(over="ignore"):
            split = mix64(mixed[before] + number[token].astype(np.uint64))
        alone = count[before] <= common
        split[alone] = mixed[before[alone]]
        split %= np.uint64(n_owners)
        owner = split.astype(np.int32)
        del split, alone
        rank = np.empty(many, np.int64)
        rank[np.argsort(number)] = np.arange(many)
        key = owner.astype(np.int64)
        for x in (before, token):
            key *= many
            key += rank[x]
        order = np.argsort(key, kind="stable")
        key, doc, train = key[order], doc[order], ~held[doc[order]]
        new = changes(key)
        pair, _ = runs(new)
        place, times = runs(new | changes(doc))
        c, uses = np.add.reduceat(train.astype(np.int64), pair), np.diff(np.append(np.searchsorted(place, pair), len(place)))
        where = order[pair]
        owner, v, w = owner[where], before[where], token[where]
        del key, new, order, train, before, token, where, pair  # a block's tokens are many
        at = np.searchsorted(owner, np.arange(n_owners + 1))
        place_at = np.concatenate([[0], np.cumsum(uses)])
        for o in np.flatnonzero(np.diff(at)).tolist():
            s, e = at[o], at[o + 1]
            head = {"owner": o, "block": row["block"]}
            same = head | dishes_row(number[v[s:e]], count[v[s:e]], number[w[s:e]], c[s:e])
            p, q = place_at[s], place_at[e]
            shared = count[v[s:e]] > common
            if not shared.any():
                out.append(dict.fromkeys(names) | same | {"kind": 1})
            else:
                for kind, some in ((1, np.flatnonzero(~shared) + s), (3, np.flatnonzero(shared) + s)):
                    if len(some):
                        out.append(dict.fromkeys(names) | head | dishes_row(number[v[some]], count[v[some]], number[w[some]], c[some]) | {"kind": kind})
            out.append(dict.fromkeys(names) | same | {"kind": 2, "uses": packed(uses[s:e]), "docs": packed(doc[place[p:q]]), "times": packed(times[p:q])})
        return pd.DataFrame(out, columns=names)

    return cut.select("block", "ids", "nulls", "held", "lengths", "tokens").groupBy("block").cogroup(dictionary.where("block >= 0").groupBy("block")).applyInPandas(pairs, _ENTRY)


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 that follow from a key."""
    with np.errstate(over="ignore"):
        return ((mix64(key + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variates of shapes of 1 or more, by Marsaglia and Tsang's rejection, following from their keys."""
    out, todo, draw = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(todo):
        d = shape[todo] - 1 / 3
        u, angle, accept = (uniform(key[todo], draw + k) for k in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * angle)
        v = np.maximum(1 + x / np.sqrt(9 * d), 1e-12) ** 3
        good = np.log(accept) < 0.5 * x * x + d - d * v + d * np.log(v)
        out[todo[good]] = (d * v)[good]
        todo, draw = todo[~good], draw + 3
    return out


_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) for c, t up to `EXACT`."""
    if discount not in _stirling:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0.0
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                s[c + 1, t] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - t * discount, 0)))
        _stirling[discount] = s
    return _stirling[discount]


def opened(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables t of dishes with c customers, drawn from p(t) ~ S(c, t) weight^t."""
    out, stirling, u = np.minimum(customers, 1), log_stirling(discount), uniform(key, 0)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    start, many = runs(changes(customers[few]))
    for s, n in zip(start.tolist(), many.tolist(), strict=True):
        c = int(customers[few[s]])
        t = np.arange(1, c + 1)
        step = max(1, 500_000 // c)
        for k in range(s, s + n, step):
            at = few[k : min(k + step, s + n)]
            log = stirling[c, 1 : c + 1] + t * np.log(weight[at])[:, None]
            p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (p < u[at, None] * p[:, -1:]).sum(axis=1)
    for k in np.flatnonzero(customers > EXACT).tolist():
        out[k] = opened_by_many(int(customers[k]), float(weight[k]), discount, float(u[k]))
    return out


_sums_of: dict[float, tuple[np.ndarray, ...]] = {}


def log_sum(customers: int, tables: np.ndarray, discount: float) -> np.ndarray:
    """log P(t draws of Sibuya's law add up to c) for many c: the saddle-point density, corrected by what the saddle point misses of the stable law that such sums tend to."""
    d = discount
    if d not in _sums_of:
        # Sibuya's law has the generating function 1 - (1 - z)^d; y = 1 - z at the saddle point of mean r
        y = np.exp(np.concatenate([np.linspace(-60 / (1 - d), -1, 4000), np.linspace(-1, -1e-6, 2000)[1:]]))
        f = -np.expm1(d * np.log(y))
        r = (1 - y) * d * y ** (d - 1) / f
        variance = r + (1 - y) ** 2 * d * (1 - d) * y ** (d - 2) / f - r * r
        # Zolotarev's integral for the stable density at x, against its saddle point
        u = np.concatenate([np.linspace(1e-6, np.pi / 2, 3000), np.pi - np.geomspace(np.pi / 2, 1e-9, 6000)[1:]])
        log_a = (d * np.log(np.sin(d * u)) + (1 - d) * np.log(np.sin((1 - d) * u)) - np.log(np.sin(u))) / (1 - d)
        log_x, width, miss = np.linspace(-np.log(60) * (1 - d) / d - 1, 6 / d, 400), np.log(np.gradient(u)), []
        for x in log_x:
            log = log_a - np.exp(np.minimum(log_a - x * d / (1 - d), 700)) + width
            density = log.max() + np.log(np.exp(log - log.max()).sum()) - x / (1 - d) + np.log(d / (1 - d) / np.pi)
            log_s = (np.log(d) - x) / (1 - d)
            miss.append(density - (np.exp(log_s + x) - np.exp(d * log_s) - 0.5 * np.log(2 * np.pi * d * (1 - d)) - 0.5 * (d - 2) * log_s))
        _sums_of[d] = np.log(r)[::-1], np.log(f)[::-1], -np.log1p(-y)[::-1], np.log(np.maximum(variance, 1e-300))[::-1], log_x, np.array(miss)
    at, log_f, minus_log_z, log_variance, log_x, miss = _sums_of[d]
    log_r = np.log(customers / tables)
    fold = tables * np.interp(log_r, at, log_f) + customers * np.exp(np.interp(log_r, at, np.log(minus_log_z)))
    return fold - 0.5 * (np.log(2 * np.pi * tables) + np.interp(log_r, at, log_variance)) + np.interp(math.log(customers) - np.log(tables) / d, log_x, miss)


def opened_by_many(customers: int, weight: float, discount: float, u: float) -> int:
    """Tables t of a dish with many customers c. S(c, t) weight^t is, up to a constant, the Poisson probability of t at weight / discount times
    the probability that t draws of Sibuya's law add up to c; beyond 4096 values t is drawn from as many ranges."""
    rate = weight / discount
    most = int(min(customers - 1, rate + 12 * math.sqrt(rate) + 30))
    t = np.unique(np.linspace(1, most, min(most, 4096)).astype(np.int64))
    size = np.diff(np.append(t, most + 1))
    log = t * math.log(rate) - _log_factorial(t) + log_sum(customers, t, discount) + np.log(size)
    p = np.cumsum(np.exp(log - log.max()))
    k = int(np.searchsorted(p, u * p[-1]))
    before = p[k - 1] if k else 0.0
    return int(t[k] + min(size[k] - 1, int(size[k] * (u * p[-1] - before) / max(p[k] - before, 1e-300))))


def _log_factorial(t: np.ndarray) -> np.ndarray:
    """log t! by Stirling's series, from 1."""
    return t * np.log(t) - t + 0.5 * np.log(2 * np.pi * t) + 1 / (12 * t) - 1 / (360 * t**3.0) + 1 / (1260 * t**5.0)


class Dishes:
    """An owner's dishes, merged from the rows of blocks.

    `known` has the contexts of more than `common` tokens, in order, and their tables over all owners after 0, 1, ... sweeps; without it the owner holds all contexts whole."""

    def __init__(self, rows: pd.DataFrame, common: int = COMMON, known: tuple[np.ndarray, list[np.ndarray]] | None = None):
        contexts, totals, words, counts = [], [], [], []
        for r in rows[["context", "total", "run", "word", "count"]].itertuples(index=False):
            run, step = unpacked(r.run), unpacked(r.word)
            contexts.append(np.repeat(np.cumsum(unpacked(r.context)), run))
            totals.append(np.repeat(unpacked(r.total), run))
            sums, start = np.cumsum(step), np.concatenate([[0], np.cumsum(run)[:-1]])
            words.append(sums - np.repeat(sums[start] - step[start], run))
            counts.append(unpacked(r.count))
        context, total, word, count = (np.concatenate(x) for x in (contexts, totals, words, counts))
        self.contexts, first, v = np.unique(context, return_index=True, return_inverse=True)
        self.totals = total[first]
        self.words, w = np.unique(word, return_inverse=True)
        pair, self.at = np.unique(v * len(self.words) + w, return_inverse=True)  # at: the dish of each pair of each row
        self.v, self.w = np.divmod(pair, len(self.words))
        self.c = np.bincount(self.at, count, len(pair)).astype(np.int64)
        self.common = (self.totals > common) & (known is not None)  # contexts that other owners hold, too
        self.known = [x[np.searchsorted(known[0], self.contexts[self.common])] for x in known[1]] if known else []
        with np.errstate(over="ignore"):
            self.key = mix64(mix64(self.contexts.astype(np.uint64))[self.v] + self.words[self.w].astype(np.uint64))

    def drawn(self, parent: np.ndarray, tables: np.ndarray, discount: float, sweep: int) -> np.ndarray:
        """Tables of every dish, given the restaurants' tables so far and the parent's probabilities."""
        with np.errstate(over="ignore"):
            s = gamma(STRENGTH[1] / discount + tables, mix64(self.contexts.astype(np.uint64) + np.uint64(sweep << 48)))
            return opened(self.c, discount * s[self.v] * parent[self.w], discount, self.key + np.uint64(sweep))

    def whole(self, t: np.ndarray, sweeps: int) -> np.ndarray:
        """Tables of every restaurant after so many sweeps, those of other owners among them."""
        out = np.bincount(self.v, t, len(self.contexts))
        if self.common.any():
            out[self.common] = self.known[sweeps]
        return out

    def swept(self, parent: np.ndarray, discount: float, first: int) -> Iterator[np.ndarray]:
        """The seatings after each sweep."""
        t = np.minimum(self.c, 1)
        for k in range(BURN_IN + SAMPLES):
            t = self.drawn(parent, self.whole(t, k), discount, first + k)
            yield t

    def begun(self, vocabulary: int) -> np.ndarray:
        """The parent's probabilities before it is seated: by rank, as Zipf has them."""
        harmonic = np.log(max(vocabulary / SLICES, 1)) + 1
        return 1 / ((self.words // SLICES + 1) * SLICES * harmonic)

    def split(self, vocabulary: int) -> np.ndarray:
        """Tables that are seated apart from the sweeps: none, since contexts in parts are swept like all others."""
        return np.zeros(len(self.c), np.int64)


def merged(parts: DataFrame, n_owners: int) -> DataFrame:
    """One row for each owner that has shares of contexts: all of them, merged from the rows of blocks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = Dishes(rows)
        row = dict.fromkeys(rows.columns) | {"kind": 3, "owner": key[0], "block": -1} | dishes_row(d.contexts[d.v], d.totals[d.v], d.words[d.w], d.c)
        return pd.DataFrame([row], columns=rows.columns)

    return parts.repartition(n_owners, "owner").groupBy("owner").applyInPandas(run, _ENTRY)


def total_at_first(shares: DataFrame) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """The contexts held in shares, of which a corpus has one in `COMMON` tokens at most, and their tables before any sweep, one a dish."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(len(rows)):
                d = Dishes(rows.iloc[k : k + 1])
                yield pd.DataFrame({"context": d.contexts, "tables": np.bincount(d.v, np.minimum(d.c, 1), len(d.contexts)).astype(np.int64)})

    found = sorted(map(tuple, shares.mapInPandas(run, "context long, tables long").groupBy("context").agg(F.sum("tables")).collect()))
    return (np.array([f[0] for f in found]), [np.array([f[1] for f in found])]) if found else None


def total_of(shares: DataFrame, known: tuple[np.ndarray, list[np.ndarray]], vocabulary: int, discount: float, first: int, common: int) -> np.ndarray:
    """Tables of the contexts held in shares after one more sweep than `known` has. Shares have the parent's probabilities, or start from `begun`."""
    ids, so_far = known[0], len(known[1]) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(ids), np.int64)
        for rows in batches:
            for k in range(len(rows)):
                d = Dishes(rows.iloc[k : k + 1], common, known)
                parent = np.frombuffer(rows["parent"].iloc[k], "<f8") if "parent" in rows else d.begun(vocabulary)
                t = d.drawn(parent, d.whole(d.c, so_far), discount, first + so_far)
                out[np.searchsorted(ids, d.contexts)] += np.bincount(d.v, t, len(d.contexts)).astype(np.int64)
        yield pd.DataFrame({"context": ids, "tables": out})

    found = dict(map(tuple, shares.mapInPandas(run, "context long, tables long").groupBy("context").agg(F.sum("tables")).collect()))
    return np.array([found[i] for i in ids.tolist()])


_SHARED = "slice int, kind int, owner int, numbers binary, values binary"


def seated(sent: DataFrame, n_owners: int, vocabulary: int, common: int = COMMON, known: tuple[np.ndarray, list[np.ndarray]] | None = None) -> DataFrame:
    """What owners tell the slices: 0, tables by word; and as kind 2 the dishes of one and of two customers."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dishes = Dishes(rows, common, known)
        *_, t = (x for _, x in zip(range(BURN_IN), dishes.swept(dishes.begun(vocabulary), DISCOUNT[1], 1), strict=False))
        order = np.argsort(dishes.words % SLICES, kind="stable")
        numbers, values = dishes.words[order], np.bincount(dishes.w, t, len(dishes.words))[order]
        at = np.searchsorted(numbers % SLICES, np.arange(SLICES + 1))
        out = [(0, 2, key[0], b"", packed(np.array([(dishes.c == 1).sum(), (dishes.c == 2).sum()])))]
        out += [(s, 0, key[0], packed(np.diff(numbers[at[s] : at[s + 1]], prepend=0)), packed(values[at[s] : at[s + 1]])) for s in np.flatnonzero(np.diff(at)).tolist()]
        return pd.DataFrame(out, columns=["slice", "kind", "owner", "numbers", "values"])

    return sent.repartition(n_owners, "owner").groupBy("owner").applyInPandas(run, _SHARED)


def parents(told: DataFrame, vocabulary: int, discount: float) -> DataFrame:
    """What slices tell the owners that asked: customers and tables of each word in the corpus; and sums as owner -1."""
    base, s = 1 / (vocabulary + 1), STRENGTH[0] / discount + vocabulary / 2

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers, values = [np.cumsum(unpacked(x)) for x in rows["numbers"]], [unpacked(x) for x in rows["values"]]
        found, at = np.unique(np.concatenate(numbers), return_inverse=True)
        c, cuts = np.bincount(at, np.concatenate(values), len(found)).astype(np.int64), np.cumsum([len(n) for n in numbers])[:-1]
        t = opened(c, np.full(len(c), discount * s * base), discount, mix64(found.astype(np.uint64)))
        out = [(-1, 0, b"", packed(np.array([c.sum(), t.sum()])), b"")]
        for owner, n, k in zip(rows["owner"], rows["numbers"], np.split(at, cuts), strict=True):
            out.append((owner, 0, n, packed(c[k]), packed(t[k])))
        return pd.DataFrame(out, columns=["owner", "kind", "numbers", "customers", "tables"])

    return told.where("kind < 2").groupBy("slice").applyInPandas(run, "owner int, kind int, numbers binary, customers binary, tables binary")


def looked_up(rows: pd.DataFrame, kind: int, column: str, numbers: np.ndarray) -> np.ndarray:
    """Values that slices sent, in the order of `numbers`; 0 where they sent none."""
    some = rows[rows["kind"] == kind]
    if some.empty:
        return np.zeros(len(numbers), np.int64)
    found = np.concatenate([np.cumsum(unpacked(x)) for x in some["numbers"]])
    values = np.concatenate([unpacked(x) for x in some[column]])
    order = np.argsort(found)
    at = np.minimum(np.searchsorted(found[order], numbers), len(found) - 1)
    return np.where(found[order][at] == numbers, values[order][at], 0)


def parent_of(words: np.ndarray, told: pd.DataFrame, vocabulary: int, sums: tuple[int, int], discount: float) -> np.ndarray:
    """The probabilities of words in the corpus restaurant."""
    customers, tables = looked_up(told, 0, "customers", words), looked_up(told, 0, "tables", words)
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH[0] + discount * sums[1]) / (vocabulary + 1)) / (STRENGTH[0] + sums[0])


def with_parent(shares: DataFrame, told: DataFrame, n_owners: int, vocabulary: int, sums: tuple[int, int], discount: float) -> DataFrame:
    """Shares of contexts with the parent's probabilities of their words."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return left.assign(parent=[parent_of(Dishes(left).words, right, vocabulary, sums, discount).astype("<f8").tobytes()] if len(left) else [])

    both = shares.repartition(n_owners, "owner").groupBy("owner").cogroup(told.where("owner >= 0").repartition(n_owners, "owner").groupBy("owner"))
    return both.applyInPandas(run, _ENTRY + ", parent binary")


def predictive(dishes: Dishes, told: pd.DataFrame, vocabulary: int, sums: tuple[int, int], discounts: tuple[float, float]) -> np.ndarray:
    """The averaged predictive probability of each dish."""
    parent = parent_of(dishes.words, told, vocabulary, sums, discounts[0])
    mean = np.zeros(len(dishes.c))
    for k, t in enumerate(dishes.swept(parent, discounts[1], 1 + BURN_IN + SAMPLES)):
        if k >= BURN_IN:
            mean += np.maximum(dishes.c - discounts[1] * t, 0) + (STRENGTH[1] + discounts[1] * dishes.whole(t, k + 1)[dishes.v]) * parent[dishes.w]
    return mean / SAMPLES / (STRENGTH[1] + dishes.totals[dishes.v])


def scored(sent: DataFrame, told: DataFrame, n_owners: int, vocabulary: int, sums: tuple[int, int], discounts: tuple[float, float], common: int = COMMON, known: tuple[np.ndarray, list[np.ndarray]] | None = None) -> DataFrame:
    """For each owner and block, the sums of log10 probabilities over each document's tokens."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["block", "docs", "score"])
        left = left.sort_values("block")
        dishes = Dishes(left, common, known)
        log = np.log10(predictive(dishes, right, vocabulary, sums, discounts))[dishes.at]
        out, at = [], 0
        for r in left.itertuples(index=False):
            uses, doc = unpacked(r.uses), unpacked(r.docs)
            total = np.bincount(doc, np.repeat(log[at : at + len(uses)], uses) * unpacked(r.times))
            docs = np.flatnonzero(np.bincount(doc))
            out.append((r.block, packed(docs), total[docs].astype("<f8").tobytes()))
            at += len(uses)
        return pd.DataFrame(out, columns=["block", "docs", "score"])

    both = sent.repartition(n_owners, "owner").groupBy("owner").cogroup(told.where("owner >= 0").repartition(n_owners, "owner").groupBy("owner"))
    return both.applyInPandas(run, "block long, docs binary, score binary")


def summed(about: DataFrame, parts: DataFrame, n_train: int, vocabulary: int) -> DataFrame:
    """A row for each document of every block."""
    per_token = float(np.log10(n_train + 0.5 * (vocabulary + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        r = left.iloc[0]
        length, score = unpacked(r["word"]), np.zeros(len(r["total"]))
        for docs, x in sorted(zip(right["docs"], right["score"], strict=True)):
            score[unpacked(docs)] += np.frombuffer(x, "<f8")
        ids = pd.Series(np.frombuffer(r["context"], "<i8"), dtype="Int64").mask(np.frombuffer(r["total"], np.uint8) > 0)
        return pd.DataFrame(dict(zip(names, (ids, np.frombuffer(r["run"], np.uint8) > 0, length, unpacked(r["count"]), int(n_train), np.frombuffer(r["docs"], "<f8") - length * per_token, score), strict=True)))

    both = about.groupBy("block").cogroup(parts.groupBy("block"))
    return both.applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def estimated(one: int, two: int, otherwise: float) -> float:
    """The discount n1 / (n1 + 2 n2), kept away from 0 and 1."""
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one and two else otherwise


def _sums(table: DataFrame, column: str, n: int) -> list[int]:
    """Element-wise sums of packed arrays of `n` numbers, of which there is one for each slice or owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += unpacked(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total, pa.int64())], names=["k", "x"])

    found = {r["k"]: r["x"] for r in table.select(column).mapInArrow(run, "k int, x long").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    return [found.get(k, 0) for k in range(n)]


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, block_tokens: int = BLOCK_TOKENS, owner_tokens: int = OWNER_TOKENS, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from rows that are not held out.

    A row is held out when crc32 of its key as text, modulo `folds`, is `held`. Perplexity is 10 ** (-score / n_tokens).
    """
    read = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text"), (remainder(df, folds, key) == held).alias("held"))
    cut = stored(blocks(read, block_tokens), "blocks")
    dictionary = stored(numbered(cut), "dictionary")
    n_train, vocabulary, one, two = _sums(dictionary.where("block < 0"), "counts", 4)
    n_owners = 1 + n_train // owner_tokens
    sent = stored(entries(cut, dictionary, n_owners, common), "entries", "kind")
    forget(cut, dictionary)
    of_kind = lambda k: sent.where(F.col("kind") == k)
    shares = stored(merged(of_kind(3), n_owners), "shares")
    known = total_at_first(shares)
    for _ in range(BURN_IN - 1 if known else 0):
        known[1].append(total_of(shares, known, vocabulary, DISCOUNT[1], 1, common))
    told = stored(seated(of_kind(1).unionByName(shares), n_owners, vocabulary, common, known), "tables")
    discounts = estimated(one, two, DISCOUNT[0]), estimated(*_sums(told.where("kind = 2"), "values", 2), DISCOUNT[1])
    back = stored(parents(told, vocabulary, discounts[0]), "parents")
    forget(told)
    sums = tuple(_sums(back.where("owner < 0"), "customers", 2))
    if known:
        priced = stored(with_parent(shares, back, n_owners, vocabulary, sums, discounts[0]), "priced")
        known = known[0], known[1][:1]
        for _ in range(BURN_IN + SAMPLES):
            known[1].append(total_of(priced, known, vocabulary, discounts[1], 1 + BURN_IN + SAMPLES, common))
        forget(priced)
    forget(shares)
    return summed(of_kind(0), scored(of_kind(2), back, n_owners, vocabulary, sums, discounts, common, known), n_train, vocabulary)

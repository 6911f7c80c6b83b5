"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

The last token of the encoding of every prefix of a piece is unique, and follows from earlier ones: it is the one
vocabulary suffix t of the prefix for which (last token of the prefix before t, t) can stand side by side. Whether
two tokens can is decided by their spines: no merge across the boundary may fire while both units exist. So
a state of the transducer is the set of live starts, each a node of the vocabulary trie with the last token
before it; a byte leads to one next state and names one last token. States and moves are made when first met.
Tokens are settled, and emitted, once every live start shares them; live starts lie within one
vocabulary entry's length, which bounds the lookahead.

Decoding joins token bytes and holds back the bytes of an unfinished character only (at most three).

Defined results: null text counts as empty, which has no tokens (the digests are of no bytes); repeated
rows are rows of their own; an empty table gives no rows; other columns are not read. Memory: bounded memories of chunks and moves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import LearntChunks, memory, only, text_of, tokenizer_file

#: White space as the pattern's engine has it (fixed values: Unicode's White_Space).
_WS = "\t-\r \x85\xa0  -     　"
#: Runs whose pieces never reach beyond them.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The pattern of the vocabulary's makers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_MOVES = 2_000_000
_FOREVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one piece (bytes) into token ids by ranks alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._state(((0, -1, 0),))

    def _state(self, live: tuple) -> int:
        n = self.number.get(live)
        if n is None:
            n = self.number[live] = len(self.states)
            self.states.append(live)
        return n

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte; (-1, -1) if merges never make it."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            units = [whole[i : i + 1] for i in range(len(whole))]
            while len(units) > 2:
                found = min(((r, i) for i in range(len(units) - 1) if (r := self.ranks.get(units[i] + units[i + 1], token)) < token), default=None)
                if found is None:
                    break
                i = found[1]
                units[i : i + 2] = [units[i] + units[i + 1]]
            self.halves[token] = None if len(units) == 1 else (self.ranks[units[0]], self.ranks[units[1]]) if len(units) == 2 and all(u in self.ranks for u in units) else (-1, -1)
        return self.halves[token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Units that stand at the token's right (side 1) or left (0) edge while merges run, each with the rank of the merge that ends it."""
        memo = self.right if side else self.left
        if token not in memo:
            out, unit, until = [], token, _FOREVER
            while True:
                out.append((unit, until))
                half = self._halves(unit)
                if half is None or half[0] < 0:
                    break
                unit, until = half[side], unit
            memo[token] = out
        return memo[token]

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes together is [a, b]."""
        known = self.pairs.get((a, b))
        if known is None:
            known = True
            for x, x_ends in self._spine(a, 1):
                for y, y_ends in self._spine(b, 0):
                    merged = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                    # of merges of one rank the left one goes first: x's own end comes before, y's own end after
                    if merged is not None and merged < x_ends and merged <= y_ends and max(x, y) < min(x_ends, y_ends):
                        known = False
            self.pairs[(a, b)] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        live, last = [], -1
        for node, before, age in self.states[state]:
            nxt = self.trie[node].get(byte)
            if nxt is None:
                continue
            live.append((nxt, before, age + 1))
            t = self.token_at[nxt]
            if last < 0 and t >= 0 and self._halves(t) != (-1, -1) and (before < 0 or self.beside(before, t)):
                last = t
        move = self._state((*live, (0, last, 0))), last
        self.moves[state << 8 | byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else [t for some in self.encode_stream((piece,)) for t in some]

    def encode_stream(self, data: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of one piece that comes in parts, in lists, each settled before the piece's end is seen."""
        if len(self.moves) > CACHED_MOVES:
            self._reset()
        state, lasts, moves, size = self.start, [], self.moves, self.bytes_of
        for part in data:
            for byte in part:
                move = moves.get(state << 8 | byte)
                state, last = move if move is not None else self._move(state, byte)
                lasts.append(last)
            if len(lasts) > 512:
                n = self._settled(state, lasts)
                if n:
                    yield self._back(lasts, n)
                    del lasts[:n]
        yield self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def _settled(self, state: int, lasts: list[int]) -> int:
        """The furthest place that the chains of all live starts pass."""
        common: set[int] | None = None
        for _, _, age in self.states[state]:
            at, chain = len(lasts) - age, set()
            while at > 0:
                chain.add(at)
                at -= len(self.bytes_of[lasts[at - 1]])
            common = chain if common is None else common & chain
        return max(common or {0})


class Utf8Stream:
    """Incremental UTF-8: `feed` returns the bytes up to the last whole character and keeps the rest."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> bytes:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(4, cut + 1)):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue  # a continuation: its leader lies further back
            need = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            if need > back:
                cut -= back
            break
        self.pending = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        rest, self.pending = self.pending, b""
        return rest


class ByteBpe:
    """Encoder and decoder over a file of ranks; pieces are matches of `pattern`, each encoded by itself."""

    def __init__(self, path: str, pattern: str = PATTERN):
        if pattern != PATTERN:
            raise ValueError("texts are cut into chunks that fit the default pattern only")
        import regex

        self.pieces = regex.compile(pattern).findall
        self.fst = Transducer(read_ranks(path))
        self.known = LearntChunks(self.learn, 600_000, 200_000)
        self.tokens = [self.fst.bytes_of.get(i, b"") for i in range(max(self.fst.bytes_of, default=0) + 1)]

    def learn(self, chunk: str) -> bytes:
        ids = array("I")
        for p in self.pieces(chunk):
            ids.extend(self.fst.encode(p.encode("utf-8", "surrogatepass")))
        return ids.tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.known.trim()
        get = self.known.__getitem__
        return [b"".join(map(get, _CHUNK.findall(t))) for t in texts]

    def decode_stream(self, ids: Iterable[list[int]]) -> Iterator[bytes]:
        """Bytes of whole characters, as soon as they are whole."""
        machine, get = Utf8Stream(), self.tokens.__getitem__
        for some in ids:
            yield machine.feed(b"".join(map(get, some)))
        yield machine.finish()


_encoders: dict[tuple[str, str], ByteBpe] = memory()


def encoder(path: str, pattern: str = PATTERN) -> ByteBpe:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteBpe(path, pattern)
    return _encoders[path, pattern]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked for."""
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_encoders)
        bpe = encoder(path, pattern)
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                rows = []
                for i, data in zip(b.column(0).to_pylist(), bpe.encode_batch(b.column(1).to_pylist()), strict=True):
                    ids = array("I")
                    ids.frombytes(data)
                    digest = hashlib.sha256()
                    for part in bpe.decode_stream(ids[j : j + 8192] for j in range(0, len(ids), 8192)):
                        digest.update(part)
                    rows.append((i, len(ids), hashlib.sha256(data).hexdigest(), digest.hexdigest(), *([list(ids)] * with_ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(df[key].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(run, schema)

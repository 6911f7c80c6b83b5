"""Best-fit packing of token sequences: bounded-space online best-fit.

A fixed number of bins is open at once. A bitset over free space, with a stack of bins under each bit, finds the
fullest open bin that still takes a piece (the lowest set bit at or above its length) by integer operations on
one Python int. When a piece fits nowhere and no slot is left, the fullest bin closes first. Texts are tokenised
where they are read; only piece descriptions (some 40 bytes) are shuffled, so that pieces of many partitions share bins.

Defined results: null text counts as empty (a piece of the end id only); a document longer than the capacity is
cut into pieces of the capacity, the last one shorter; repeated keys are documents of their own; an empty table
gives no rows; other columns are not read. Memory: the open bins, and one batch.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import LearntChunks, memory, only, text_of, tokenizer_file

CAPACITY = 4096
OPEN_BINS = 4096
END_ID = 1
#: Separators of str.split() that the tokenizer's \s does not hold.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on their place or makes two letters, and those that composition may change.
_CASED_ODDLY = re.compile("[^\x00-\u02af]|\u0130")


class ChunkTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pieces never cross white space, with chunks remembered.

    Its normaliser (NFC, lower case, white space to blanks) and pattern work inside chunks between white space, so the
    ids of a text are those of its chunks in order.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.known = LearntChunks(self.learn)
        self.merge = self.lib.model.tokenize
        self.tails = dict(zip(".,", self._encode([".", ","]), strict=True))
        # how the vocabulary spells bytes: printable ones as themselves, the others by letters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for s in range(0, len(texts), 5000):
            out += [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts[s : s + 5000], add_special_tokens=False)]
        return out

    def _encode_word(self, word: str) -> bytes:
        """A lower-case word of letters below U+02B0 is one pattern match, which composition leaves alone, so it goes straight to the merges."""
        spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def learn(self, chunk: str) -> bytes:
        """The ids of a new chunk: a word of letters, with a full stop or comma or without, by its lower-case form."""
        word, tail = chunk, b""
        if not chunk.isalpha():
            word, tail = chunk[:-1], self.tails.get(chunk[-1])
            if tail is None or not word.isalpha():
                return self._encode([chunk])[0]
        if not chunk.isascii() and _CASED_ODDLY.search(chunk):
            return self._encode([chunk])[0]
        stem = word.lower()
        if stem == chunk:
            return self._encode_word(stem)
        return self.known[stem] + tail

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.known.trim()
        get = self.known.__getitem__
        return [self._encode([t])[0] if _ODD.search(t) else b"".join(map(get, t.split())) for t in texts]


_tokenizers: dict[str, ChunkTokenizer] = memory()


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


class BestFit:
    """Bounded-space best-fit over bins of `capacity`; `add` and `finish` return the bins that close."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.set, self.n = 0, 0

    def _put(self, space: int, items: list) -> None:
        self.free[space].append(items)
        self.set |= 1 << space
        self.n += 1

    def _take(self, space: int) -> list:
        items = self.free[space].pop()
        if not self.free[space]:
            self.set &= ~(1 << space)
        self.n -= 1
        return items

    def add(self, length: int, item: object) -> list[list]:
        fits = self.set >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            items = self._take(space)
        else:
            space, items = self.capacity, []
        items.append(item)
        if space == length:
            return [items]
        closed = []
        if self.n >= self.open_bins:
            closed.append(self._take((self.set & -self.set).bit_length() - 1))
        self._put(space - length, items)
        return closed

    def finish(self) -> list[list]:
        closed = []
        while self.set:
            closed.append(self._take((self.set & -self.set).bit_length() - 1))
        return closed


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_tokenizers)
        encode = tokenizer(path).ids
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = []
                for i, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append((i, p, s // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(df[key].cast("long").alias("doc_id"), text_of(df, text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to a table with `length`; every partition packs its own rows.

    A sequence_id holds the partition in its upper bits, so ids never meet.
    """
    names = parts.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins, seq, out = BestFit(capacity, open_bins), 0, []
        schema = None

        def close(closed: list[list]) -> None:
            nonlocal seq
            for items in closed:
                offset = 0
                for row in items:
                    out.append((*row, base + seq, offset))
                    offset += row[at]
                seq += 1

        def emit() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema, strict=True)], names=[*names, "sequence_id", "offset"])
            out.clear()
            return done

        for b in batches:
            schema = [*b.schema.types, pa.int64(), pa.int64()]
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                close(bins.add(row[at], row))
            if len(out) >= 10_000:
                yield emit()
        close(bins.finish())
        if out:
            yield emit()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return parts.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Descriptions are dealt by document, and adaptive execution chooses how many partitions hold them by their
    size: few and large while they are small, more as the input grows. A partition packs its pieces longest first, in an order of
    their own, so that a task run again gives the same sequences.
    """
    described = pieces(df, key, text, path or tokenizer_file("word_bpe_49k.json"), capacity, end_id)
    dealt = described.repartition("doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return pack(dealt, capacity, open_bins)

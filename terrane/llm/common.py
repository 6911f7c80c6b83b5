"""Helpers shared by the operators of this subpackage: scratch tables, hashing, column access."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import on_workers

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's `spark.checkpoint.dir` names it.

    Only a local session may name none (tests, a laptop): it gets a temporary folder, which is set. On a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch: texts are long, and a batch is held several times over on both sides of the pipe to Python.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with what the operators count on: workers that find this package, and Arrow batches of at most `BATCH_ROWS` rows."""
    on_workers(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def written(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Writes `df` as Parquet to a new folder of the shared one, whose path it returns."""
    path = f"{shared_folder(df.sparkSession)}/terrane-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def kept(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table of a path that `written` gave; it is deleted by `forget`, or when the interpreter ends."""
    _written.append((spark, path))
    out = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    out._stored_at = path
    return out


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return the table read back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    return kept(df.sparkSession, written(df, name, partition_by), df.schema)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        for item in [x for x in _written if x[1] == path]:
            _written.remove(item)
            _delete(*item)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes what `stored` writes inside, for a caller that writes its result inside, too. Tables of other results stay."""
    before = set(path for _, path in _written)
    try:
        yield
    finally:
        for item in [x for x in _written if x[1] not in before]:
            _written.remove(item)
            _delete(*item)


def forget_all() -> None:
    """Delete every table made by `stored` so far, at the interpreter's end."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; what is left lies in a scratch folder
        pass


atexit.register(forget_all)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def remainder(df: DataFrame, modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo `modulus` (null key: crc32 of the empty string)."""
    return F.crc32(F.coalesce(df[key].cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def owners(spark: SparkSession) -> int:
    """How many hash owners share a keyed exchange: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_file(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes the path as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class WordNames(dict):
    """A keyed 64-bit digest (BLAKE2b) of each word, remembered in bounded space."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        name = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"terrane word").digest(), "little")
        return name

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def word_lists(text: bytes, blanks: bytes, limit: int = 1_000_000) -> Iterator[list[bytes]]:
    """The words of a text, a list for each megabyte or so. `blanks` maps what separates words to a blank (bytes.translate)."""
    text, start = text.translate(blanks), 0
    while len(text) - start > limit:
        stop = text.find(b" ", start + limit)
        if stop < 0:
            break
        yield text[start:stop].split()
        start = stop
    yield text[start:].split()


def text_name(text: bytes, blanks: bytes) -> bytes:
    """The digest of a text's words that `named_words` gives."""
    whole = hashlib.blake2b(digest_size=16, key=b"terrane text")
    for words in word_lists(text, blanks):
        whole.update(b" ".join([*words, b""]))
    return whole.digest()


def named_words(texts: list[bytes], blanks: bytes, names: WordNames) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Digests of the words of all texts in order, where each text's words begin (one entry more than texts), and a 128-bit digest of each text's words."""
    parts, counts, digests = [np.zeros(0, np.uint64)], [], []
    for text in texts:
        whole, n = hashlib.blake2b(digest_size=16, key=b"terrane text"), 0
        for words in word_lists(text, blanks):
            parts.append(np.fromiter(map(names.__getitem__, words), np.uint64, len(words)))
            whole.update(b" ".join([*words, b""]))
            n += len(words)
        counts.append(n)
        digests.append(whole.digest())
        names.trim()
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), digests


def sliced(batch, column: int, limit: int = 500_000):
    """Slices of an Arrow batch that hold about `limit` bytes of its string column each, one row at least."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class LearntChunks(dict):
    """What chunks of text encode to, in bounded space; a new chunk is learnt when it is first asked for, and one of more than `LONGEST` characters each time.

    Frequent chunks come early, so the first `kept` entries stay; later ones go together when there are `extra` of them.
    """

    LONGEST = 200

    def __init__(self, learn, kept: int = 300_000, extra: int = 150_000):
        super().__init__()
        self.learn, self.kept, self.limit = learn, kept, kept + extra

    def __missing__(self, chunk: str) -> bytes:
        ids = self.learn(chunk)
        if len(chunk) <= self.LONGEST:
            self[chunk] = ids
        return ids

    def trim(self) -> None:
        """Call between batches."""
        if len(self) > self.limit:
            for k in list(self)[self.kept :]:
                del self[k]


def training_rows(df: DataFrame, labels: DataFrame, target: str, folds: int, held: int, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most `bound` labelled rows of `df` outside the held-out fold, chosen by a hash of their key.

    A key that has several labels counts as 1 if any is 1; a null key or label is no label. The chosen keys, a
    bounded number, are broadcast, so only their texts are shuffled; of a key's several texts the least one is learnt from.
    """
    known = labels.select(labels[key].cast("long").alias("id"), labels[target].cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held)
    known = known.join(df.select(df[key].cast("long").alias("id")), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    found = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


#: Row names (some 60 bytes each) that may be broadcast to drop rows; a join shuffles beyond that.
BROADCAST_NAMES = 200_000


def kept_rows(df: DataFrame, name: Column, decided: DataFrame) -> DataFrame:
    """The rows of `df` that a stage kept.

    `name` identifies a row of `df` up to equal key and text; `decided` has a row (_name, kept) for each row. Rows of
    one name differ in no way that the stage looks at: if one of them is kept, one stays.
    """
    own = "_name"
    while own.lower() in (c.lower() for c in df.columns):
        own += "_"
    named = df.withColumn(own, name)
    marks = stored(decided.groupBy("_name").agg(F.max("kept").alias("any"), F.count("*").alias("n")).where("not any or n > 1").withColumnRenamed("_name", own), "marks")
    gone, twice = marks.where("not any").select(own), marks.where("any").select(own)
    small = marks.count() <= BROADCAST_NAMES
    near = F.broadcast if small else (lambda t: t)
    out = named.join(near(gone), own, "left_anti")
    if not twice.isEmpty():
        out = out.join(near(twice), own, "left_anti").unionByName(out.join(near(twice), own, "left_semi").dropDuplicates([own]))
    return out.select(df.columns)


def row_name(key: Column, digest: Column) -> Column:
    """Key and digest of the text as one string that is never null."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), digest)


_memories: list[dict] = []


def memory() -> dict:
    """A dictionary for what an operator remembers in a Python worker from task to task."""
    out: dict = {}
    _memories.append(out)
    return out


def only(own: dict | None = None) -> None:
    """Called where a task begins: workers outlive stages, so what other operators remember goes, and what they need no more is given back."""
    found = [m for m in _memories if m is not own and m]
    for m in found:
        m.clear()
    if found:
        gc.collect()


def give_back() -> None:
    """Called where a task or a group ends: what its arrays took goes back to the system, since idle workers outlive stages and keep free pages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)

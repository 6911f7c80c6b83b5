"""Fill-in-middle transformation over a sparse index of multibyte characters.

A text stays UTF-8 bytes. Its index holds only the characters of more than one byte: where each stands, as byte and as code
point, and how many bytes the text has gained by then. A cut in code points is found in bytes, and the other way, by one
binary search in that list and an addition; in a text of ASCII the list is empty and every conversion is arithmetic.

Cuts fall between units (lines, or code points) and are drawn from a SHA-256 of a salt and the document's key, so that they
are the same in any partition and after any retry. Both layouts put the middle last:

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stay as they are (`plain`); a null key is
hashed as no digits; repeated rows give the same row again; an empty table gives no rows; other columns are not read. Memory: one
batch of texts and a few numbers for each multibyte character and line of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import only, sliced, text_of

SALT = "7:"


class SparseIndex:
    """Code points and bytes of one UTF-8 text, from its multibyte characters alone."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.gained = np.concatenate([[0], np.cumsum(excess)])
        self.at_point = self.at_byte - self.gained[:-1]
        self.n_points = len(data) - int(self.gained[-1])

    def to_bytes(self, points: np.ndarray | int) -> np.ndarray:
        """Where the code points with these numbers begin."""
        return points + self.gained[np.searchsorted(self.at_point, points)]

    def to_points(self, at: np.ndarray | int) -> np.ndarray:
        """The numbers of the code points that begin at these bytes."""
        return at - self.gained[np.searchsorted(self.at_byte, at)]


@dataclass(frozen=True)
class Layout:
    """Sentinels, shares and unit of the transformation. A sentinel's first character stands nowhere else in any sentinel,
    so none can begin within a text and end in the sentinel behind it."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Percent of the texts that are transformed, and percent of those that come suffix first.
    rate: int = 100
    spm: int = 50
    unit: str = "line"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or any(m[0] in x[1:] for x in marks) for m in marks):
            raise ValueError("sentinels must differ, and begin with a character that stands nowhere else in them")
        if self.unit not in ("line", "character"):
            raise ValueError(f"no unit {self.unit!r}")

    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(key: str, salt: str = SALT) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    return tuple(np.frombuffer(hashlib.sha256((salt + key).encode()).digest(), ">u4")[:4].tolist())


def transformed(data: bytes, key: str, layout: Layout = Layout(), salt: str = SALT) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    index = SparseIndex(data)
    if layout.unit == "line":
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if data and not data.endswith(b"\n"):
            ends = np.append(ends, len(data))
        n = len(ends)
    else:
        n = index.n_points
    p, s, m = layout.marks()
    h1, h2, h3, h4 = draws(key, salt)
    if not data or p in data or s in data or m in data or h3 % 100 >= layout.rate:
        return n, "plain", None, None, data
    units = np.array(sorted((h1 % (n + 1), h2 % (n + 1))))
    if layout.unit == "line":
        cuts = np.where(units > 0, ends[np.maximum(units, 1) - 1], 0)
        points = index.to_points(cuts)
    else:
        points, cuts = units, index.to_bytes(units)
    a, b = cuts.tolist()
    form = "spm" if h4 % 100 < layout.spm else "psm"
    body = [s, data[b:], p, data[:a]] if form == "spm" else [p, data[:a], s, data[b:]]
    return n, form, int(points[0]), int(points[1] - points[0]), b"".join([*body, m, data[a:b]])


def rebuilt(output: bytes, form: str, layout: Layout = Layout()) -> bytes:
    """The text that gave this output in this form."""
    if form == "plain":
        return output
    p, s, m = layout.marks()
    first, second = (s, p) if form == "spm" else (p, s)
    begin = output.index(second, len(first))
    stop = output.index(m, begin)
    one, two, three = output[len(first) : begin], output[begin + len(second) : stop], output[stop + len(m) :]
    return two + three + one if form == "spm" else one + three + two


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", layout: Layout = Layout(), salt: str = SALT) -> DataFrame:
    """One row for each row of `df`: key, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 1, 4_000_000):
                ids = b.column(0).to_pylist()
                rows = [transformed(t, "" if i is None else str(i), layout, salt) for i, t in zip(ids, _bytes(b, 1), strict=True)]
                columns = [pa.array(c, t) for c, t in zip((ids, *zip(*rows, strict=True)), types, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = df.select(df[key].cast("long").alias("id"), text_of(df, text).alias("text")).mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", key)


def restore(df: DataFrame, output: str = "output", form: str = "form", into: str = "restored", layout: Layout = Layout()) -> DataFrame:
    """`df` with the text rebuilt from its output and form; a null output or form gives null."""

    @F.pandas_udf("string")
    def back(outputs, forms):
        found = [None if o is None or f is None else rebuilt(o.encode("utf-8", "surrogatepass"), f, layout).decode("utf-8", "surrogatepass") for o, f in zip(outputs, forms, strict=True)]
        return outputs.__class__(found, index=outputs.index, dtype=object)

    return df.withColumn(into, back(df[output], df[form]))


#: Lines, cuts and layouts by list functions and SHA-256: another way to the same bytes. The hexadecimal groups are read as integers.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
n AS (SELECT *, len(lines)::BIGINT AS n FROM l),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

"""Compressed trajectories (XTC) as a data source: `spark.read.format("xtc")`, with partitions of frames.

A file is a chain of frames. Their heads tell where the next one begins, so the driver reads some ninety bytes a frame to find offsets, times and steps;
stride and time window choose frames there, and a partition is a range of offsets, read and decoded by one task. Files are opened
through Arrow's file systems, so paths may be local, HDFS or object stores.

Coordinates are integers of a given precision, written as one mixed-radix number a point, or, for points near the one before, as a smaller
one whose width adapts; the second point of such a run is stored before the first. Lengths are Angstrom.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, frame long, step long, time_ps double, box array<double>, coords array<float>"
#: Numbers at the head of a frame: of usual ones, and of ones with 64-bit lengths (fixed values).
MAGIC, MAGIC_LONG = 1995, 2023
#: Ranges of the steps of the adaptive coder, about a third root of two apart from step 9 on (fixed values of the format).
STEPS = [0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216]
FIRST_STEP = 9
HEAD = 4 * 4 + 9 * 4  # magic, atoms, step, time, box
ANGSTROM = 10.0


def _folder(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _named(path: str) -> list[str]:
    """Files that a path names; its last part may hold `*` and `?`."""
    folder, _, last = path.rpartition("/")
    if not any(c in last for c in "*?"):
        return [path]
    from fnmatch import fnmatchcase

    from pyarrow import fs

    system, inside = _folder(folder or ".")
    found = [f.base_name for f in system.get_file_info(fs.FileSelector(inside)) if f.is_file and fnmatchcase(f.base_name, last)]
    if not found:
        raise ValueError(f"no file is named by {path}")
    return [f"{folder}/{f}" if folder else f for f in sorted(found)]


def heads(file, size: int) -> Iterator[tuple[int, int, int, float]]:
    """(offset, bytes, step, time) of each whole frame of an open file; a last frame that was cut off is left out."""
    at = 0
    while at + HEAD + 4 <= size:
        file.seek(at)
        head = file.read(min(HEAD + 4 + 44, size - at))
        magic, atoms, step, time = struct.unpack(">iiif", head[:16])
        if magic not in (MAGIC, MAGIC_LONG):
            raise ValueError(f"no frame at byte {at}")
        (count,) = struct.unpack(">i", head[HEAD : HEAD + 4])
        if count != atoms:
            raise ValueError(f"{atoms} atoms at byte {at}, but {count} points")
        if count <= 9:
            length = HEAD + 4 + 12 * count
        else:
            wide = magic == MAGIC_LONG
            if len(head) < HEAD + 4 + 32 + (8 if wide else 4):
                return
            (stored,) = struct.unpack(">q" if wide else ">i", head[HEAD + 36 : HEAD + (44 if wide else 40)])
            length = HEAD + (44 if wide else 40) + -(-stored // 4) * 4
        if at + length > size:
            return
        yield at, length, step, time
        at += length


class _Bits:
    """A stream of bits, most significant first, as one integer in pieces."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big")
        word >>= (last << 3) - self.at - n
        self.at += n
        return word & ((1 << n) - 1)

    def mixed(self, n: int, second: int, third: int) -> tuple[int, int, int]:
        """Three numbers from one of `n` bits, whose bytes are in rising order; the last number runs fastest."""
        whole, rest = divmod(n, 8)
        value = int.from_bytes(self.take(8 * whole).to_bytes(whole, "big"), "little")
        if rest:
            value |= self.take(rest) << 8 * whole
        value, c = divmod(value, third)
        a, b = divmod(value, second)
        return a, b, c


def points(data: bytes, count: int, least: tuple[int, int, int], greatest: tuple[int, int, int], step: int) -> np.ndarray:
    """Integer coordinates of the points in a frame's compressed bytes."""
    sizes = [g - s + 1 for s, g in zip(least, greatest, strict=True)]
    split = max(sizes) > 0xFFFFFF
    width = 0 if split else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    bits, out, run = _Bits(data), [], 0
    own = [s.bit_length() for s in sizes]
    x0, y0, z0 = least
    while len(out) < count:
        a, b, c = (bits.take(own[0]), bits.take(own[1]), bits.take(own[2])) if split else bits.mixed(width, sizes[1], sizes[2])
        before = (a + x0, b + y0, c + z0)
        change = 0
        if bits.take(1):
            run = bits.take(5)
            change = run % 3 - 1
            run -= change + 1
        if not run:
            out.append(before)
        radix = STEPS[step]
        half = radix // 2
        for k in range(0, run, 3):
            a, b, c = bits.mixed(step, radix, radix)
            x, y, z = before
            here = (a + x - half, b + y - half, c + z - half)
            if k == 0:
                out.append(here)
                out.append(before)  # the pair is stored the other way round, and the run goes on from its later-stored point
                before = here
            else:
                out.append(here)
                before = here
        step += change
    return np.array(out[:count], np.int64)


def decoded(frame: bytes) -> tuple[list[float], np.ndarray]:
    """(box vectors, flat coordinates) of one frame's bytes, in Angstrom."""
    magic, _, _, _ = struct.unpack(">iiif", frame[:16])
    box = [ANGSTROM * x for x in struct.unpack(">9f", frame[16:HEAD])]
    (count,) = struct.unpack(">i", frame[HEAD : HEAD + 4])
    if count <= 9:
        return box, np.frombuffer(frame, ">f4", 3 * count, HEAD + 4).astype(np.float32) * np.float32(ANGSTROM)
    precision, *rest = struct.unpack(">f7i", frame[HEAD + 4 : HEAD + 36])
    wide = magic == MAGIC_LONG
    (stored,) = struct.unpack(">q" if wide else ">i", frame[HEAD + 36 : HEAD + (44 if wide else 40)])
    start = HEAD + (44 if wide else 40)
    whole = points(frame[start : start + stored], count, tuple(rest[:3]), tuple(rest[3:6]), rest[6])
    return box, (whole.ravel() * (ANGSTROM / precision)).astype(np.float32)


class _Frames(InputPartition):
    def __init__(self, path: str, frames: list[tuple[int, int, int, int, float]]):
        super().__init__(path)
        self.path, self.frames = path, frames


class FrameReader(DataSourceReader):
    """Frames of the files that the options name: path, stride, begin, end (ps), frames (of a partition), atoms (numbers from 0, divided by commas).

    A format says by `heads` where a file's frames are, and by `decoded` what the bytes of one hold.
    """

    def __init__(self, options: dict):
        self.paths = [f for p in options.get("path", "").split(";") if p.strip() for f in _named(p.strip())]
        if not self.paths:
            raise ValueError("the option path is needed")
        self.stride = max(1, int(options.get("stride", 1)))
        self.begin, self.end = float(options.get("begin", "-inf")), float(options.get("end", "inf"))
        self.each = max(1, int(options.get("frames", 500)))
        self.atoms = [int(a) for a in options["atoms"].split(",")] if options.get("atoms") else None

    def heads(self, file, size: int) -> Iterator[tuple[int, int, int, float]]:
        raise NotImplementedError

    def decoded(self, frame: bytes) -> tuple[list[float] | None, np.ndarray]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            system, inside = _folder(path)
            with system.open_input_file(inside) as file:
                chosen = [(n, *h) for n, h in enumerate(self.heads(file, file.size())) if n % self.stride == 0 and self.begin <= h[3] <= self.end]
            out += [_Frames(path, chosen[k : k + self.each]) for k in range(0, len(chosen), self.each)]
        return out or [_Frames(self.paths[0], [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, inside = _folder(partition.path)
        take = None if self.atoms is None else (np.array(self.atoms)[:, None] * 3 + np.arange(3)).ravel()
        types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float32())]
        if not partition.frames:
            return
        with system.open_input_file(inside) as file:
            for s in range(0, len(partition.frames), 64):
                rows = []
                for number, offset, length, step, time in partition.frames[s : s + 64]:
                    file.seek(offset)
                    box, coords = self.decoded(file.read(length))
                    rows.append((partition.path, number, step, float(time), box, coords if take is None else coords[take]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["path", "frame", "step", "time_ps", "box", "coords"])


class XtcReader(FrameReader):
    heads = staticmethod(heads)
    decoded = staticmethod(decoded)


class XtcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xtc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return XtcReader(dict(self.options))


def scanned(spark: SparkSession, source: type[DataSource], paths: str | list[str], stride: int = 1, begin: float | None = None, end: float | None = None, atoms: list[int] | None = None, frames: int = 500, **more: object) -> DataFrame:
    """Frames by a data source of trajectories, under the options of `FrameReader` and of its own."""
    from terrane import on_workers

    on_workers(spark)
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", ";".join([paths] if isinstance(paths, str) else paths)).option("stride", stride).option("frames", frames)
    for name, value in (("begin", begin), ("end", end), ("atoms", ",".join(map(str, atoms)) if atoms is not None else None), *more.items()):
        reader = reader.option(name, value) if value is not None else reader
    return reader.load()


def read_xtc(spark: SparkSession, paths: str | list[str], stride: int = 1, begin: float | None = None, end: float | None = None, atoms: list[int] | None = None, frames: int = 500) -> DataFrame:
    """(path, frame, step, time_ps, box, coords) of XTC files: every `stride`-th frame from the first on, cut to a time window, of all atoms or of some."""
    return scanned(spark, XtcSource, paths, stride, begin, end, atoms, frames)

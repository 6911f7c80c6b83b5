"""Uncompressed trajectories, TRR and DCD, as data sources with partitions of frames, like those of `xtc`; and one reader that goes by the ending.

Frames of a TRR file differ in what they hold, so its heads are read one after another; those of a DCD file are equally long, so its one head
says where all of them are. No file is read whole by a task or held as a value. Lengths are Angstrom.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from terrane.sources.xtc import ANGSTROM, SCHEMA, FrameReader, XtcSource, scanned

#: First number of a TRR frame and the name after it (fixed values of the format).
TRR_MAGIC, TRR_NAME = 1993, b"GMX_trn_file"
_SIZES = ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f")
_TRR_FIXED = 4 + 4 + 4 + len(TRR_NAME) + 4 * 13
#: Picoseconds in a unit of time of DCD files.
DCD_TIME = 0.04888821


def trr_head(head: bytes) -> dict | None:
    """Sizes of the parts of a TRR frame, atoms, step, time and where the parts begin; none if the bytes end before that."""
    if len(head) < _TRR_FIXED:
        return None
    magic, _, length = struct.unpack(">3i", head[:12])
    if magic != TRR_MAGIC or head[12 : 12 + length] != TRR_NAME:
        raise ValueError("not a frame of a TRR file")
    *sizes, atoms, step, _ = struct.unpack(">13i", head[12 + length : _TRR_FIXED])
    part = dict(zip(_SIZES, sizes, strict=True))
    width = part["box"] // 9 or next((part[k] // (3 * atoms) for k in "xvf" if part[k] and atoms), 4)
    if width not in (4, 8):
        raise ValueError(f"numbers of {width} bytes in a TRR file")
    if len(head) < _TRR_FIXED + 2 * width:
        return None
    (time,) = struct.unpack(">f" if width == 4 else ">d", head[_TRR_FIXED : _TRR_FIXED + width])
    return {"part": part, "atoms": atoms, "step": step, "time": time, "type": f">f{width}", "body": _TRR_FIXED + 2 * width}


class TrrReader(FrameReader):
    def heads(self, file, size: int) -> Iterator[tuple[int, int, int, float]]:
        """Frames that hold coordinates; a last frame that was cut off is left out."""
        at = 0
        while at < size:
            file.seek(at)
            head = trr_head(file.read(min(_TRR_FIXED + 16, size - at)))
            if head is None:
                return
            length = head["body"] + sum(head["part"].values())
            if at + length > size:
                return
            if head["part"]["x"]:
                yield at, length, head["step"], head["time"]
            at += length

    def decoded(self, frame: bytes) -> tuple[list[float] | None, np.ndarray]:
        head = trr_head(frame[: _TRR_FIXED + 16])
        part, kind, at = head["part"], head["type"], head["body"] + head["part"]["ir"] + head["part"]["e"]
        box = (np.frombuffer(frame, kind, 9, at).astype(float) * ANGSTROM).tolist() if part["box"] else None
        at += sum(part[k] for k in ("box", "vir", "pres", "top", "sym"))
        return box, (np.frombuffer(frame, kind, 3 * head["atoms"], at) * ANGSTROM).astype(np.float32)


class DcdReader(FrameReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.unit = float(options.get("time_unit", DCD_TIME))

    def heads(self, file, size: int) -> Iterator[tuple[int, int, int, float]]:
        """Frames of 32-bit coordinates, of either byte order; those whose fixed atoms are left out after the first frame are refused."""
        first = file.read(min(size, 100))
        if len(first) < 100 or first[4:8] not in (b"CORD", b"DROC"):
            raise ValueError("not a DCD file")
        order = "<" if struct.unpack("<i", first[:4])[0] == 84 else ">"
        control = struct.unpack(f"{order}20i", first[8:88])
        if control[8]:
            raise ValueError("a DCD file with fixed atoms")
        (delta,) = struct.unpack(f"{order}f", first[44:48])
        start, every, cell = control[1], control[2], bool(control[10])
        at = 92 + struct.unpack(f"{order}i", first[92:96])[0] + 8
        file.seek(at)
        atoms = struct.unpack(f"{order}2i", file.read(8))[1]
        at += 12
        length = (56 if cell else 0) + 3 * (4 * atoms + 8)
        for k in range((size - at) // length):
            yield at + k * length, length, start + k * every, k * delta * every * self.unit

    def decoded(self, frame: bytes) -> tuple[list[float] | None, np.ndarray]:
        cell = len(frame) % 12 == 8  # three records of coordinates are a multiple of 12 bytes long, a cell's record is of 56
        each = (len(frame) - 56 * cell) // 3
        order = "<" if struct.unpack("<i", frame[-4:])[0] == each - 8 else ">"
        at = 56 * cell
        axes = [np.frombuffer(frame, f"{order}f4", (each - 8) // 4, at + a * each + 4) for a in range(3)]
        return cell_vectors(np.frombuffer(frame, f"{order}f8", 6, 4)) if cell else None, np.stack(axes, 1).ravel().astype(np.float32)


def cell_vectors(cell: np.ndarray) -> list[float]:
    """Box vectors from the six numbers of a DCD cell: a, gamma, b, beta, alpha, c, whose angles are degrees or cosines."""
    a, gamma, b, beta, alpha, c = (float(x) for x in cell)
    cosine = [x if abs(x) <= 1 else float(np.cos(np.radians(x))) if x != 90 else 0.0 for x in (alpha, beta, gamma)]
    sine = np.sqrt(max(1e-12, 1 - cosine[2] ** 2))
    second = (cosine[0] - cosine[1] * cosine[2]) / sine
    return [a, 0.0, 0.0, b * cosine[2], b * float(sine), 0.0, c * cosine[1], c * float(second), c * float(np.sqrt(max(0.0, 1 - cosine[1] ** 2 - second**2)))]


class _Source(DataSource):
    def schema(self) -> str:
        return SCHEMA


class TrrSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "trr"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TrrReader(dict(self.options))


class DcdSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "dcd"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DcdReader(dict(self.options))


def read_trajectory(spark: SparkSession, paths: str | list[str], stride: int = 1, begin: float | None = None, end: float | None = None, atoms: list[int] | None = None, frames: int = 500, **more: object) -> DataFrame:
    """(path, frame, step, time_ps, box, coords) of trajectory files of one format, told by the first one's ending: xtc, trr or dcd."""
    source = {"xtc": XtcSource, "trr": TrrSource, "dcd": DcdSource}
    first = paths if isinstance(paths, str) else paths[0]
    kind = first.rsplit(".", 1)[-1].lower()
    if kind not in source:
        raise ValueError(f"no reader for trajectories that end in .{kind}; there are {', '.join(sorted(source))}")
    return scanned(spark, source[kind], paths, stride, begin, end, atoms, frames, **more)

"""LAS point clouds as a Spark data source: fixed-width records, so one file is read by many tasks.

``spark.read.format("las").load(path)``; options ``records`` (records of a partition) and ``maxPoints`` (the first so many,
file after file in the order of their names). A filter on x, y or z leaves out files whose header's box it excludes, if the
session allows pushdown to Python sources (``read_points`` does). Files of a folder that all executors have mounted are split; ``read_points`` reads those of other file systems through
Spark, a file in a task. LAZ isn't read.
"""

from __future__ import annotations

import glob
import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, x double, y double, z double, intensity float, return_number tinyint, classification tinyint"
_HEAD = struct.Struct("<4sHHIHH8sBB32s32sHHHIIBHI5I12d")


@dataclass(frozen=True)
class Header:
    path: str
    version: str
    count: int
    offset: int
    point_format: int
    record: int
    scales: tuple[float, float, float]
    offsets: tuple[float, float, float]
    maxima: tuple[float, float, float]
    minima: tuple[float, float, float]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        return parse_header(f.read(375), path)


def parse_header(raw: bytes, path: str) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    h = _HEAD.unpack_from(raw)
    major, minor, count = h[7], h[8], h[18]
    if (major, minor) >= (1, 4):
        count = struct.unpack_from("<Q", raw, 247)[0]
    d = h[24:36]
    return Header(path, f"{major}.{minor}", count, h[14], h[16] & 0x3F, h[17], d[0:3], d[3:6], (d[6], d[8], d[10]), (d[7], d[9], d[11]))


def _dtype(header: Header) -> np.dtype:
    """x, y, z, intensity, flags and class of a record, whatever else it holds."""
    at_class = 16 if header.point_format >= 6 else 15
    return np.dtype({"names": ["x", "y", "z", "i", "flags", "cls"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, at_class], "itemsize": header.record})


def read_range(header: Header, first: int, n: int) -> dict[str, np.ndarray]:
    with open(header.path, "rb") as f:
        f.seek(header.offset + first * header.record)
        return parse_records(header, f.read(n * header.record))


def parse_records(header: Header, raw: bytes) -> dict[str, np.ndarray]:
    rows = np.frombuffer(raw[: len(raw) // header.record * header.record], _dtype(header))
    xyz = (rows[a] * s + o for a, s, o in zip("xyz", header.scales, header.offsets, strict=True))
    wide = header.point_format >= 6
    return dict(zip(("x", "y", "z"), xyz, strict=True)) | {"intensity": rows["i"].astype(np.float32), "return_number": (rows["flags"] & (15 if wide else 7)).astype(np.int8), "classification": (rows["cls"] if wide else rows["cls"] & 31).astype(np.int8)}


def write(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity=0, return_number=1, classification=0, scale: float = 0.001) -> None:
    """A LAS 1.2 file of point format 0."""
    n = len(x)
    rows = np.zeros(n, np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "<u2"), ("flags", "u1"), ("cls", "u1"), ("rest", "V4")]))
    low = [float(np.floor(a.min())) if n else 0.0 for a in (x, y, z)]
    for name, a, o in zip("xyz", (x, y, z), low, strict=True):
        rows[name] = np.rint((a - o) / scale)
    rows["i"], rows["flags"], rows["cls"] = intensity, return_number, classification
    ends = [v for a in (x, y, z) for v in ((a.max(), a.min()) if n else (0.0, 0.0))]
    head = _HEAD.pack(b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"", 1, 2024, 227, 227, 0, 0, 20, n, n, 0, 0, 0, 0, scale, scale, scale, *low, *ends)
    with open(path, "wb") as f:
        f.write(head + rows.tobytes())


@dataclass
class _Part(InputPartition):
    header: Header
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("records", 1_000_000))
        self.most = int(options["maxpoints"]) if "maxpoints" in options else None
        self.low, self.high = dict.fromkeys("xyz", -math.inf), dict.fromkeys("xyz", math.inf)
        if self.step <= 0 or (self.most is not None and self.most < 0):
            raise ValueError("records is positive and maxPoints not negative")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on x, y and z choose files; Spark still applies every filter to the points."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute[0] in self.low:
                axis = f.attribute[0]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[axis] = max(self.low[axis], f.value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[axis] = min(self.high[axis], f.value)
            yield f

    def _meets(self, h: Header) -> bool:
        return all(h.minima[k] <= self.high[a] and h.maxima[k] >= self.low[a] for k, a in enumerate("xyz"))

    def partitions(self) -> list[_Part]:
        path = self.path.removeprefix("file://").removeprefix("file:")
        files = sorted(glob.glob(f"{path}/**/*.las", recursive=True)) if os.path.isdir(path) else [path]
        if not files or not os.path.exists(files[0]):
            raise FileNotFoundError(self.path)
        out, left = [], math.inf if self.most is None else self.most
        for h in map(read_header, files):
            n = int(min(h.count, left))
            left -= n
            if self._meets(h):
                out += [_Part(h, a, min(self.step, n - a)) for a in range(0, n, self.step)]
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partition at all
            return
        for a in range(part.first, part.first + part.n, 100_000):
            got = read_range(part.header, a, min(100_000, part.first + part.n - a))
            yield pa.record_batch([pa.array([part.header.path] * len(got["x"])), *map(pa.array, got.values())], ["path", *got])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


#: Metres of a unit of height (fixed values).
Z_UNITS = {"meters": 1.0, "feet": 0.3048}


def _through_spark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = memoryview(content.as_py())
            header = parse_header(bytes(raw[:375]), path)
            for a in range(0, header.count, 100_000):
                at, n = header.offset + a * header.record, min(100_000, header.count - a)
                got = parse_records(header, bytes(raw[at : at + n * header.record]))
                yield pa.record_batch([pa.array([path] * n), *map(pa.array, got.values())], ["path", *got])


def read_points(spark, path: str, records: int = 1_000_000, z_unit: str = "meters", max_points: int | None = None):
    """Points of a file or of all ``.las`` files below a folder, heights in metres; ``max_points`` keeps the first so many, file after file in the order of their names.

    Of other file systems than a mounted one a file is read by one task, and ``max_points`` isn't taken there.
    """
    if z_unit not in Z_UNITS:
        raise ValueError(f"unknown unit of height: {z_unit}")
    if "://" in path and not path.startswith("file:"):
        if max_points is not None:
            raise ValueError("max_points needs files of a mounted folder")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.las").load(path)
        found = files.select("path", "content").mapInArrow(_through_spark, SCHEMA)
    else:
        spark.dataSource.register(LasSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = spark.read.format("las").option("records", records)
        found = (reader if max_points is None else reader.option("maxPoints", max_points)).load(path)
    return found if z_unit == "meters" else found.withColumn("z", found["z"] * Z_UNITS[z_unit])

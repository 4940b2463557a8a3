"""GeoTIFF rasters as cells: classic and big files, uncompressed or deflate, strips or tiles, any band; north-up files, row 0 = south.

``spark.read.format("geotiff").load(path)`` is splittable: a task reads a run of strips or tiles by byte ranges, through
``pyarrow.fs`` (a mounted folder, ``hdfs://``, ``s3://``, ``gs://``). Filters on row, col and band drop blocks unread, if
the session allows pushdown to Python sources (``read_cells`` does). Metadata come from headers alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: TIFF field types and sizes (fixed values of the format).
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_TYPES = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (3, 32): "f4", (3, 64): "f8", (2, 32): "i4", (1, 32): "u4"}
SCHEMA = "path string, band int, row int, col int, value double"
META = "path string, width int, height int, bands int, pixel_size double, x_min double, y_min double, nodata double, epsg int, dtype string, error string"
#: Decoded bytes of the blocks of a task, about.
TASK_BYTES = 64 << 20
#: What is read of a file first: most headers lie in it.
HEAD_BYTES = 4096

Read = Callable[[int, int], bytes]


def _tags(read: Read) -> tuple[dict[int, tuple], str]:
    """Tags of the first directory, from the byte ranges that hold them."""
    held = read(0, HEAD_BYTES)

    def part(at: int, n: int) -> bytes:
        found = held[at : at + n] if at + n <= len(held) else read(at, n)
        if len(found) < n:
            raise ValueError("the file ends within its header")
        return found

    order = "<" if held[:2] == b"II" else ">" if held[:2] == b"MM" else ""
    magic = struct.unpack(order + "H", part(2, 2))[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    number, entry, inline, count, word = ("I", 12, 4, "H", "I") if magic == 42 else ("Q", 20, 8, "Q", "Q")
    at = struct.unpack(order + number, part(4, 4) if magic == 42 else part(8, 8))[0]
    first = struct.calcsize(order + count)
    n_entries = struct.unpack(order + count, part(at, first))[0]
    table, out = part(at + first, entry * n_entries), {}
    for k in range(n_entries):
        tag, kind, n = struct.unpack_from(order + "HH" + word, table, entry * k)
        if kind not in _KINDS:
            continue
        form = f"{order}{n}s" if kind == 2 else f"{order}{n * len(_KINDS[kind])}{_KINDS[kind][0]}"
        size, place = struct.calcsize(form), entry * (k + 1) - inline
        raw = table[place : place + size] if size <= inline else part(struct.unpack_from(order + number, table, place)[0], size)
        out[tag] = struct.unpack(form, raw)
    return out, order


def _unpredicted(block: bytes, rows: int, width: int, bands: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """Values (rows, width, bands) of one strip or tile."""
    if predictor == 3:  # bytes of a row by significance, each the difference to the one a band's width before
        size = kind.itemsize
        raw = np.frombuffer(block, np.uint8)[: rows * width * bands * size].reshape(rows, size * width, bands)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, width * bands)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, bands)
    values = np.frombuffer(block, kind)[: rows * width * bands].reshape(rows, width, bands)
    if predictor == 2:
        return np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"unsupported predictor: {predictor}")
    return values


@dataclass
class Tiff:
    """Layout of a file: block k of a band lies at offsets[k], sizes[k]."""

    width: int
    height: int
    bands: int
    kind: str
    order: str
    packed: int
    predictor: int
    tiled: bool
    apart: bool
    wide: int
    tall: int
    offsets: np.ndarray
    sizes: np.ndarray
    meta: dict

    @property
    def across(self) -> int:
        return -(-self.width // self.wide)

    @property
    def down(self) -> int:
        return -(-self.height // self.tall)

    def block(self, k: int) -> tuple[int, int, int, int]:
        """First row from the north, first column, rows and columns of a block."""
        top, left = k // self.across * self.tall, k % self.across * self.wide
        return top, left, min(self.tall, self.height - top), min(self.wide, self.width - left)

    def values(self, raw: bytes, k: int, band: int) -> np.ndarray:
        """The cells of block k of a band (from 1) from its bytes, north up."""
        top, _, rows, cols = self.block(k)
        block = raw if self.packed == 1 else zlib.decompress(raw)
        stored = self.tall if self.tiled else rows
        found = _unpredicted(block, stored, self.wide, 1 if self.apart else self.bands, np.dtype(self.kind).newbyteorder(self.order), self.predictor)
        return found[:rows, :cols, 0 if self.apart else band - 1]

    def place(self, k: int, band: int) -> tuple[int, int]:
        """Offset and size of a block."""
        at = k + ((band - 1) * self.across * self.down if self.apart else 0)
        return int(self.offsets[at]), int(self.sizes[at])


def parse(read: Read) -> Tiff:
    """The layout from ``read(offset, n)``; what isn't read raises ValueError."""
    tags, order = _tags(read)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if len(set(tags.get(258, (1,)))) > 1:
        raise ValueError("bands of several widths aren't read")
    form = (tags.get(339, (1,))[0], tags.get(258, (1,))[0])
    if form not in _TYPES:
        raise ValueError(f"unsupported values: {form}")
    packed, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"unsupported compression: {packed}")
    tiled, apart = 322 in tags, tags.get(284, (1,))[0] == 2 and bands > 1
    wide, tall = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    if sy < 0:
        raise ValueError("south-up rasters aren't read")
    tie, nodata, keys = tags.get(33922, (0.0,) * 6), tags.get(42113), tags.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    meta = {
        "width": width, "height": height, "bands": bands, "pixel_size": sx, "x_min": tie[3] - tie[0] * sx, "y_min": tie[4] + tie[1] * sy - height * sy,
        "nodata": float(nodata[0].split(b"\0")[0]) if nodata else None, "epsg": codes.get(3072) or codes.get(2048), "dtype": _TYPES[form],
    }
    return Tiff(width, height, bands, _TYPES[form], order, packed, predictor, tiled, apart, wide, tall, np.array(offsets, np.int64), np.array(sizes, np.int64), meta)


def decode(raw: bytes, band: int = 1) -> tuple[np.ndarray, dict]:
    """Values of a band (from 1) of a whole file in memory with row 0 south, and metadata."""
    read = lambda at, n: raw[at : at + n]
    tiff = parse(read)
    if not 1 <= band <= tiff.bands:
        raise ValueError(f"the file has {tiff.bands} bands, not {band}")
    values = np.zeros((tiff.height, tiff.width), tiff.kind)
    for k in range(tiff.across * tiff.down):
        top, left, rows, cols = tiff.block(k)
        values[top : top + rows, left : left + cols] = tiff.values(read(*tiff.place(k, band)), k, band)
    return values[::-1], tiff.meta


def encode(values: np.ndarray, x_min: float, y_min: float, pixel_size: float, epsg: int = 3857, nodata: float = -9999.0, deflate: bool = True) -> bytes:
    """A float32 file of one strip from values with row 0 south."""
    height, width = values.shape
    body = np.where(np.isfinite(values), values, nodata)[::-1].astype("<f4").tobytes()
    body = zlib.compress(body) if deflate else body
    text = f"{nodata:g}\0".encode()
    entries = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (32,)), (259, 3, (8 if deflate else 1,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (height,)), (279, 4, (len(body),)), (339, 3, (3,)),
        (33550, 12, (pixel_size, pixel_size, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x_min, y_min + height * pixel_size, 0.0)), (34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)), (42113, 2, (text,)),
    ]
    start = 8 + len(body) + len(body) % 2
    extra_at, table, extra = start + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, vals in entries:
        n = len(vals[0]) if kind == 2 else len(vals)
        data = struct.pack("<" + (f"{n}s" if kind == 2 else _KINDS[kind] * n), *vals)
        held = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", extra_at + len(extra))
        if len(data) > 4:
            extra += data + b"\0" * (len(data) % 2)
        table += struct.pack("<HHI", tag, kind, n) + held
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(entries)) + table + b"\0\0\0\0" + extra


def encode_tiled(values: np.ndarray, x_min: float, y_min: float, pixel_size: float, epsg: int = 3857, nodata: float = -9999.0, tile: int = 256, big: bool = False) -> bytes:
    """A float32 file of deflated tiles from values (bands, rows, columns) with row 0 south, bands interleaved; ``big`` makes a file for more than 4 GB."""
    bands, height, width = values.shape
    north = np.where(np.isfinite(values), values, nodata)[:, ::-1].astype("<f4")
    blocks = []
    for top in range(0, height, tile):
        for left in range(0, width, tile):
            block = np.full((tile, tile, bands), nodata, "<f4")
            part = north[:, top : top + tile, left : left + tile].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()))
    number, word, inline, start = ("Q", "Q", 8, 16) if big else ("I", "I", 4, 8)
    places = start + np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
    wide = 16 if big else 4
    entries = [
        (256, 4, (width,)), (257, 4, (height,)), (258, 3, (32,) * bands), (259, 3, (8,)), (262, 3, (1,)), (277, 3, (bands,)), (322, 4, (tile,)), (323, 4, (tile,)), (324, wide, tuple(map(int, places[:-1]))), (325, wide, tuple(map(len, blocks))), (339, 3, (3,) * bands),
        (33550, 12, (pixel_size, pixel_size, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x_min, y_min + height * pixel_size, 0.0)), (34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)), (42113, 2, (f"{nodata:g}\0".encode(),)),
    ]
    at = int(places[-1])
    extra_at, table, extra = at + (8 if big else 2) + (4 + struct.calcsize("<" + word) + inline) * len(entries) + struct.calcsize("<" + number), b"", b""
    for tag, kind, vals in entries:
        n = len(vals[0]) if kind == 2 else len(vals)
        data = struct.pack("<" + (f"{n}s" if kind == 2 else _KINDS[kind] * n), *vals)
        held = data.ljust(inline, b"\0") if len(data) <= inline else struct.pack("<" + number, extra_at + len(extra))
        extra += data if len(data) > inline else b""
        table += struct.pack("<HH" + word, tag, kind, n) + held
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, at) if big else struct.pack("<HI", 42, at))
    return head + b"".join(blocks) + struct.pack("<" + ("Q" if big else "H"), len(entries)) + table + struct.pack("<" + number, 0) + extra


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


def list_files(path: str) -> list[str]:
    """``.tif`` and ``.tiff`` files at or below a path, by name."""
    fs, place = _opened(path)
    prefix = path[: -len(place)] if "://" in path and path.endswith(place) else ""
    info = fs.get_file_info(place)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = fs.get_file_info(arrow_fs.FileSelector(place, recursive=True))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.lower().endswith((".tif", ".tiff")))


def reader_of(path: str) -> Read:
    fs, place = _opened(path)
    file = fs.open_input_file(place)

    def read(at: int, n: int) -> bytes:
        return file.read_at(max(0, min(n, file.size() - at)), at)

    return read


@dataclass
class _Blocks(InputPartition):
    """A run of blocks of one band of a file."""

    path: str
    band: int
    tiff: Tiff
    first: int
    places: list[tuple[int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("taskBytes", TASK_BYTES))
        self.low, self.high = dict.fromkeys(("row", "col", "band"), 0), dict.fromkeys(("row", "col", "band"), 1 << 62)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on row, col and band choose blocks; Spark still applies every filter to the cells."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute[0] in self.low:
                name = f.attribute[0]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[name] = max(self.low[name], f.value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[name] = min(self.high[name], f.value)
            yield f

    def _wanted(self, tiff: Tiff) -> np.ndarray:
        """Numbers of the blocks that meet the window."""
        k = np.arange(tiff.across * tiff.down)
        top, left = k // tiff.across * tiff.tall, k % tiff.across * tiff.wide
        south, north = tiff.height - np.minimum(top + tiff.tall, tiff.height), tiff.height - 1 - top
        east = np.minimum(left + tiff.wide, tiff.width) - 1
        return k[(south <= self.high["row"]) & (north >= self.low["row"]) & (left <= self.high["col"]) & (east >= self.low["col"])]

    def partitions(self) -> list[_Blocks]:
        out = []
        for path in list_files(self.path):
            tiff = parse(reader_of(path))
            wanted = self._wanted(tiff)
            step = max(1, self.task_bytes // (tiff.wide * tiff.tall * (1 if tiff.apart else tiff.bands) * np.dtype(tiff.kind).itemsize))
            slim = Tiff(**vars(tiff) | {"offsets": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int64)})
            for band in range(max(1, self.low["band"]), min(tiff.bands, self.high["band"]) + 1):
                for a in range(0, len(wanted), step):
                    run = [(int(k), *tiff.place(int(k), band)) for k in wanted[a : a + step]]
                    out.append(_Blocks(path, band, slim, int(wanted[a]), run))
        return out

    def read(self, part: _Blocks | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partition at all
            return
        read, tiff = reader_of(part.path), part.tiff
        for k, at, n in part.places:
            if not n:  # a block that was never written
                continue
            top, left, rows, cols = tiff.block(k)
            data = tiff.values(read(at, n), k, part.band).astype(float).ravel()
            gone = ~np.isfinite(data) | (data == tiff.meta["nodata"] if tiff.meta["nodata"] is not None else False)
            i, j = np.divmod(np.arange(rows * cols), cols)
            columns = [pa.array([part.path] * len(data)), pa.array(np.full(len(data), part.band, np.int32)), pa.array((tiff.height - 1 - top - i).astype(np.int32)), pa.array((left + j).astype(np.int32)), pa.array(data, mask=gone)]
            yield pa.record_batch(columns, ["path", "band", "row", "col", "value"])


class TiffSource(DataSource):
    """Every cell of every band of the files at or below a path; nodata and non-finite values are null, cells of blocks never written are absent."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_meta(spark, path: str) -> DataFrame:
    """One row of metadata for each file, from byte ranges of its header; of a file that isn't read the error, and no more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in META.split(", ")]
        for part in parts:
            rows = []
            for p in part["path"]:
                try:
                    rows.append(parse(reader_of(p)).meta | {"path": p})
                except (ValueError, KeyError, struct.error) as e:
                    rows.append({"path": p, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    files = list_files(path)
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return listed.repartition(max(1, min(len(files), 1000)), "path").mapInPandas(run, META)


def read_cells(spark, path: str, band: int = 1, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, row, col, value of every cell of a band of every file that has it, nodata and non-finite values as null."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cells = spark.read.format("geotiff").option("taskBytes", task_bytes).load(path)
    return cells.where(F.col("band") == band).select("path", "row", "col", "value")


def write_tiles(cells: DataFrame, folder: str, x_min: float, y_min: float, pixel_size: float, height: int, width: int, epsg: int = 3857, tile: int = 256) -> DataFrame:
    """Write cells(row, col, value) below folder as one file for each square of ``tile`` cells that has any, and return path, n.

    A task holds one square. A file is written under another name and then moved, so a task that is lost or repeated
    leaves no half of a file; the folder is one that all executors share.
    """
    fs, place = _opened(folder)
    fs.create_dir(place, recursive=True)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        values = np.full((1, min(tile, height - i * tile), min(tile, width - j * tile)), np.nan)
        values[0, part["row"] - i * tile, part["col"] - j * tile] = part["value"].astype(float)
        body = encode_tiled(values, x_min + j * tile * pixel_size, y_min + i * tile * pixel_size, pixel_size, epsg, tile=16 * max(1, -(-max(values.shape[1:]) // 16)) if max(values.shape[1:]) < tile else tile)
        out_fs, at = _opened(folder)
        name = f"{at.rstrip('/')}/{i:06d}_{j:06d}"
        half = f"{name}.{uuid.uuid4().hex}.part"
        with out_fs.open_output_stream(half) as f:
            f.write(body)
        out_fs.move(half, f"{name}.tif")
        return pd.DataFrame({"path": [f"{folder.rstrip('/')}/{i:06d}_{j:06d}.tif"], "n": [int(part["value"].notna().sum())]})

    inside = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return inside.groupBy(F.floor(F.col("row") / tile).alias("i"), F.floor(F.col("col") / tile).alias("j")).applyInPandas(run, "path string, n long")

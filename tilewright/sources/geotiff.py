"""GeoTIFF rasters: a writer, a reader of metadata and windows, and a Spark data source.

Strips and tiles, none or DEFLATE compression, predictors 1 and 2, chunky and
planar layouts, 8 to 64 bit numbers, GeoKeys for the coordinate system, GDAL's
nodata tag and alpha as an extra sample.

``read_tiles`` goes through ``binaryFile``, so it reaches any store that Spark
reads; a file's windows are then split over tasks. ``format("geotiff")`` opens
paths on the executors themselves, a range of windows for each task, and suits
mounted file systems and files too large to hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.errors import BandError, TilewrightError
from tilewright.functions.geo import UNITS, parse_epsg, unit_of
from tilewright.operators.grid import check_grid, stride
from tilewright.schemas import AFFINE, RASTERS

_KINDS = {("u", 1): 1, ("u", 2): 1, ("u", 4): 1, ("i", 1): 2, ("i", 2): 2, ("i", 4): 2, ("f", 4): 3, ("f", 8): 3}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def write_geotiff(
    path: str, data: np.ndarray, affine: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None,
    alpha: bool = False, deflate: bool = True, rows_per_strip: int = 64, tile: int | None = None,
) -> None:
    """``data`` (bands, h, w) as a chunky little-endian file; with ``tile``, in squares of so many pixels."""
    bands, h, w = data.shape
    kind = data.dtype.kind, data.dtype.itemsize
    if kind not in _KINDS:
        raise TilewrightError(f"no such raster type: {data.dtype}")
    cube = np.ascontiguousarray(data.transpose(1, 2, 0)).astype(data.dtype.newbyteorder("<"))
    predictor = 2 if deflate and kind[0] != "f" else 1
    pieces = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                part = np.zeros((tile, tile, bands), cube.dtype)
                own = cube[r : r + tile, c : c + tile]
                part[: own.shape[0], : own.shape[1]] = own
                pieces.append(part)
    else:
        pieces = [cube[r : r + rows_per_strip] for r in range(0, h, rows_per_strip)]
    coded = []
    for p in pieces:
        if predictor == 2:
            p = np.concatenate([p[:, :1], np.diff(p, axis=1)], 1).astype(cube.dtype)
        coded.append(zlib.compress(p.tobytes()) if deflate else p.tobytes())
    colour = 2 if bands >= 3 else 1
    extra = bands - (3 if colour == 2 else 1)
    tags: list[tuple[int, int, Any]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [kind[1] * 8] * bands), (259, 3, [8 if deflate else 1]), (262, 3, [colour]), (277, 3, [bands]),
        (284, 3, [1]), (317, 3, [predictor]), (339, 3, [_KINDS[kind]] * bands),
    ]
    if extra:
        tags.append((338, 3, [0] * (extra - 1) + [2 if alpha else 0]))
    where = [(324, 325)] if tile else [(273, 279)]
    tags += [(322, 3, [tile]), (323, 3, [tile])] if tile else [(278, 4, [rows_per_strip])]
    if affine:
        a, b, c, d, e, f = affine
        if b == 0 and d == 0:
            tags += [(33550, 12, [a, -e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
        else:
            tags.append((34264, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if epsg:
        geographic = epsg == 4326
        tags.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]))
    if nodata is not None:
        tags.append((42113, 2, f"{nodata:g}\0".encode()))
    at = 8
    offsets = []
    for c in coded:
        offsets.append(at)
        at += len(c)
    tags += [(where[0][0], 4, offsets), (where[0][1], 4, [len(c) for c in coded])]
    at += at % 2
    entries, extra_data = [], b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, typ, value in sorted(tags):
        raw = value if typ == 2 else struct.pack(f"<{len(value)}{_FORMATS[typ]}", *value)
        count = len(raw) if typ == 2 else len(value)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, typ, count) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, typ, count, base + len(extra_data)))
            extra_data += raw + b"\0" * (len(raw) % 2)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", at))
        for c in coded:
            f.write(c)
        f.write(b"\0" * (at - f.tell()))
        f.write(struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + extra_data)


class GeoTiff:
    """An open file: metadata at once, pixels by window."""

    def __init__(self, file: BinaryIO):
        self.file = file
        head = file.read(8)
        if head[:4] not in (b"II*\0", b"MM\0*"):
            raise TilewrightError("not a TIFF")
        self.order = "<" if head[:2] == b"II" else ">"
        self.tags = self._directory(struct.unpack(f"{self.order}I", head[4:])[0])
        one = lambda t, d=None: self.tags.get(t, [d])[0]
        self.width, self.height, self.bands = one(256), one(257), one(277, 1)
        if not self.bands:
            raise BandError("a raster without bands")
        kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one(258, 8) // 8}")
        self.compression, self.predictor, self.planar = one(259, 1), one(317, 1), one(284, 1) == 2
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise TilewrightError(f"compression {self.compression} with predictor {self.predictor} isn't supported")
        self.tiled = 322 in self.tags
        self.block_w, self.block_h = (one(322), one(323)) if self.tiled else (self.width, min(one(278, self.height), self.height))
        self.offsets, self.sizes = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])
        text = self.tags.get(42113)
        self.nodata = float(bytes(text).split(b"\0")[0]) if text else None
        extras = self.tags.get(338, [])
        self.has_alpha = self.bands >= 4 and bool(extras) and extras[-1] in (1, 2)
        self.affine, self.epsg = self._affine(), self._epsg()

    def _directory(self, at: int) -> dict[int, list]:
        self.file.seek(at)
        (n,) = struct.unpack(f"{self.order}H", self.file.read(2))
        raw, out = self.file.read(12 * n), {}
        for k in range(n):
            tag, typ, count = struct.unpack(f"{self.order}HHI", raw[12 * k : 12 * k + 8])
            size = _SIZES.get(typ, 1) * count
            if size <= 4:
                data = raw[12 * k + 8 : 12 * k + 8 + size]
            else:
                self.file.seek(struct.unpack(f"{self.order}I", raw[12 * k + 8 : 12 * k + 12])[0])
                data = self.file.read(size)
            out[tag] = list(data) if typ not in _FORMATS else list(struct.unpack(f"{self.order}{count}{_FORMATS[typ]}", data))
        return out

    def _affine(self) -> tuple[float, ...] | None:
        if m := self.tags.get(34264):
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if (s := self.tags.get(33550)) and (t := self.tags.get(33922)):
            return s[0], 0.0, t[3] - t[0] * s[0], 0.0, -s[1], t[4] + t[1] * s[1]
        return None

    def _epsg(self) -> int | None:
        keys = self.tags.get(34735, [])
        own = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = own.get(3072) or own.get(2048)
        return code if code and code != 32767 else None

    def metadata(self, raster_id: str, uri: str) -> dict[str, Any]:
        a = self.affine or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
        xs = [a[0] * x + a[1] * y + a[2] for x in (0, self.width) for y in (0, self.height)]
        ys = [a[3] * x + a[4] * y + a[5] for x in (0, self.width) for y in (0, self.height)]
        unit = unit_of(parse_epsg(self.epsg))
        return {
            "raster_id": raster_id, "uri": uri, "epsg": self.epsg, "affine": dict(zip("abcdef", a, strict=True)), "width": self.width, "height": self.height,
            "band_count": self.bands, "dtype": self.dtype.newbyteorder("=").name, "nodata": self.nodata, "has_alpha": self.has_alpha,
            "bounds": {"left": min(xs), "bottom": min(ys), "right": max(xs), "top": max(ys)},
            "gsd_m": (abs(a[0]) + abs(a[4])) / 2 * UNITS[unit] if unit else None,
        }

    def _block(self, row: int, col: int, plane: int) -> np.ndarray:
        across, down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        i = (plane * down + row) * across + col
        self.file.seek(self.offsets[i])
        raw = self.file.read(self.sizes[i])
        raw = raw if self.compression == 1 else zlib.decompress(raw)
        n = 1 if self.planar else self.bands
        rows = self.block_h if self.tiled else min(self.block_h, self.height - row * self.block_h)
        own = np.frombuffer(raw, self.dtype, rows * self.block_w * n).reshape(rows, self.block_w, n)
        return np.cumsum(own, 1, dtype=self.dtype.newbyteorder("=")) if self.predictor == 2 else own

    def window(self, col: int, row: int, w: int, h: int, bands: list[int] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(bands, h, w) and, with a nodata value, where all these bands have it; beyond the raster is nodata, or 0."""
        own = bands or list(range(1, self.bands + 1))
        if max(own) > self.bands:
            raise BandError(f"band {max(own)} of {self.bands}", bands=own)
        out = np.full((len(own), h, w), 0 if self.nodata is None else self.nodata, self.dtype.newbyteorder("="))
        r0, r1, c0, c1 = max(0, row), min(self.height, row + h), max(0, col), min(self.width, col + w)
        if r0 < r1 and c0 < c1:
            for br in range(r0 // self.block_h, (r1 - 1) // self.block_h + 1):
                for bc in range(c0 // self.block_w, (c1 - 1) // self.block_w + 1):
                    top, left = br * self.block_h, bc * self.block_w
                    y0, x0 = max(r0, top), max(c0, left)
                    blocks: dict[int, np.ndarray] = {}
                    for k, band in enumerate(own):
                        plane = band - 1 if self.planar else 0
                        if plane not in blocks:
                            blocks[plane] = self._block(br, bc, plane)
                        b = blocks[plane]
                        y1, x1 = min(r1, top + b.shape[0]), min(c1, left + b.shape[1])
                        out[k, y0 - row : y1 - row, x0 - col : x1 - col] = b[y0 - top : y1 - top, x0 - left : x1 - left, 0 if self.planar else band - 1]
        return out, None if self.nodata is None else (out == self.nodata).all(0)


def _windows(width: int, height: int, tile: int, overlap: float) -> list[tuple[int, int, int, int]]:
    step = stride(tile, overlap)
    return [(c, r, min(tile, width - c), min(tile, height - r)) for r in range(0, height, step) for c in range(0, width, step)]


PIXELS = f"raster_id string, epsg int, affine {AFFINE}, tile_idx int, col_off int, row_off int, w int, h int, bands array<array<float>>, mask array<boolean>"


def _tile_row(tiff: GeoTiff, raster_id: str, i: int, window: tuple[int, int, int, int], bands: list[int] | None) -> tuple:
    col, row, w, h = window
    data, mask = tiff.window(col, row, w, h, bands)
    affine = dict(zip("abcdef", tiff.affine or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True))
    flat = data.astype(np.float32).reshape(len(data), -1)
    return raster_id, tiff.epsg, affine, i, col, row, w, h, [b.tolist() for b in flat], None if mask is None else mask.ravel().tolist()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under ``path`` (a file, a folder or a pattern); no pixels are decoded."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [GeoTiff(io.BytesIO(data.as_py())).metadata(p.as_py().rsplit("/", 1)[-1], p.as_py()) for p, data in zip(*batch.columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow_rasters())

    return _files(spark, path).mapInArrow(run, RASTERS)


def _arrow_rasters() -> pa.Schema:
    affine = pa.struct([(c, pa.float64()) for c in "abcdef"])
    bounds = pa.struct([(c, pa.float64()) for c in ("left", "bottom", "right", "top")])
    return pa.schema(
        [
            ("raster_id", pa.string()), ("uri", pa.string()), ("epsg", pa.int32()), ("affine", affine), ("width", pa.int32()), ("height", pa.int32()),
            ("band_count", pa.int32()), ("dtype", pa.string()), ("nodata", pa.float64()), ("has_alpha", pa.bool_()), ("bounds", bounds), ("gsd_m", pa.float64()),
        ]
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if not path.lower().endswith((".tif", ".tiff", ".geotiff")):
        reader = reader.option("pathGlobFilter", "*.{tif,tiff,geotiff,TIF,TIFF,GEOTIFF}")
    return reader.load(path).select("path", "content")


def read_tiles(spark: SparkSession, path: str, tile: int = 576, overlap: float = 0.2, bands: list[int] | None = None) -> DataFrame:
    """The windows of every file under ``path`` with their pixels (``PIXELS``)."""
    return tiles_of(_files(spark, path), tile, overlap, bands)


def tiles_of(files: DataFrame, tile: int, overlap: float, bands: list[int] | None = None) -> DataFrame:
    """The windows (``PIXELS``) of files (path, content); bands beyond a raster's become its last."""
    import io

    check_grid(tile, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*batch.columns, strict=True):
                tiff = GeoTiff(io.BytesIO(data.as_py()))
                for i, window in enumerate(_windows(tiff.width, tiff.height, tile, overlap)):
                    yield _arrow_tile(_tile_row(tiff, p.as_py().rsplit("/", 1)[-1], i, window, _there(tiff, bands)))

    return files.select("path", "content").mapInArrow(run, PIXELS)


def _arrow_tile(row: tuple) -> pa.RecordBatch:
    kinds = (
        pa.string(), pa.int32(), pa.struct([(c, pa.float64()) for c in "abcdef"]), *[pa.int32()] * 5, pa.list_(pa.list_(pa.float32())), pa.list_(pa.bool_()),
    )
    names = ("raster_id", "epsg", "affine", "tile_idx", "col_off", "row_off", "w", "h", "bands", "mask")
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=list(names))


class _Windows(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",")
        self.tile, self.overlap = int(options.get("tile", 576)), float(options.get("overlap", 0.2))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.each = int(options.get("windowsPerTask", 64))
        check_grid(self.tile, self.overlap)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with open(path, "rb") as f:
                tiff = GeoTiff(f)
                n = len(_windows(tiff.width, tiff.height, self.tile, self.overlap))
            out += [_Windows(path, k, min(n, k + self.each)) for k in range(0, n, self.each)]
        return out

    def read(self, partition: _Windows) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            tiff = GeoTiff(f)
            windows = _windows(tiff.width, tiff.height, self.tile, self.overlap)
            for i in range(partition.first, partition.end):
                r = _tile_row(tiff, partition.path.rsplit("/", 1)[-1], i, windows[i], self.bands)
                yield (*r[:2], tuple(r[2].values()), *r[3:])


class GeoTiffSource(DataSource):
    """``spark.dataSource.register(GeoTiffSource)``, then ``spark.read.format("geotiff").option("path", ...).load()``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: Any) -> DataSourceReader:
        return GeoTiffReader(self.options)


def sample_limits(tiff: GeoTiff, bands: list[int] | None = None, samples: int = 20, size: int = 512, seed: int = 42, low: float = 2, high: float = 98) -> tuple[list[float], list[float]]:
    """(vmin, vmax) of each band, from windows drawn with replacement; a small raster is one window."""
    rng = np.random.default_rng(seed)
    if tiff.width <= size and tiff.height <= size:
        places = [(0, 0)]
    else:
        places = [(int(rng.integers(0, max(1, tiff.width - size + 1))), int(rng.integers(0, max(1, tiff.height - size + 1)))) for _ in range(samples)]
    parts = [tiff.window(c, r, min(size, tiff.width), min(size, tiff.height), bands)[0] for c, r in places]
    pooled = np.concatenate([p.reshape(len(p), -1) for p in parts], 1).astype(float)
    vmin, vmax = [], []
    for band in pooled:
        own = band if tiff.nodata is None else band[band != tiff.nodata]
        a, b = np.percentile(own, (low, high)) if len(own) else (0.0, 1.0)
        vmin.append(float(a))
        vmax.append(float(b))
    return vmin, vmax


def read_limits(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """(raster_id, vmin, vmax) of every file under ``path``: a row for each raster, sampled by the task that reads it."""
    import io

    kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*batch.columns, strict=True):
                tiff = GeoTiff(io.BytesIO(data.as_py()))
                row = (p.as_py().rsplit("/", 1)[-1], *sample_limits(tiff, _there(tiff, bands)))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["raster_id", "vmin", "vmax"])

    return _files(spark, path).mapInArrow(run, "raster_id string, vmin array<double>, vmax array<double>")


def _there(tiff: GeoTiff, bands: list[int] | None) -> list[int] | None:
    """Bands beyond the raster's become its last."""
    return None if bands is None else [min(b, tiff.bands) for b in bands]


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, detections, error) of the files under ``path`` that aren't rasters: detections is -1, as reports count failures."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for p, data in zip(*batch.columns, strict=True):
                try:
                    GeoTiff(io.BytesIO(data.as_py()))
                except Exception as e:  # noqa: BLE001
                    bad.append((p.as_py(), -1, f"{type(e).__name__}: {e}"))
            columns = zip(*bad, strict=True) if bad else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "detections", "error"])

    return _files(spark, path).mapInArrow(run, "path string, detections bigint, error string")


def raster_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the rasters of a folder, not of those below it."""
    glob = "*.{tif,tiff,geotiff,TIF,TIFF,GEOTIFF}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.col("length")).distinct().orderBy("path")

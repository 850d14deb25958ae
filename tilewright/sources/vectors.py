"""Polygon annotations from GeoJSON, GeoPackage, Shapefile and COCO files, all as one relation.

(ann_id, class_name, class_id, rings array<ring>): a row for each polygon, so a
multipolygon gives several rows with one ann_id; rings[0] is the outer one.
"""

from __future__ import annotations

import sqlite3
import struct
import tempfile
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.schemas import RING

ANNOTATIONS = f"ann_id bigint, class_name string, class_id int, rings array<{RING}>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema([("ann_id", pa.int64()), ("class_name", pa.string()), ("class_id", pa.int32()), ("rings", pa.list_(pa.list_(_POINT)))])


def _checked(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        warnings.warn(f"{path} has no annotations", UserWarning, stacklevel=3)
    return df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection; polygons only. ``class_name`` and ``class_id`` are read where they are."""
    schema = (
        "features array<struct<properties: struct<class_name: string, class_id: int>,"
        "geometry: struct<type: string, coordinates: string>>>"
    )
    docs = spark.read.schema(schema).json(path, multiLine=True)
    rows = docs.select(F.posexplode("features").alias("ann_id", "f")).select(
        F.col("ann_id").cast("bigint").alias("ann_id"), F.col("f.properties.class_name"), F.col("f.properties.class_id"), F.col("f.geometry.type").alias("type"),
        F.col("f.geometry.coordinates").alias("c"),
    )
    three, four = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", three))).when(F.col("type") == "MultiPolygon", F.from_json("c", four))
    out = rows.select("ann_id", "class_name", "class_id", F.explode(polygons).alias("p"))
    rings = F.transform("p", lambda r: F.transform(r, lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))))
    return _checked(out.select("ann_id", "class_name", "class_id", rings.alias("rings")), path)


def parse_wkb(data: bytes, at: int = 0) -> tuple[list[list[list[dict]]], int]:
    """(polygons, end) of a polygon, multipolygon or collection."""
    order = "<" if data[at] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", data, at + 1)
    at += 9
    if kind % 1000 == 3:
        size = 3 if kind // 1000 else 2
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(f"{order}I", data, at)
            v = struct.unpack_from(f"{order}{size * m}d", data, at + 4)
            rings.append([{"x": v[size * i], "y": v[size * i + 1]} for i in range(m)])
            at += 4 + 8 * size * m
        return [rings], at
    out = []
    if kind % 1000 in (6, 7):
        for _ in range(n):
            own, at = parse_wkb(data, at)
            out += own
    return out, at


def _gpkg_rows(content: bytes, layer: str | None) -> list[dict]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # of this task alone, gone when it ends
        f.write(content)
        f.flush()
        with sqlite3.connect(f.name) as db:
            found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall()
            name, column = next((t, c) for t, c in found if layer in (None, t))
            fields = [r[1] for r in db.execute(f'PRAGMA table_info("{name}")')]
            rows = []
            for k, r in enumerate(db.execute(f'SELECT * FROM "{name}"')):
                own = dict(zip(fields, r, strict=True))
                blob = own[column]
                skip = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                rows += [
                    {"ann_id": k, "class_name": own.get("class_name"), "class_id": own.get("class_id"), "rings": p} for p in parse_wkb(blob, skip)[0]
                ]
            return rows


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer's polygons, the first layer's by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist(_gpkg_rows(content.as_py(), layer), _ARROW)

    return _checked(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ANNOTATIONS), path)


def _area(ring: list[dict]) -> float:
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:], strict=False))


def parse_shapefile(shp: bytes, dbf: bytes) -> list[dict]:
    """Polygons and their class fields; rings that go clockwise are outer ones."""
    count, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 1
    for k in range(32, head - 1, 32):
        fields.append((dbf[k : k + 11].split(b"\0")[0].decode(), at, dbf[k + 16]))
        at += dbf[k + 16]
    rows, at = [], 100
    for k in range(count):
        (words,) = struct.unpack_from(">I", shp, at + 4)
        record, at = at + 8, at + 8 + 2 * words
        line = dbf[head + k * width : head + (k + 1) * width]
        own = {n: line[a : a + size].decode().strip() for n, a, size in fields}
        if struct.unpack_from("<i", shp, record)[0] != 5:
            continue
        parts, points = struct.unpack_from("<2i", shp, record + 36)
        starts = [*struct.unpack_from(f"<{parts}i", shp, record + 44), points]
        v = struct.unpack_from(f"<{2 * points}d", shp, record + 44 + 4 * parts)
        polygons: list[list] = []
        for a, b in zip(starts, starts[1:], strict=False):
            ring = [{"x": v[2 * i], "y": v[2 * i + 1]} for i in range(a, b)]
            if _area(ring) <= 0 or not polygons:
                polygons.append([ring])
            else:
                polygons[-1].append(ring)
        number = own.get("class_id")
        rows += [{"ann_id": k, "class_name": own.get("class_name") or None, "class_id": int(float(number)) if number else None, "rings": p} for p in polygons]
    return rows


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """A shapefile's polygons; the .dbf lies beside the .shp."""
    stem = path.removesuffix(".shp")
    files = spark.read.format("binaryFile").load([f"{stem}.shp", f"{stem}.dbf"])
    pair = files.groupBy().agg(
        F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_pylist(parse_shapefile(shp.as_py(), dbf.as_py()), _ARROW)

    return _checked(pair.mapInArrow(run, ANNOTATIONS), path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Annotations by the file's ending."""
    low = path.lower()
    return read_geopackage(spark, path) if low.endswith(".gpkg") else read_shapefile(spark, path) if low.endswith(".shp") else read_geojson(spark, path)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO file; annotations join images on image_id."""
    schema = (
        "images array<struct<id: bigint, file_name: string, width: int, height: int>>,"
        "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double, iscrowd: int>>,"
        "categories array<struct<id: int, name: string>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))  # type: ignore[return-value]


def bounds(ring: Column) -> list[Column]:
    """x1, y1, x2, y2 of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]

"""Results as rows of COCO, YOLO, GeoJSON and styled features, and as files.

Lines and features are built by expressions and written by Spark. Formats that
are one file by nature (GeoPackage, Shapefile) are written by the driver from an
iterator over partitions, which holds one partition at a time.
"""

from __future__ import annotations

import csv
import json
import os
import sqlite3
import struct
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.errors import ExportError
from tilewright.functions.boxes import box
from tilewright.functions.geo import reproject_ring
from tilewright.functions.labels import MISSING_COLOUR
from tilewright.operators.numbering import numbered


def _not_empty(df: DataFrame | None) -> DataFrame:
    if df is None or df.isEmpty():
        raise ExportError("there are no detections to write")
    return df


# --- COCO and YOLO ------------------------------------------------------------


def coco_annotations(df: DataFrame, order: str = "det_id") -> DataFrame:
    """(id, image_id, category_id, bbox_x.., area) of one image's boxes, numbered from 0 in the order of ids.

    A row without a box keeps its number and gives no annotation.
    """
    x1, y1, x2, y2 = box()
    return numbered(df, [order]).where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").select(
        "id",
        F.lit(0).alias("image_id"),
        F.col("class_id").cast("int").alias("category_id"),
        x1.alias("bbox_x"),
        y1.alias("bbox_y"),
        (x2 - x1).alias("bbox_w"),
        (y2 - y1).alias("bbox_h"),
        ((x2 - x1) * (y2 - y1)).alias("area"),
    )


def categories(df: DataFrame) -> DataFrame:
    """(id, name) of the classes there are, by id."""
    name = F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return df.groupBy(F.col("class_id").alias("id")).agg(F.min(name).alias("name")).orderBy("id")


def to_coco(df: DataFrame, path: str, width: int | None = None, height: int | None = None, file_name: str | None = None) -> None:
    """One image's COCO JSON: a single file by nature, written by the driver a row at a time."""
    _not_empty(df)
    with open(path, "w") as f:
        images = [{"id": 0, "file_name": os.path.basename(file_name or "image.jpg"), "width": width, "height": height}] if width and height else []
        f.write('{"images": ' + json.dumps(images) + ', "categories": ' + json.dumps([r.asDict() for r in categories(df).collect()]) + ', "annotations": [')
        for k, r in enumerate(coco_annotations(df).orderBy("id").toLocalIterator()):
            bbox = [r[c] for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
            f.write("," * (k > 0) + json.dumps({"id": r["id"], "image_id": 0, "category_id": r["category_id"], "bbox": bbox, "area": r["area"], "iscrowd": 0}))
        f.write("]}")


def yolo_line(class_id: Column, sides: tuple, width: float, height: float) -> Column:
    """class cx cy w h as shares of the image, each within 0 and 1; null for a box that is null."""
    x1, y1, x2, y2 = sides
    share = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / float(size)))
    numbers = (share((x1 + x2) / 2, width), share((y1 + y2) / 2, height), share(x2 - x1, width), share(y2 - y1, height))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.coalesce(class_id.cast("int"), F.lit(0)), *numbers)
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), line)


def to_yolo(df: DataFrame, path: str, width: int | None, height: int | None) -> None:
    """Text lines under ``path``; none without the image's size."""
    lines = df.select(yolo_line(F.col("class_id"), box(), width or 1, height or 1).alias("value")).where("value IS NOT NULL")
    (lines if width and height else lines.limit(0)).write.mode("overwrite").text(path)


# --- GeoJSON -------------------------------------------------------------------


def styled(df: DataFrame, colours: Mapping[str, str]) -> DataFrame:
    """``df`` with fill, stroke, opacity and popup; red where a class has no colour."""
    own = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair]) if colours else F.create_map(F.lit(""), F.lit(""))
    fill = F.coalesce(F.try_element_at(own, F.col("class_name")), F.lit(MISSING_COLOUR))
    parts = [F.format_string("Class: %s", "class_name"), F.format_string("Confidence: %.3f", "confidence")]
    if "area_m2" in df.columns:
        parts.append(F.format_string("Area: %.1f m2", "area_m2"))
    return df.withColumns({"fill": fill, "stroke": fill, "opacity": F.lit(0.3) + F.lit(0.5) * F.col("confidence"), "popup": F.concat_ws("<br>", *parts)})


def features(df: DataFrame, epsg: int | None, digits: int = 6, properties: list[str] | None = None) -> DataFrame:
    """(value): a GeoJSON feature of each row's ring, in degrees."""
    if epsg is not None and epsg != 4326:
        warnings.warn(f"EPSG:{epsg} is turned to EPSG:4326, which GeoJSON asks for", RuntimeWarning, stacklevel=2)
    ring = F.col("ring") if epsg in (None, 4326) else reproject_ring(F.col("ring"), epsg, 4326)
    points = F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    names = properties or [c for c in df.columns if c != "ring"]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), geometry.alias("geometry"))).alias("value"))


def to_geojson(df: DataFrame, path: str, epsg: int | None = None, simplify_tolerance: float | None = None) -> None:
    """One FeatureCollection, written by the driver a row at a time; ``simplify_tolerance`` has no effect."""
    own = features(_not_empty(df), epsg)
    try:
        with open(path, "w") as f:
            f.write('{"type": "FeatureCollection", "features": [')
            for k, r in enumerate(own.toLocalIterator()):
                f.write(",\n" * (k > 0) + r["value"])
            f.write("]}")
    except OSError as e:
        raise ExportError(f"{path} can't be written: {e}", path=path) from e


def to_geojson_lines(df: DataFrame, path: str, epsg: int | None = None) -> None:
    """Newline-delimited features, one file for each partition: what to use for large results."""
    features(_not_empty(df), epsg).write.mode("overwrite").text(path)


# --- GeoPackage and Shapefile --------------------------------------------------

_WGS84 = (
    'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
)


def _wkb(ring: list) -> bytes:
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in ring)


def wkt_of(epsg: int) -> str:
    """Well-known text of a supported system."""
    if epsg == 4326:
        return _WGS84
    zone, south = epsg % 100, epsg >= 32700
    return (
        f'PROJCS["WGS 84 / UTM zone {zone}{"S" if south else "N"}",{_WGS84},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],'
        f'PARAMETER["central_meridian",{zone * 6 - 183}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],'
        f'PARAMETER["false_northing",{10000000 if south else 0}],UNIT["metre",1]]'
    )


_SQL_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "boolean": "INTEGER"}


def to_geopackage(df: DataFrame, path: str, layer: str = "detections", epsg: int | None = None, append: bool = False) -> None:
    """A layer of polygons; ``append`` adds it to a file that is there."""
    _not_empty(df)
    if not append and os.path.exists(path):
        os.remove(path)
    columns = [(c, _SQL_TYPES[t]) for c, t in df.dtypes if t in _SQL_TYPES]
    srs = epsg or 0
    try:
        with sqlite3.connect(path) as db:
            db.execute("PRAGMA application_id = 1196444487")
            db.execute("PRAGMA user_version = 10300")
            db.executescript(
                """CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
                organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
                CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '',
                last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
                CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL,
                srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));"""
            )
            for name, i, org, text in (("Undefined cartesian", -1, "NONE", "undefined"), ("Undefined geographic", 0, "NONE", "undefined"), ("WGS 84", 4326, "EPSG", _WGS84)):
                db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", (name, i, org, i, text))
            if srs:
                db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (f"EPSG:{srs}", srs, srs, wkt_of(srs)))
            quoted = '"' + layer.replace('"', '""') + '"'
            fields = "".join(f', "{c}" {t}' for c, t in columns)
            db.execute(f"CREATE TABLE {quoted} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{fields})")
            marks = ", ".join("?" * (len(columns) + 1))
            names = "".join(f', "{c}"' for c, _ in columns)
            head = b"GP\x00\x01" + struct.pack("<i", srs)
            rows = ((head + _wkb(r["ring"]), *(r[c] for c, _ in columns)) for r in df.toLocalIterator())
            db.executemany(f"INSERT INTO {quoted} (geom{names}) VALUES ({marks})", rows)
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs))
    except (sqlite3.Error, OSError) as e:
        raise ExportError(f"{path} can't be written: {e}", path=path) from e


def to_shapefile(df: DataFrame, path: str, epsg: int | None = None) -> None:
    """.shp, .shx, .dbf and .prj beside one another; names of fields are cut to ten letters."""
    warnings.warn("shapefiles cut names to 10 letters and hold 2 GB at most", RuntimeWarning, stacklevel=2)
    _not_empty(df)
    stem = path.removesuffix(".shp")
    kinds = {"bigint": ("N", 18, 0), "int": ("N", 10, 0), "double": ("F", 24, 10), "float": ("F", 24, 10), "string": ("C", 254, 0)}
    columns = [(c, *kinds[t]) for c, t in df.dtypes if t in kinds]
    width = 1 + sum(n for _, _, n, _ in columns)
    low, high, words, count = [float("inf")] * 2, [float("-inf")] * 2, 50, 0
    try:
        with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
            for f in (shp, shx):
                f.write(b"\0" * 100)
            dbf.write(b"\0" * (32 + 32 * len(columns) + 1))
            for r in df.toLocalIterator():
                ring = [(p["x"], p["y"]) for p in r["ring"]]
                if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) > 0:
                    ring.reverse()  # outer rings go clockwise
                xs, ys = zip(*ring, strict=True)
                body = struct.pack("<i4d2ii", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
                count += 1
                shx.write(struct.pack(">2i", words, len(body) // 2))
                shp.write(struct.pack(">2i", count, len(body) // 2) + body)
                words += 4 + len(body) // 2
                low, high = [min(low[0], *xs), min(low[1], *ys)], [max(high[0], *xs), max(high[1], *ys)]
                cells = []
                for c, kind, n, digits in columns:
                    v = r[c]
                    text = "" if v is None else f"{v:.{digits}f}" if kind == "F" else str(v)
                    cells.append(text.encode()[:n].ljust(n) if kind == "C" else text.encode()[:n].rjust(n))
                dbf.write(b" " + b"".join(cells))
            dbf.write(b"\x1a")
            for f, size in ((shp, words), (shx, 50 + 4 * count)):
                f.seek(0)
                f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, 5, *low, *high, 0, 0, 0, 0))
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, count, 33 + 32 * len(columns), width))
            for c, kind, n, digits in columns:
                dbf.write(c.encode()[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([n, digits]) + b"\0" * 14)
            dbf.write(b"\r")
        if epsg:
            with open(f"{stem}.prj", "w") as f:
                f.write(wkt_of(epsg))
    except OSError as e:
        raise ExportError(f"{path} can't be written: {e}", path=path) from e


# --- reports ----------------------------------------------------------------------


def to_csv(df: DataFrame, path: str) -> None:
    """A small report, such as a threshold sweep, as one CSV file with a header."""
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def to_summary(df: DataFrame, path: str, **about: object) -> None:
    """Counts and confidences of detections as JSON."""
    row = df.agg(F.count("*").alias("total"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence")).first()
    counts = {r["class_name"]: r["n"] for r in df.groupBy("class_name").agg(F.count("*").alias("n")).orderBy("class_name").collect()}
    with open(path, "w") as f:
        json.dump({**about, **row.asDict(), "by_class": counts}, f, indent=2)

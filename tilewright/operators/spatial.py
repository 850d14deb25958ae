"""Tiles and annotations: joins, clipping and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.boxes import SIDES, clipped
from tilewright.operators.pairs import meeting


def tile_annotations(tiles: DataFrame, annotations: DataFrame, raster: str = "raster_id") -> DataFrame:
    """Tiles joined to the annotations (x1..y2 in raster pixels) that they touch; a shared border counts."""
    windows = tiles.select(
        "*",
        F.col("col_off").cast("double").alias("tx1"),
        F.col("row_off").cast("double").alias("ty1"),
        (F.col("col_off") + F.col("w")).cast("double").alias("tx2"),
        (F.col("row_off") + F.col("h")).cast("double").alias("ty2"),
    )
    return meeting(windows, annotations, [raster], ("tx1", "ty1", "tx2", "ty2"), SIDES)


def clip_to_tiles(joined: DataFrame) -> DataFrame:
    """Joined rows with the box cut off at the tile; what has no area goes."""
    window = tuple(F.col(c) for c in ("tx1", "ty1", "tx2", "ty2"))
    sides = clipped(tuple(F.col(s) for s in SIDES), window)
    return joined.withColumns(dict(zip(SIDES, sides, strict=True))).where("x2 > x1 AND y2 > y1")


def at_least(df: DataFrame, area: float, w: str = "bw", h: str = "bh") -> DataFrame:
    """Rows whose box has ``area`` square pixels or more."""
    return df.where(F.col(w) * F.col(h) >= area)


def top_n(df: DataFrame, n: int, score: str = "confidence", tie: str = "det_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def display_filter(df: DataFrame, min_confidence: float = 0.0, classes: list[str] | None = None) -> DataFrame:
    """Rows to show; a missing column leaves its condition out."""
    if min_confidence > 0 and "confidence" in df.columns:
        df = df.where(F.col("confidence") >= min_confidence)
    if classes is not None and "class_name" in df.columns:
        df = df.where(F.col("class_name").isin(classes))
    return df


def map_classes(annotations: DataFrame, mapping: dict[str, int] | None = None) -> DataFrame:
    """Annotations with class_id by name; names without one go.

    Without a mapping, ids are places in the sorted list of names: the names
    are few, and only they are numbered in one task.
    """
    own = annotations.drop("class_id")
    if mapping is None:
        names = own.select("class_name").where("class_name IS NOT NULL").distinct()
        ids = names.select("class_name", (F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_id"))
    else:
        ids = annotations.sparkSession.createDataFrame(list(mapping.items()), "class_name string, class_id int")
    return own.join(F.broadcast(ids), "class_name")


def background_cap(tiles: DataFrame, max_ratio: float, seed: int = 42, raster: str = "raster_id", annotated: str = "annotated") -> DataFrame:
    """All annotated tiles of a raster and at most max_ratio times as many others, in the order of a seeded digest."""
    by = Window.partitionBy(raster)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(raster).cast("string"), F.col("tile_idx").cast("string")))
    rank = F.row_number().over(Window.partitionBy(raster, annotated).orderBy(order, "tile_idx"))
    limit = F.floor(F.sum(F.col(annotated).cast("int")).over(by) * max_ratio)
    marked = tiles.withColumns({"__rank": rank, "__limit": limit})
    return marked.where(F.col(annotated) | (F.col("__rank") <= F.col("__limit"))).drop("__rank", "__limit")


def intersects_box(sides: tuple, area: tuple[float, float, float, float]) -> Column:
    """Whether a box touches an area of interest."""
    x1, y1, x2, y2 = sides
    return (x1 <= area[2]) & (x2 >= area[0]) & (y1 <= area[3]) & (y2 >= area[1])

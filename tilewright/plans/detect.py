"""Tiled detection: tiles -> stretch -> model -> offset -> suppression -> labels and places.

Tiles without data go before the model runs, and confidence is filtered below
the suppression. The model runs once: its boxes are written to the checkpoint
folder, as suppression reads them twice, to count groups and to thin them; they
then move by (raster, class). Limits of the stretch are given, one row for each
raster, as ``geotiff.read_limits`` samples them; where they aren't, they are worked
out over all pixels of ``tiles``, which is for small rasters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import boxes as bx
from tilewright.functions import labels, pixels
from tilewright.model import BrightBlocks, Detector, detect
from tilewright.operators.nms import nms
from tilewright.plans.state import cut


def scene_limits(tiles: DataFrame, mode: str = "percentile", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(raster_id, vmin, vmax): arrays with an entry for each band, of the pixels that have data."""
    rows = tiles.select("raster_id", "mask", F.posexplode("bands").alias("band", "vs"))
    kept = rows.select("raster_id", "band", F.explode(F.arrays_zip(F.col("vs").alias("v"), F.coalesce("mask", F.transform("vs", lambda v: F.lit(False))).alias("m"))).alias("z"))
    value = F.when(~F.col("z.m"), F.col("z.v").cast("double"))
    by = kept.groupBy("raster_id", "band")
    if mode == "minmax":
        each = by.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    else:
        each = by.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p")).select("raster_id", "band", F.col("p")[0].alias("vmin"), F.col("p")[1].alias("vmax"))
    entry = F.struct("band", F.coalesce("vmin", F.lit(0.0)).alias("vmin"), F.coalesce("vmax", F.lit(1.0)).alias("vmax"))
    whole = each.groupBy("raster_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    return whole.select("raster_id", F.col("b.vmin").alias("vmin"), F.col("b.vmax").alias("vmax"))


def detect_tiles(
    tiles: DataFrame,
    make: Callable[[], Detector] = BrightBlocks,
    threshold: float = 0.5,
    nms_threshold: float = 0.5,
    nodata_threshold: float = 0.5,
    mode: str = "percentile",
    classes: list[str] | None = None,
    names: Mapping[int, str] | None = None,
    limits: DataFrame | None = None,
    fallback_names: bool = False,
    batch: int = 8,
) -> DataFrame:
    """Detections of tiles (raster_id, affine, tile_idx, col_off, row_off, w, h, bands, mask).

    ``limits`` is (raster_id, vmin, vmax). ``classes`` are names out of ``names``;
    with ``fallback_names``, a class without a name also goes by ``class_`` and its id.
    The model runs when this is called.

    Returns raster_id, det_id, class_id, class_name, confidence, x1..y2, ring,
    centroid_x, centroid_y and area, in the raster's coordinates.
    """
    kept = tiles.where(pixels.nodata_fraction(F.col("mask")) <= nodata_threshold)
    if mode != "none":
        limits = (scene_limits(tiles, mode) if limits is None else limits).withColumnRenamed("raster_id", "__r")
        kept = kept.join(limits, F.col("raster_id") == F.col("__r")).drop("__r")
        kept = kept.withColumn("bands", pixels.fill_nodata(F.col("bands"), F.col("mask")))
        kept = kept.withColumn("bands", pixels.stretch_bands(F.col("bands"), F.col("vmin"), F.col("vmax")))
    three = F.when(F.size("bands") == 1, F.array_repeat(F.get("bands", F.lit(0)), 3)).otherwise(F.slice("bands", 1, 3))
    flat = [F.col(f"affine.{c}").alias(f"__{c}") for c in "abcdef"]
    placed = ("col_off", "row_off", *(f"__{c}" for c in "abcdef"))
    found = detect(kept.select("*", *flat).withColumn("bands", three), make, threshold, batch, placed)
    affine = F.struct(*[F.col(f"__{c}").alias(c) for c in "abcdef"]).alias("affine")
    own = found.select("raster_id", "tile_idx", *bx.offset("col_off", "row_off"), "confidence", "class_id", "ordinal", affine)
    own = own.withColumn("det_id", F.xxhash64("raster_id", "tile_idx", "ordinal")).drop("ordinal")
    own = own.withColumn("class_name", labels.class_label(F.col("class_id"), names))
    if classes is not None:  # commutes with suppression, which is within a class
        named = F.col("class_id").isin([i for i, n in (names or {}).items() if n in classes])
        own = own.where(F.col("class_name").isin(classes) if fallback_names else named)
    stays = nms(cut(own), nms_threshold)
    quad = bx.quad(F.col("affine"), bx.box())
    centre = bx.quad_centroid(F.col("affine"), bx.box())
    det = F.abs(F.col("affine.a") * F.col("affine.e") - F.col("affine.b") * F.col("affine.d"))
    return stays.select(
        "raster_id", "det_id", "class_id", "class_name", "confidence", *bx.SIDES, quad.alias("ring"), centre["x"].alias("centroid_x"), centre["y"].alias("centroid_y"),
        (det * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
    )


def derived_scene_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 4 x 4 pixels with four bands, made from the embeddings: ten rasters, by label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.floor(F.col("vec_id") / 10).cast("int")
    bands = F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)])
    affine = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcdef", (0.3, 0.0, 500000.0, 0.0, -0.3, 4000000.0), strict=True)])
    return e.select(
        (F.col("vec_id") % 10).alias("raster_id"), affine.alias("affine"), i.alias("tile_idx"), (i % 10 * 3).alias("col_off"), (F.floor(i / 10) * 3).cast("int").alias("row_off"),
        F.lit(4).alias("w"), F.lit(4).alias("h"), bands.alias("bands"), pixels.nodata_mask(bands, F.lit(0.0)).alias("mask"),
    )

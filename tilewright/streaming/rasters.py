"""Rasters as they arrive: each micro-batch of new files is a whole, so suppression needs no state."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tilewright.model import BrightBlocks, Detector
from tilewright.plans.detect import detect_tiles
from tilewright.sources.geotiff import PIXELS, tiles_of


def new_files(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """A stream of (path, content) of files that come to ``folder``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", "*.{tif,tiff,geotiff,TIF,TIFF,GEOTIFF}").load(folder).select("path", "content")


def detect_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, tile: int = 576, overlap: float = 0.2, make: Callable[[], Detector] = BrightBlocks,
    names: Mapping[int, str] | None = None, threshold: float = 0.5,
) -> StreamingQuery:
    """Detections of every new raster as Parquet, a folder for each batch, which a repeated batch writes over."""

    def one(batch: DataFrame, number: int) -> None:
        tiles = tiles_of(batch, tile, overlap)
        detect_tiles(tiles, make, threshold, names=names).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_files(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["PIXELS", "detect_stream", "new_files"]

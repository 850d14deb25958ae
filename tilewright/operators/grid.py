"""Tile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.errors import TilingError


def check_grid(tile: int, overlap: float) -> None:
    if tile <= 0:
        raise TilingError(f"tiles need a size above 0: {tile}", tile=tile)
    if not 0 <= overlap < 0.5:
        raise TilingError(f"overlap must be at least 0 and below 0.5: {overlap}", overlap=overlap)


def stride(tile: int, overlap: float) -> int:
    """Whole pixels between tiles, by double arithmetic and truncated."""
    return max(1, int(tile * (1.0 - overlap)))


def _offsets(size: Column, step: int) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def tile_grid(rasters: DataFrame, tile: int, overlap: float = 0.2, keep: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """(keep, tile_idx, col_off, row_off, w, h): row-major windows of each raster (width, height).

    Edge tiles are cut off at the raster; narrow ones stay. No shuffle: two
    generators in one code-generated stage.
    """
    check_grid(tile, overlap)
    step = stride(tile, overlap)
    width, height = F.col("width").cast("int"), F.col("height").cast("int")
    rows = rasters.select(*keep, "width", "height", F.explode(_offsets(height, step)).alias("row_off"))
    cells = rows.select("*", F.explode(_offsets(width, step)).alias("col_off"))
    across = F.ceil(width / step).cast("int")
    return cells.select(
        *keep,
        (F.floor(F.col("row_off") / step).cast("int") * across + F.floor(F.col("col_off") / step).cast("int")).alias("tile_idx"),
        "col_off",
        "row_off",
        F.least(F.lit(tile), width - F.col("col_off")).alias("w"),
        F.least(F.lit(tile), height - F.col("row_off")).alias("h"),
    )


def valid_tile_sizes(models: DataFrame) -> DataFrame:
    """(variant, tile_size): multiples of each model's block size from 128 to 2048."""
    first = (F.ceil(F.lit(128) / F.col("block_size")) * F.col("block_size")).cast("int")
    return models.select("variant", F.explode(F.sequence(first, F.lit(2048), F.col("block_size"))).alias("tile_size"))

"""Splits of tiles into train, val and test."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def check_split(method: str, ratios: tuple[float, ...]) -> None:
    if method not in ("block", "random"):
        raise ValueError(f"no split {method!r}; there are block, random")
    if not math.isclose(sum(ratios), 1.0, rel_tol=1e-6):
        raise ValueError(f"ratios must add up to 1: {ratios}")
    if len(ratios) != 3:
        raise ValueError(f"three ratios are needed: {ratios}")
    if any(r < 0 for r in ratios):
        raise ValueError(f"ratios can't be negative: {ratios}")


def _by_rank(rank: Column, n: Column, ratios: tuple[float, float, float], least_train: int) -> Column:
    """The split of the rank-th of n, from 1; sizes are rounded to even, what is left over is test."""
    train = F.greatest(F.lit(least_train), F.bround(n * F.lit(float(ratios[0])), 0))
    val = F.least(F.greatest(F.lit(0), F.bround(n * F.lit(float(ratios[1])), 0)), n - train)
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def random_split(tiles: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.15, 0.05), seed: int = 42, raster: str = "raster_id") -> DataFrame:
    """``tiles`` with split, in the order of a seeded digest."""
    check_split("random", ratios)
    warnings.warn("random splits put neighbouring tiles into different parts", UserWarning, stacklevel=2)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(raster).cast("string"), F.col("tile_idx").cast("string")))
    rank = F.row_number().over(Window.partitionBy(raster).orderBy(order, "tile_idx"))
    n = F.count("*").over(Window.partitionBy(raster))
    return tiles.withColumns({"__rank": rank, "__n": n}).withColumn("split", _by_rank(F.col("__rank"), F.col("__n"), ratios, 0)).drop("__rank", "__n")


def blocks(tiles: DataFrame, tile: int, raster: str = "raster_id") -> DataFrame:
    """``tiles`` (raster, width, height, col_off, row_off) with gx, gy, the tile's cell, and block_x, block_y."""
    n = F.count("*").over(Window.partitionBy(raster))
    cols = F.greatest(F.lit(1), F.floor(F.col("width") / tile))
    rows = F.greatest(F.lit(1), F.floor(F.col("height") / tile))
    per = F.greatest(F.lit(1), F.floor(F.sqrt(F.greatest(F.lit(3), F.floor(F.sqrt(n.cast("double")))).cast("double"))))
    bc, br = (F.greatest(F.lit(1), F.ceil(x / per)) for x in (cols, rows))
    nbx, nby = (F.greatest(F.lit(1), F.ceil(x / b)) for x, b in ((cols, bc), (rows, br)))
    gx, gy = F.floor(F.col("col_off") / tile), F.floor(F.col("row_off") / tile)
    return tiles.withColumns(
        {
            "gx": gx.cast("int"),
            "gy": gy.cast("int"),
            "block_x": F.least(F.floor(gx / bc), nbx - 1).cast("int"),
            "block_y": F.least(F.floor(gy / br), nby - 1).cast("int"),
        }
    )


def block_split(
    tiles: DataFrame, tile: int, ratios: tuple[float, float, float] = (0.8, 0.15, 0.05), buffer: int = 0, seed: int = 42, raster: str = "raster_id", order: str = "portable"
) -> DataFrame:
    """``tiles`` with block_x, block_y and split: train, val, test or buffer.

    Whole blocks go to a split. ``order="portable"`` deals blocks out in the
    order of a seeded digest; ``"parity"`` by numpy's Mersenne twister, for one
    raster, whose blocks (few) are listed on the driver. A tile that has a
    neighbour of another split within ``buffer`` cells is put aside. Tiles that
    share a cell, as they do with overlap, are all checked.
    """
    check_split("block", ratios)
    own = blocks(tiles, tile, raster)
    key = [raster, "block_x", "block_y"]
    if order == "portable":
        # all windows are over a raster's tiles: one shuffle, and no join whose sides a plan may take for small ones
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block_x").cast("string"), F.col("block_y").cast("string")))
        rank = F.dense_rank().over(Window.partitionBy(raster).orderBy(digest, "block_x", "block_y"))
        dealt = own.withColumn("__rank", rank).withColumn("__n", F.max("__rank").over(Window.partitionBy(raster)))
        split = dealt.withColumn("split", _dealt(F.col("__rank"), F.col("__n"), ratios)).drop("__rank", "__n").dropna(subset=key)
    else:
        listed = sorted(tuple(r) for r in own.select(*key).distinct().collect())
        if len({r[0] for r in listed}) > 1:
            raise ValueError("parity order is for one raster")
        places = list(range(len(listed)))
        np.random.RandomState(seed).shuffle(places)
        kind = dict(own.dtypes)[raster]
        rows = [(*listed[p], i + 1) for i, p in enumerate(places)]
        dealt = tiles.sparkSession.createDataFrame(rows, f"{raster} {kind}, block_x int, block_y int, rank int")
        split = own.join(dealt.select(*key, _dealt(F.col("rank"), F.lit(len(rows)), ratios).alias("split")), key)
    return mark_buffer(split, buffer, raster) if buffer else split


def _dealt(rank: Column, n: Column, ratios: tuple[float, float, float]) -> Column:
    """The split of the rank-th of n blocks."""
    return F.when(n <= 2, F.lit("train")).otherwise(_by_rank(rank, n, ratios, 1))


def mark_buffer(split: DataFrame, buffer: int, raster: str = "raster_id") -> DataFrame:
    """Tiles with a cell of another split within ``buffer`` cells become ``buffer``.

    Each tile looks into the columns of cells up to ``buffer`` to either side,
    where a range of rows gives the least and the greatest split around it.
    Columns are dealt out by raster, so no further shuffle follows a split's own
    and nothing is joined.
    """
    shifts = F.array(*[F.lit(dx) for dx in range(-buffer, buffer + 1)])
    looks = split.select("*", F.explode(shifts).alias("__dx")).withColumn("__x", F.col("gx") + F.col("__dx"))
    around = Window.partitionBy(raster, "__x").orderBy("gy").rangeBetween(-buffer, buffer)
    other = F.min("split").over(around) != F.max("split").over(around)
    own = looks.withColumn("__other", other).where("__dx = 0")
    return own.withColumn("split", F.when(F.col("__other") & F.col(raster).isNotNull() & F.col("gx").isNotNull() & F.col("gy").isNotNull(), "buffer").otherwise(F.col("split"))).select(split.columns)

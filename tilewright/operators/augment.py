"""Augmentation of training boxes: flips and quarter turns of a tile and all its boxes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AugmentationPreset:
    """Which changes a preset makes, and how far brightness, contrast and saturation move."""

    name: str
    rotation: bool
    horizontal_flip: bool
    vertical_flip: bool
    jitter: tuple[float, float, float]


AUGMENTATION_PRESETS = {
    "satellite_default": AugmentationPreset("satellite_default", True, True, True, (0.2, 0.2, 0.1)),
    "aerial_default": AugmentationPreset("aerial_default", True, True, True, (0.3, 0.3, 0.15)),
    "drone_default": AugmentationPreset("drone_default", True, True, True, (0.4, 0.4, 0.2)),
}


def turned(sides: tuple, w: Column, h: Column, turns: Column) -> tuple[Column, ...]:
    """(x, y, bw, bh, w, h) after quarter turns clockwise: (H-y-bh, x, bh, bw) with W and H swapped, ``turns`` times."""
    x, y, bw, bh = sides
    k = F.pmod(turns, F.lit(4))
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3])
    return (
        pick(x, h - y - bh, w - x - bw, y),
        pick(y, x, h - y - bh, w - x - bw),
        pick(bw, bh, bw, bh),
        pick(bh, bw, bh, bw),
        pick(w, h, w, h),
        pick(h, w, h, w),
    )


def augment(boxes: DataFrame, preset: AugmentationPreset, factor: int = 2, seed: int = 42) -> DataFrame:
    """``boxes`` (image_id, ann_id, bx, by, bw, bh, w, h) and factor - 1 copies of each with copy, turns, hflip, vflip.

    A copy's choices come from a digest of seed, image and copy, so that all
    boxes of an image agree without a join.
    """
    copies = boxes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))

    def chance(what: str) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("copy").cast("string"), F.lit(what))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    is_copy = F.col("copy") > 0
    chosen = copies.withColumns(
        {
            "turns": F.when(is_copy & F.lit(preset.rotation) & (chance("rot") % 2 == 0), chance("k") % 3 + 1).otherwise(0).cast("int"),
            "hflip": is_copy & F.lit(preset.horizontal_flip) & (chance("h") % 2 == 0),
            "vflip": is_copy & F.lit(preset.vertical_flip) & (chance("v") % 2 == 0),
        }
    )
    sides = tuple(F.col(c) for c in ("bx", "by", "bw", "bh"))
    x, y, bw, bh, w, h = turned(sides, F.col("w"), F.col("h"), F.col("turns"))
    rotated = chosen.withColumns({"bx": x, "by": y, "bw": bw, "bh": bh, "w": w, "h": h})
    return rotated.withColumns(
        {
            "bx": F.when(F.col("hflip"), F.col("w") - F.col("bx") - F.col("bw")).otherwise(F.col("bx")),
            "by": F.when(F.col("vflip"), F.col("h") - F.col("by") - F.col("bh")).otherwise(F.col("by")),
        }
    )


def augment_pixels(tiles: DataFrame, copies: DataFrame, preset: AugmentationPreset, seed: int = 42) -> DataFrame:
    """(image_id, copy, h, w, bands): each copy's pixels, turned and flipped as its boxes are, with moved colours.

    ``tiles`` has image_id, h, w and three bands of bytes' values; ``copies``
    image_id, copy, turns, hflip and vflip, as ``augment`` chose them.
    """
    own = copies.select("image_id", "copy", "turns", "hflip", "vflip").where("copy > 0").distinct()
    met = tiles.select("image_id", "h", "w", "bands").join(own, "image_id")
    kind = dict(met.dtypes)["image_id"]
    bright, contrast, saturation = preset.jitter

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                cube = np.stack([np.asarray(b, float) for b in r.bands]).reshape(len(r.bands), r.h, r.w)
                cube = np.rot90(cube, -r.turns, (1, 2))
                cube = cube[:, :, ::-1] if r.hflip else cube
                cube = cube[:, ::-1] if r.vflip else cube
                rng = np.random.default_rng([seed, int(r.copy), zlib.crc32(str(r.image_id).encode())])
                b, c, s = (1 + rng.uniform(-j, j) for j in (bright, contrast, saturation))
                cube = cube * b
                cube = (cube - cube.mean()) * c + cube.mean()
                grey = cube.mean(0, keepdims=True)
                cube = np.clip(grey + (cube - grey) * s, 0, 255)
                out.append((r.image_id, r.copy, cube.shape[1], cube.shape[2], [x.ravel().astype(np.float32) for x in cube]))
            yield pd.DataFrame(out, columns=["image_id", "copy", "h", "w", "bands"])

    return met.mapInPandas(run, f"image_id {kind}, copy int, h int, w int, bands array<array<float>>")

"""Training sets: tiles and polygon annotations to split images with COCO annotations.

Which tiles are kept is settled relationally before any pixel is read: tiles
are joined to annotations, split, and backgrounds capped; only tiles that stay
meet their pixels.
"""

from __future__ import annotations

import json
import struct
import warnings
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.errors import CRSError, ModelError
from tilewright.functions import boxes as bx
from tilewright.functions import pixels
from tilewright.functions.clip import clip_ring
from tilewright.functions.geo import reproject_ring
from tilewright.operators import spatial
from tilewright.operators.augment import AUGMENTATION_PRESETS, AugmentationPreset, augment
from tilewright.operators.numbering import numbered
from tilewright.operators.split import block_split, random_split
from tilewright.plans.state import cut
from tilewright.sources.vectors import bounds

FOLDERS = {"train": "train", "val": "valid", "test": "test"}


def align(annotations: DataFrame, epsg: int | None, raster_epsg: int | None) -> DataFrame:
    """Annotations in the raster's system; those without one are taken as they are."""
    if raster_epsg is None:
        raise CRSError("the raster has no coordinate system")
    if epsg is None or epsg == raster_epsg:
        return annotations
    warnings.warn(f"annotations of EPSG:{epsg} are turned to EPSG:{raster_epsg}", UserWarning, stacklevel=2)
    return annotations.withColumn("rings", F.transform("rings", lambda r: reproject_ring(r, epsg, raster_epsg)))


def to_pixels(annotations: DataFrame, rasters: DataFrame) -> DataFrame:
    """Annotations with their outer ring and bounds in raster pixels, for each raster (raster_id, affine)."""
    own = annotations.join(F.broadcast(rasters.select("raster_id", "affine")), "raster_id") if "raster_id" in annotations.columns else None
    if own is None:
        one = rasters.select("raster_id", "affine").limit(2).collect()
        if len(one) != 1:
            raise ValueError("annotations need raster_id where there are several rasters")
        a = F.struct(*[F.lit(float(one[0]["affine"][k])).alias(k) for k in "abcdef"])
        own = annotations.withColumns({"raster_id": F.lit(one[0]["raster_id"]), "affine": a})
    ring = F.transform(F.col("rings")[0], lambda p: bx.to_pixel(F.col("affine"), p["x"], p["y"]))
    return own.withColumn("ring", ring).select("raster_id", "ann_id", "class_name", "class_id", "ring", *bounds(F.col("ring")))


def _clip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            ring = [(p["x"], p["y"]) for p in r.ring]
            for piece in clip_ring(ring, (r.tx1, r.ty1, r.tx2, r.ty2)):
                xs, ys = [p[0] for p in piece], [p[1] for p in piece]
                rows.append((r.raster_id, r.tile_idx, r.ann_id, r.class_id, min(xs) - r.tx1, min(ys) - r.ty1, max(xs) - min(xs), max(ys) - min(ys)))
        yield pd.DataFrame(rows, columns=["raster_id", "tile_idx", "ann_id", "class_id", "bx", "by", "bw", "bh"])


def plan_dataset(
    tiles: DataFrame, annotations: DataFrame, tile: int, ratios: tuple[float, float, float] = (0.8, 0.15, 0.05), method: str = "block", buffer: int = 0,
    max_background: float = 0.3, min_area: float = 0.0, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(tiles that stay, with split; their clipped annotations bx, by, bw, bh in tile pixels).

    ``tiles`` has raster_id, width, height and the window; ``annotations`` as
    from ``to_pixels`` with class_id. Tiles of the buffer and backgrounds over
    the cap don't stay. A tile is annotated if it touches any annotation.
    """
    split = block_split(tiles, tile, ratios, buffer, seed) if method == "block" else random_split(tiles, ratios, seed)
    met = spatial.tile_annotations(split.where("split != 'buffer'"), annotations)
    seen = met.select("raster_id", "tile_idx").distinct().withColumn("annotated", F.lit(True))
    marked = split.where("split != 'buffer'").join(seen, ["raster_id", "tile_idx"], "left").fillna(False, "annotated")
    stay = cut(spatial.background_cap(marked, max_background, seed))
    kind = dict(met.dtypes)["raster_id"]
    rows = met.select("raster_id", "tile_idx", "ann_id", "class_id", "ring", "tx1", "ty1", "tx2", "ty2")
    clipped = rows.mapInPandas(_clip, f"raster_id {kind}, tile_idx int, ann_id bigint, class_id int, bx double, by double, bw double, bh double")
    kept = spatial.at_least(clipped, min_area).where("bw > 0 AND bh > 0")
    return stay, kept.join(stay.select("raster_id", "tile_idx", "split"), ["raster_id", "tile_idx"])


def number(stay: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) with ids: images from 0 within a split and annotations from 0 over all, in tile order."""
    all_ = numbered(stay, ["split", "raster_id", "tile_idx"], "__n")
    firsts = all_.groupBy("split").agg(F.min("__n").alias("__first")).withColumnRenamed("split", "__split")  # a row for each split
    images = all_.join(F.broadcast(firsts), F.col("split") == F.col("__split"))
    images = images.withColumn("image_id", F.col("__n") - F.col("__first")).drop("__n", "__first", "__split")
    named = boxes.join(images.select("raster_id", "tile_idx", "image_id"), ["raster_id", "tile_idx"])
    return images, numbered(named, ["raster_id", "tile_idx", "ann_id", "bx", "by"])


def png(pixels_: np.ndarray) -> bytes:
    """An (h, w, 3) array of bytes as a PNG."""
    h, w = pixels_.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels_))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def images_of(tiles_with_pixels: DataFrame, nodata_threshold: float = 0.5) -> DataFrame:
    """(raster_id, tile_idx, png) of tiles whose bands are bytes' values; those of mostly no data go."""
    own = tiles_with_pixels.where(pixels.nodata_fraction(F.col("mask")) <= nodata_threshold).select("raster_id", "tile_idx", "h", "w", "bands")
    kind = dict(own.dtypes)["raster_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for h, w, bands in zip(frame["h"], frame["w"], frame["bands"], strict=True):
                cube = np.stack([np.asarray(b) for b in bands][:3] if len(bands) >= 3 else [np.asarray(bands[0])] * 3).reshape(3, h, w)
                out.append(png(np.clip(cube, 0, 255).astype(np.uint8).transpose(1, 2, 0)))
            yield pd.DataFrame({"raster_id": frame["raster_id"], "tile_idx": frame["tile_idx"], "png": out})

    return own.mapInPandas(run, f"raster_id {kind}, tile_idx int, png binary")


def write_dataset(images: DataFrame, annotations: DataFrame, classes: dict[str, int], folder: str, pngs: DataFrame | None = None, offered: int | None = None) -> dict[str, Any]:
    """{train,valid,test} folders with _annotations.coco.json each, and counts.

    With ``pngs`` images are written beside, by the tasks that made them; the
    folder must then be shared by all executors. ``offered``, the number of tiles
    before any was put aside, gives skipped_tiles.
    """
    import os

    stats: dict[str, Any] = {"num_classes": len(classes), "class_mapping": dict(classes), "skipped_annotations": 0}
    names = {v: k for k, v in FOLDERS.items()}
    for place, split in names.items():
        os.makedirs(f"{folder}/{place}/images", exist_ok=True)
        own, boxes = images.where(F.col("split") == split), annotations.where(F.col("split") == split)
        n = 0
        with open(f"{folder}/{place}/_annotations.coco.json", "w") as f:
            f.write('{"categories": ' + json.dumps([{"id": i, "name": c} for c, i in sorted(classes.items(), key=lambda x: x[1])]) + ', "images": [')
            count = -1
            for count, r in enumerate(own.orderBy("image_id").toLocalIterator()):
                f.write("," * (count > 0) + json.dumps({"id": r["image_id"], "file_name": f"images/tile_{r['image_id']:05d}.png", "width": r["w"], "height": r["h"]}))
            f.write('], "annotations": [')
            for n, r in enumerate(boxes.orderBy("id").toLocalIterator(), 1):
                bbox = [r["bx"], r["by"], r["bw"], r["bh"]]
                one = {"id": r["id"], "image_id": r["image_id"], "category_id": r["class_id"], "bbox": bbox, "area": r["bw"] * r["bh"], "iscrowd": 0}
                f.write("," * (n > 1) + json.dumps(one))
            f.write("]}")
        stats[f"{split}_tiles"], stats[f"{split}_annotations"] = count + 1, n
        if pngs is not None:
            named = pngs.join(own.select("raster_id", "tile_idx", "image_id"), ["raster_id", "tile_idx"]).select("image_id", "png")
            target = f"{folder}/{place}/images"

            def save(rows: Iterator, target: str = target) -> None:
                for r in rows:
                    with open(f"{target}/tile_{r['image_id']:05d}.png", "wb") as f:
                        f.write(r["png"])

            named.foreachPartition(save)
        stats[f"{split}_images"] = stats[f"{split}_tiles"]
    if offered is not None:
        stats["skipped_tiles"] = offered - sum(stats[f"{s}_images"] for s in names.values())
    return stats


def train(
    trainer: Callable[..., Any], boxes: DataFrame | None = None, preset: str | AugmentationPreset | None = None, factor: int = 2, learning_rate: float = 1e-4,
    resume: str | None = None, **options: Any,
) -> dict[str, Any]:
    """Runs a trainer; training boxes are augmented first, names are passed on as trainers know them, errors are ``ModelError``."""
    if isinstance(preset, str):
        if preset not in AUGMENTATION_PRESETS:
            raise ModelError(f"no preset {preset!r}; there are {', '.join(AUGMENTATION_PRESETS)}", preset=preset)
        preset = AUGMENTATION_PRESETS[preset]
    if preset is not None and boxes is not None:
        options["boxes"] = augment(boxes, preset, factor)
    elif boxes is not None:
        options["boxes"] = boxes
    if resume is not None:
        options["resume"] = resume
    try:
        found = trainer(lr=learning_rate, **options)
    except Exception as e:
        raise ModelError(f"training failed: {e}") from e
    return found if isinstance(found, dict) else {}

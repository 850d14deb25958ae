"""Detectors as pluggable models: the registry of sizes, input checks and the run over Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.errors import BandError, ModelError

#: Variant -> (resolution, patch, windows); a block is a patch times the windows.
VARIANTS = {"nano": (384, 16, 2), "small": (512, 16, 2), "medium": (576, 16, 2), "base": (560, 14, 4), "large": (704, 16, 2)}
#: Class id -> name of a common dataset.
# fmt: off
COCO_LABELS = {
    1: "person", 2: "bicycle", 3: "car", 4: "motorcycle", 5: "airplane", 6: "bus", 7: "train", 8: "truck", 9: "boat", 10: "traffic light",
    11: "fire hydrant", 13: "stop sign", 14: "parking meter", 15: "bench", 16: "bird", 17: "cat", 18: "dog", 19: "horse", 20: "sheep", 21: "cow",
    22: "elephant", 23: "bear", 24: "zebra", 25: "giraffe", 27: "backpack", 28: "umbrella", 31: "handbag", 32: "tie", 33: "suitcase", 34: "frisbee",
    35: "skis", 36: "snowboard", 37: "sports ball", 38: "kite", 39: "baseball bat", 40: "baseball glove", 41: "skateboard", 42: "surfboard",
    43: "tennis racket", 44: "bottle", 46: "wine glass", 47: "cup", 48: "fork", 49: "knife", 50: "spoon", 51: "bowl", 52: "banana", 53: "apple",
    54: "sandwich", 55: "orange", 56: "broccoli", 57: "carrot", 58: "hot dog", 59: "pizza", 60: "donut", 61: "cake", 62: "chair", 63: "couch",
    64: "potted plant", 65: "bed", 67: "dining table", 70: "toilet", 72: "tv", 73: "laptop", 74: "mouse", 75: "remote", 76: "keyboard",
    77: "cell phone", 78: "microwave", 79: "oven", 80: "toaster", 81: "sink", 82: "refrigerator", 84: "book", 85: "clock", 86: "vase", 87: "scissors",
    88: "teddy bear", 89: "hair drier", 90: "toothbrush",
}
# fmt: on


def variant(name: str) -> dict[str, int]:
    if name not in VARIANTS:
        raise ModelError(f"no variant {name!r}; there are {', '.join(VARIANTS)}", variant=name)
    resolution, patch, windows = VARIANTS[name]
    return {"resolution": resolution, "patch": patch, "windows": windows, "block_size": patch * windows}


#: About how many parameters a variant has; the licence of all; the most boxes that a model gives of an image.
PARAMETERS = {"nano": "15M", "small": "22M", "medium": "25M", "base": "29M", "large": "30M"}
LICENCE, NUM_SELECT = "Apache 2.0", 300


def num_select(model: object | None = None) -> int:
    """The most boxes that a model gives of an image: its own figure, else the usual one."""
    return int(getattr(model, "num_select", NUM_SELECT))


def model_info(name: str, device_name: str = "cpu", loaded: bool = False) -> dict[str, object]:
    """What there is to know of a variant and where it runs."""
    v = variant(name)
    sizes = {"resolution": v["resolution"], "block_size": v["block_size"], "patch_size": v["patch"], "num_windows": v["windows"]}
    return {"model_size": name, **sizes, "license": LICENCE, "approx_params": PARAMETERS[name], "device": device_name, "is_loaded": loaded}


def registry(spark: SparkSession) -> DataFrame:
    """(variant, resolution, patch, windows, block_size)."""
    rows = [(n, *variant(n).values()) for n in VARIANTS]
    return spark.createDataFrame(rows, "variant string, resolution int, patch int, windows int, block_size int")


def class_names(raw: Mapping[int, object] | None = None, custom: Mapping[int, str] | None = None) -> dict[int, str]:
    """Names by class id: the caller's own, or the model's, of which numbers are ids of the common dataset."""
    if custom is not None:
        return dict(custom)

    def name(value: object) -> str:
        try:
            number = int(value)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return str(value)
        return COCO_LABELS.get(number, str(number))

    return dict(COCO_LABELS) if raw is None else {int(i): name(v) for i, v in raw.items()}


def valid_tile_sizes(block: int) -> list[int]:
    return [s for s in range(block, 2049, block) if s >= 128]


def check_tile(tile: np.ndarray | None, block: int = 32) -> None:
    """Raises for what a detector can't read; warns of doubles and of sizes that aren't whole blocks."""
    if tile is None:
        return
    if tile.ndim != 3 or 3 not in (tile.shape[0], tile.shape[-1]):
        raise BandError(f"a tile needs three bands: {tile.shape}", shape=tile.shape)
    if tile.dtype.kind == "f":
        if tile.size and float(tile.max()) > 1.0:
            raise ModelError("a tile of floats must be within 0 and 1", most=float(tile.max()))
        if tile.dtype == np.float64:
            warnings.warn("a tile of doubles is narrowed to floats", UserWarning, stacklevel=2)
    h, w = tile.shape[:2] if tile.shape[-1] == 3 else tile.shape[1:]
    if h % block or w % block:
        warnings.warn(f"{w} x {h} pixels aren't whole blocks of {block}", UserWarning, stacklevel=2)


def device(preferred: str | None = None, available: tuple[str, ...] = ("cpu",)) -> str:
    """The preferred device if there is one, else the best: cuda, mps, cpu."""
    best = next(d for d in ("cuda", "mps", "cpu") if d in (*available, "cpu"))
    if preferred is None or preferred in available or preferred == "cpu":
        return preferred or best
    warnings.warn(f"there is no {preferred}; {best} is used", UserWarning, stacklevel=2)
    return best


def batch_size(device_name: str, free_bytes: int, resolution: int) -> int:
    """Tiles at a time: 1 on a CPU, else as 0.7 of the free memory holds, 1 to 64."""
    return 1 if device_name == "cpu" else max(1, min(64, int(0.7 * free_bytes / (resolution**2 * 96))))


class Detector(Protocol):
    """What a model must do: boxes of each tile, an array (h, w, 3) of bytes."""

    def predict(self, tiles: list[np.ndarray], threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(boxes n x 4, confidences n, class ids n) of each tile."""


class BrightBlocks:
    """A stand-in detector: the bounding box of the brightest pixels in each quarter of a tile."""

    def predict(self, tiles: list[np.ndarray], threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for tile in tiles:
            grey, found = tile.astype(float).mean(2), []
            h, w = grey.shape
            for k, (top, left) in enumerate(((0, 0), (0, w // 2), (h // 2, 0), (h // 2, w // 2))):
                part = grey[top : top + max(1, (h + 1) // 2), left : left + max(1, (w + 1) // 2)]
                if part.size and part.max() / 255 >= threshold:
                    y, x = np.nonzero(part >= part.max())
                    found.append((left + x.min(), top + y.min(), left + x.max() + 1, top + y.max() + 1, part.max() / 255, k % 3 + 1))
            a = np.array(found, float).reshape(-1, 6)
            out.append((a[:, :4], a[:, 4], a[:, 5].astype(int)))
        return out


def normalise(found: object) -> list[dict]:
    """Detections as rows; None and empty ones as none."""
    if found is None:
        return []
    boxes, confidence, ids = found  # type: ignore[misc]
    return [
        {"x1": float(b[0]), "y1": float(b[1]), "x2": float(b[2]), "y2": float(b[3]), "confidence": float(c), "class_id": int(i)}
        for b, c, i in zip(boxes, confidence, ids, strict=True)
    ]


_MODELS: dict[object, Detector] = {}


def optimised(model: Detector, batch: int = 1) -> bool:
    """Asks a model that can to prepare itself for many batches; whether it did. A model that fails at it still runs."""
    try:
        model.optimize_for_inference(batch_size=batch)  # type: ignore[attr-defined]
    except Exception:  # noqa: BLE001
        return False
    return True


def unoptimised(model: Detector) -> None:
    """Takes a model's preparation back, if it can."""
    try:
        model.remove_optimization()  # type: ignore[attr-defined]
    except Exception:  # noqa: BLE001
        return


def _loaded(make: Callable[[], Detector], optimise: bool, batch: int) -> Detector:
    """The worker's model: built when first asked for, once for each way of use."""
    key = (make, optimise)
    if key not in _MODELS:
        _MODELS[key] = make()
        if optimise:
            optimised(_MODELS[key], batch)
    return _MODELS[key]


def detect(
    tiles: DataFrame, make: Callable[[], Detector] = BrightBlocks, threshold: float = 0.5, batch: int = 8, keep: tuple[str, ...] = (), optimise: bool = False
) -> DataFrame:
    """(raster_id, tile_idx, ordinal, x1..y2, confidence, class_id, keep...): the boxes of each tile, in its own pixels.

    ``tiles`` has raster_id, tile_idx, h, w and bands, array<array<float>> of
    three bands from 0 to 1. ``make`` builds the model, once in a Python worker.
    ``ordinal`` counts a tile's boxes from 0; the plain columns ``keep`` go along.
    """
    kinds = dict(tiles.dtypes)
    schema = f"raster_id {kinds['raster_id']}, tile_idx int, ordinal int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
    schema += "".join(f", {c} {kinds[c]}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(make, optimise, batch)
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                images = []
                for h, w, bands in zip(part["h"], part["w"], part["bands"], strict=True):
                    cube = np.stack([np.asarray(b, np.float32) for b in bands]).reshape(len(bands), h, w)
                    images.append((np.clip(cube, 0, 1) * 255).astype(np.uint8).transpose(1, 2, 0))
                found = [normalise(x) for x in model.predict(images, threshold)]
                at = np.repeat(np.arange(len(part)), [len(x) for x in found])
                boxes = [{"ordinal": i, **d} for x in found for i, d in enumerate(x)]
                out = pd.DataFrame(boxes, columns=["ordinal", "x1", "y1", "x2", "y2", "confidence", "class_id"])
                yield pd.concat([part[["raster_id", "tile_idx"]].iloc[at].reset_index(drop=True), out, part[list(keep)].iloc[at].reset_index(drop=True)], axis=1)

    own = tiles.select("raster_id", "tile_idx", "h", "w", "bands", *keep)
    return own.mapInPandas(run, schema).where(F.col("confidence") >= threshold)

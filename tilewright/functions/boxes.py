"""Boxes, affine transforms and quads as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)  # type: ignore[return-value]


def intersection_area(a: tuple, b: tuple) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection_area(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, F.try_divide(both, union)).otherwise(F.lit(0.0))


def offset(col_off: Column | str, row_off: Column | str, prefix: str = "") -> list[Column]:
    """Box sides moved from a tile's pixels to the raster's."""
    dx, dy = (F.col(c) if isinstance(c, str) else c for c in (col_off, row_off))
    x1, y1, x2, y2 = box(prefix)
    return [(x1 + dx).alias("x1"), (y1 + dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2")]


def to_geo(affine: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: a pixel place through an affine struct a..f."""
    return F.struct(
        (affine["a"] * x + affine["b"] * y + affine["c"]).alias("x"), (affine["d"] * x + affine["e"] * y + affine["f"]).alias("y")
    )


def to_pixel(affine: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: the inverse of ``to_geo``; null where the transform has none."""
    det = affine["a"] * affine["e"] - affine["b"] * affine["d"]
    dx, dy = x - affine["c"], y - affine["f"]
    return F.struct(
        F.try_divide(affine["e"] * dx - affine["b"] * dy, det).alias("x"), F.try_divide(affine["a"] * dy - affine["d"] * dx, det).alias("y")
    )


def corners(a: tuple) -> list[tuple[Column, Column]]:
    """Top left, top right, bottom right, bottom left."""
    x1, y1, x2, y2 = a
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def quad(affine: Column, a: tuple) -> Column:
    """The closed ring of a box's four corners in geographic space."""
    points = [to_geo(affine, x, y) for x, y in corners(a)]
    return F.array(*points, points[0])


def quad_centroid(affine: Column, a: tuple) -> Column:
    """The middle of the quad, which is exact for any affine image of a box."""
    return to_geo(affine, (a[0] + a[2]) / 2, (a[1] + a[3]) / 2)


def has_rotation(affine: Column) -> Column:
    return (affine["b"] != 0) | (affine["d"] != 0)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    n = F.size(ring)
    edges = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("p"), F.slice(ring, F.lit(2), n - 1).alias("q"))
    cross = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))
    return F.when(n > 1, F.abs(cross) / 2).otherwise(F.lit(0.0))


def clipped(a: tuple, window: tuple) -> list[Column]:
    """The sides of a box within a window; callers drop what has no area."""
    return [
        F.greatest(a[0], window[0]).alias("x1"),
        F.greatest(a[1], window[1]).alias("y1"),
        F.least(a[2], window[2]).alias("x2"),
        F.least(a[3], window[3]).alias("y2"),
    ]


def coco_bbox(affine: Column, geo: tuple) -> list[Column]:
    """[x, y, w, h] in pixels of geographic bounds: least and greatest of the four corners through the inverse."""
    pixels = [to_pixel(affine, x, y) for x, y in corners(geo)]
    xs, ys = [p["x"] for p in pixels], [p["y"] for p in pixels]
    low = lambda v: F.least(*v)
    high = lambda v: F.greatest(*v)
    zero = F.lit(0.0)  # turns -0.0 to 0.0
    return [(low(xs) + zero).alias("bx"), (low(ys) + zero).alias("by"), (high(xs) - low(xs)).alias("bw"), (high(ys) - low(ys)).alias("bh")]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)

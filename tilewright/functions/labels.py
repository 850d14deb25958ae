"""Class names and display values as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty colours of a common qualitative palette, as red, green and blue of 255.
PALETTE = (
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44), (152, 223, 138), (214, 39, 40),
    (255, 152, 150), (148, 103, 189), (197, 176, 213), (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210),
    (127, 127, 127), (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
)
MISSING_COLOUR = "#ff0000"


def class_label(class_id: Column, names: Mapping[int, str] | None) -> Column:
    """The name of a class, or class_ID where it has none."""
    fallback = F.concat(F.lit("class_"), class_id.cast("string"))
    if not names:
        return fallback
    pairs = [F.lit(x) for i, name in names.items() for x in (int(i), name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), class_id.cast("int")), fallback)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of shares from 0 to 1, truncated."""
    two = lambda c: F.lpad(F.lower(F.hex(F.floor(c * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def palette_colour(position: Column) -> Column:
    """The palette's colour at a place in a list, over again from the start after the last."""
    return F.element_at(F.array(*[F.lit("#%02x%02x%02x" % c) for c in PALETTE]), F.pmod(position, F.lit(len(PALETTE))).cast("int") + 1)


def recommended_overlap(object_px: Column, tile_px: Column) -> Column:
    """Overlap for objects of a size: at least 0.05 and at most 0.49; 0.2 for a tile without size."""
    wanted = F.try_divide(object_px, tile_px) / F.lit(0.3)
    return F.when(tile_px > 0, F.least(F.lit(0.49), F.greatest(F.lit(0.05), wanted))).otherwise(F.lit(0.2))


def detection_range(gsd_m: Column, tile_px: Column) -> Column:
    """struct<least, most>: metres of objects that a tile can show."""
    return F.struct((gsd_m * 10).alias("least"), (tile_px * 0.8 * gsd_m).alias("most"))

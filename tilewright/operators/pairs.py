"""Pairs of boxes that meet, by a grid of bins instead of a nested loop.

Each box goes to every bin it touches; boxes meet on (keys, bin). A pair that
shares several bins counts only in the one that holds the lower left corner of
their intersection, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256.0


def _bins(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def binned(df: DataFrame, sides: tuple[str, str, str, str], size: float = BIN) -> DataFrame:
    """``df`` with __bx and __by, one row for each bin that a box touches; borders count."""
    x1, y1, x2, y2 = sides
    rows = df.where((F.col(x2) >= F.col(x1)) & (F.col(y2) >= F.col(y1))).withColumn("__bx", F.explode(_bins(F.col(x1), F.col(x2), size)))
    return rows.withColumn("__by", F.explode(_bins(F.col(y1), F.col(y2), size)))


def meeting(
    a: DataFrame, b: DataFrame, keys: list[str], a_sides: tuple[str, str, str, str], b_sides: tuple[str, str, str, str], size: float = BIN, where: Column | None = None
) -> DataFrame:
    """Rows of a joined to those of b whose boxes touch, each pair once; all columns but ``keys`` must differ in name."""
    left, right = binned(a, a_sides, size), binned(b, b_sides, size)
    joined = left.join(right, [*keys, "__bx", "__by"])
    x, y = F.greatest(F.col(a_sides[0]), F.col(b_sides[0])), F.greatest(F.col(a_sides[1]), F.col(b_sides[1]))
    touch = (x <= F.least(F.col(a_sides[2]), F.col(b_sides[2]))) & (y <= F.least(F.col(a_sides[3]), F.col(b_sides[3])))
    home = (F.floor(x / size) == F.col("__bx")) & (F.floor(y / size) == F.col("__by"))
    kept = joined.where(touch & home if where is None else touch & home & where)
    return kept.drop("__bx", "__by")

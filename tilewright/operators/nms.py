"""Class-aware greedy non-maximum suppression.

Within a group (raster and class) boxes are ranked by confidence, then by id; a
box goes if a box of higher rank that stays overlaps it by more than the
threshold. All strategies return the same boxes:

* ``grouped``: one group at a time in numpy, for groups that fit a task;
* ``rounds``: for groups of any size, on the graph of overlapping pairs, which
  a grid of bins finds: every round keeps the boxes without an undecided
  neighbour of higher rank and drops the neighbours of those (the
  lexicographically first maximal independent set; Blelloch, Fineman and Shun,
  2012);
* ``regions``: for groups of any size and of any number of overlaps, as none is
  written down: squares of a grid are walked by rank in tasks of their own,
  and boxes in several squares wait until all of these agree;
* ``fold``: array functions only, for small groups;
* ``auto``: groups of more than ``MAX_GROUP`` boxes by regions, the rest grouped.

Filters on confidence, class and raster commute with suppression and belong
below it: Catalyst doesn't move filters through grouped pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.boxes import SIDES, iou
from tilewright.operators.pairs import BIN, binned, meeting
from tilewright.plans.state import cut

MAX_GROUP = 20_000
#: Side of a region's square.
REGION = 4 * BIN
#: What a region says of a box: it goes, nothing of the region stops it, it depends on boxes that wait.
GOES, CLEAR, WAITS = 0, 1, 2


def greedy(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the boxes that stay, of boxes sorted by rank."""
    x1, y1, x2, y2 = boxes.T
    areas = (x2 - x1) * (y2 - y1)
    alive, kept = np.ones(len(boxes), bool), []
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        kept.append(i)
        rest = np.flatnonzero(alive[i + 1 :]) + i + 1
        w = np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])
        h = np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest])
        both = np.where((w > 0) & (h > 0), w * h, 0.0)
        union = areas[i] + areas[rest] - both
        over = np.divide(both, union, out=np.zeros_like(both), where=union > 0) > threshold
        alive[rest[over]] = False
    return np.array(kept, int)


def _grouped(df: DataFrame, threshold: float, keys: list[str], score: str, tie: str) -> DataFrame:
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values([score, tie], ascending=[False, True], kind="stable")
        return own.iloc[greedy(own[list(SIDES)].to_numpy(float), threshold)]

    return df.groupBy(*keys).applyInPandas(keep, df.schema)


def _fold(df: DataFrame, threshold: float, keys: list[str], score: str, tie: str) -> DataFrame:
    row = F.struct((-F.col(score)).alias("rank"), F.col(tie).alias("tie"), F.struct(*df.columns).alias("row"))
    ranked = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))
    sides = lambda r: tuple(r["row"][s] for s in SIDES)
    kept = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda s, x: F.when(F.exists(s, lambda k: iou(sides(k), sides(x)) > threshold), s).otherwise(F.concat(s, F.array(x))),
    )
    return ranked.select(F.explode(kept).alias("k")).select("k.row.*")


def overlaps(df: DataFrame, threshold: float, keys: list[str], score: str, tie: str) -> DataFrame:
    """(hi, lo): ids of overlapping boxes of a group, the one of higher rank first."""
    names = {s: f"{s}_b" for s in SIDES} | {score: "score_b", tie: "id_b"}
    a = df.select(*keys, *SIDES, F.col(score).alias("score_a"), F.col(tie).alias("id_a"))
    b = df.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    first = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("id_a") < F.col("id_b")))
    over = iou(tuple(F.col(s) for s in SIDES), tuple(F.col(f"{s}_b") for s in SIDES)) > threshold
    met = meeting(a, b, keys, SIDES, tuple(f"{s}_b" for s in SIDES), where=first & over)
    return met.select(F.col("id_a").alias("hi"), F.col("id_b").alias("lo"))


def _rounds(df: DataFrame, threshold: float, keys: list[str], score: str, tie: str) -> DataFrame:
    edges = cut(overlaps(df, threshold, keys, score, tie))
    dropped = None
    while not edges.isEmpty():
        low = edges.select(F.col("lo").alias("id")).distinct()
        tops = edges.select(F.col("hi").alias("id")).distinct().join(low, "id", "left_anti")  # undecided ones none is above
        gone = cut(edges.join(tops, F.col("hi") == F.col("id"), "left_semi").select(F.col("lo").alias("gone")).distinct())
        dropped = gone if dropped is None else cut(dropped.unionByName(gone))
        left = edges.join(tops, F.col("hi") == F.col("id"), "left_anti").join(gone, F.col("hi") == F.col("gone"), "left_anti")
        edges = cut(left.join(gone, F.col("lo") == F.col("gone"), "left_anti"))
    return df if dropped is None else df.join(dropped, F.col(tie) == F.col("gone"), "left_anti")


def _walk(above: np.ndarray, sure: np.ndarray, boxes: np.ndarray, stays: np.ndarray, alone: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a region says of ``boxes``, which follow ``above`` in rank, and the next ``above`` and ``sure``.

    ``above`` are boxes that stay (``sure``) or may stay; of ``boxes``, some are known to stay, and some are in this
    region alone, so what it says of them is so.
    """
    own, first = np.concatenate([above, boxes]), len(above)
    x1, y1, x2, y2 = own.T
    areas = (x2 - x1) * (y2 - y1)
    certain, fixed = np.concatenate([sure, stays]), np.concatenate([np.ones(first, bool), stays])
    gone, waits = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for i in range(len(own)):
        if gone[i]:
            continue
        if not fixed[i]:
            certain[i] = alone[i - first] and not waits[i]
        start = max(i + 1, first)
        rest = np.flatnonzero(~(gone[start:] | fixed[start:])) + start
        w = np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])
        h = np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest])
        both = np.where((w > 0) & (h > 0), w * h, 0.0)
        union = areas[i] + areas[rest] - both
        over = rest[np.divide(both, union, out=np.zeros_like(both), where=union > 0) > threshold]
        (gone if certain[i] else waits)[over] = True
    said = np.where(gone, GOES, np.where(waits, WAITS, CLEAR)).astype(np.int8)[first:]
    return said, own[~gone], certain[~gone]


def _judge(threshold: float, tie: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Regions' rows by rank, one region after the other, to (tie, said) of those not known to stay; holds a batch and what may stay of a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, sure = np.zeros((0, 4)), np.zeros(0, bool)
        for batch in batches:
            new, stays, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__new", "__stays", "__alone"))
            boxes = np.column_stack([batch.column(s).to_numpy() for s in SIDES])
            said = np.zeros(len(boxes), np.int8)
            bounds = sorted({0, *np.flatnonzero(new).tolist(), len(boxes)})
            for a, b in zip(bounds, bounds[1:], strict=False):
                if new[a]:
                    above, sure = above[:0], sure[:0]
                said[a:b], above, sure = _walk(above, sure, boxes[a:b], stays[a:b], alone[a:b], threshold)
            yield pa.RecordBatch.from_arrays([batch.column(tie), pa.array(said)], names=[tie, "said"]).filter(pa.array(~stays))

    return run


def _regions(df: DataFrame, threshold: float, keys: list[str], score: str, tie: str, size: float = REGION) -> DataFrame:
    """A box goes if one of its regions says so, and stays if all find it clear; the others wait for the next round.

    Each round decides at least the highest box that waits. Boxes that go leave at once, so the state is what may stay.
    """
    meets = F.lit(True)  # boxes without an area, or an end, overlap none
    for low, high in ((SIDES[0], SIDES[2]), (SIDES[1], SIDES[3])):
        a, b = F.col(low).cast("double"), F.col(high).cast("double")
        meets = meets & F.coalesce((b > a) & (a > float("-inf")) & (b < float("inf")), F.lit(False))
    rank = F.nanvl(F.col(score), F.lit(None)) if dict(df.dtypes)[score] in ("float", "double") else F.col(score)  # NaN is last, as null
    state = df.where(meets).select(*keys, *[F.col(s).cast("double").alias(s) for s in SIDES], rank.alias("__rank"), tie, F.lit(False).alias("__stays"))
    place = [*keys, "__bx", "__by"]
    walked = Window.partitionBy(*place).orderBy(F.desc_nulls_last("__rank"), F.asc_nulls_last(tie))
    same = lambda low, high: F.floor(F.col(low) / size) == F.floor(F.col(high) / size)
    while True:
        rows = binned(state.withColumn("__alone", same(SIDES[0], SIDES[2]) & same(SIDES[1], SIDES[3])), SIDES, size)
        rows = rows.withColumn("__open", F.max(~F.col("__stays")).over(Window.partitionBy(*place))).where("__open")
        rows = rows.withColumn("__new", F.row_number().over(walked) == 1).select(*SIDES, tie, "__stays", "__alone", "__new")
        said = rows.mapInArrow(_judge(threshold, tie), f"`{tie}` {dict(df.dtypes)[tie]}, said tinyint")
        said = said.groupBy(F.col(tie).alias("__tie")).agg(F.min("said").alias("least"), F.max("said").alias("most")).where(F.col("least") != GOES)
        decided = state.where("NOT __stays").join(said.hint("merge"), F.col(tie) == F.col("__tie")).withColumn("__stays", F.col("most") == CLEAR)
        state = cut(state.where("__stays").unionByName(decided.select(state.columns)))
        if state.where("NOT __stays").isEmpty():
            stay = state.select(F.col(tie).alias("__tie"))
            return df.where(meets).join(stay.hint("merge"), F.col(tie) == F.col("__tie"), "left_semi").unionByName(df.where(~meets))


def nms(
    df: DataFrame,
    threshold: float = 0.5,
    keys: Iterable[str] = ("raster_id", "class_id"),
    score: str = "confidence",
    tie: str = "det_id",
    strategy: str = "auto",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """The rows of ``df`` (x1, y1, x2, y2, ``score``, ``tie``) that stay; ``tie`` is unique."""
    own = list(keys)
    ways = {"grouped": _grouped, "fold": _fold, "rounds": _rounds, "regions": _regions}
    if strategy in ways:
        return ways[strategy](df, threshold, own, score, tie)
    if strategy != "auto":
        raise ValueError(f"no strategy {strategy!r}; there are auto, {', '.join(ways)}")
    big = df.groupBy(*own).count().where(F.col("count") > max_group).drop("count")
    if big.isEmpty():
        return _grouped(df, threshold, own, score, tie)
    big = cut(big)
    small = _grouped(df.join(big, own, "left_anti").select(df.columns), threshold, own, score, tie)
    return small.unionByName(_regions(df.join(big, own, "left_semi").select(df.columns), threshold, own, score, tie))


def ranked(df: DataFrame, keys: Iterable[str], score: str = "confidence", tie: str = "det_id") -> DataFrame:
    """``df`` with rank, from 1, by confidence and then id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def edge_zone_filter(df: DataFrame, threshold: float = 0.5, ratio: float = 0.1, raster: str = "raster_id", tie: str = "det_id") -> DataFrame:
    """Without boxes at a tile's edge that a box from a tile's middle repeats.

    A box (x1..y2 in raster pixels; tile window col_off, row_off, w, h) is at the
    edge if its centre is within ``ratio`` of the window from a side. Class and
    confidence don't matter.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2 - F.col("col_off"), (F.col("y1") + F.col("y2")) / 2 - F.col("row_off")
    mx, my = F.col("w") * ratio, F.col("h") * ratio
    at_edge = (cx < mx) | (cx > F.col("w") - mx) | (cy < my) | (cy > F.col("h") - my)
    marked = df.withColumn("__edge", at_edge)
    edge = marked.where("__edge").select(raster, *SIDES, F.col(tie).alias("__id"))
    middle = marked.where("NOT __edge").select(raster, *[F.col(s).alias(f"{s}_m") for s in SIDES])
    over = iou(tuple(F.col(s) for s in SIDES), tuple(F.col(f"{s}_m") for s in SIDES)) > threshold
    repeated = meeting(edge, middle, [raster], SIDES, tuple(f"{s}_m" for s in SIDES), where=over).select("__id").distinct()
    return df.join(repeated, F.col(tie) == F.col("__id"), "left_anti")

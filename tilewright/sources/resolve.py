"""Where rasters come from: paths, remote addresses and catalogue items."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.errors import TilewrightError
from tilewright.functions.boxes import to_pixel

REMOTE = ("http://", "https://", "s3://", "hdfs://", "viewfs://", "abfss://", "gs://", "file:")
#: Fixed value: the assets of a catalogue item that are tried first, in this order.
PREFERRED = ("visual", "image", "data", "red", "B04")


def resolve(source: Any) -> str:
    """A path or address for Spark's readers; local files must be there."""
    if hasattr(source, "assets") and hasattr(source, "id"):
        return pick_asset(source)
    if not isinstance(source, (str, os.PathLike)):
        raise TilewrightError(f"not a raster: {type(source).__name__}")
    text = os.fspath(source)
    if not text.startswith(REMOTE) and not os.path.exists(text):
        raise FileNotFoundError(text)
    return text


def _is_tiff(media: str | None) -> bool:
    return "tiff" in (media or "").lower()


def pick_asset(item: Any) -> str:
    """The address of an item's raster: a preferred asset that is a TIFF or says nothing, else the first TIFF."""
    assets = item.assets
    get = lambda a, k: a.get(k) if isinstance(a, dict) else getattr(a, k, None)
    media = lambda a: get(a, "media_type") or get(a, "type") or ""
    for key in PREFERRED:
        if key in assets and (_is_tiff(media(assets[key])) or not media(assets[key])):
            return get(assets[key], "href")
    for a in assets.values():
        if _is_tiff(media(a)) or str(get(a, "href")).lower().endswith((".tif", ".tiff")):
            return get(a, "href")
    raise TilewrightError(f"no raster among the assets {', '.join(assets)} of {item.id}", item=item.id)


def pick_assets(items: DataFrame, assets: str = "assets") -> DataFrame:
    """``items`` with asset and href: the same choice over map<string, struct<href, media_type>>."""

    def rank(key: Column, value: Column) -> Column:
        media, href = F.lower(F.coalesce(value["media_type"], F.lit(""))), F.lower(value["href"])
        tiff = media.contains("tiff")
        place = F.array_position(F.array(*map(F.lit, PREFERRED)), key)
        named = (place > 0) & (tiff | (media == ""))
        return F.when(named, place).when(tiff | href.endswith(".tif") | href.endswith(".tiff"), F.lit(100))

    ranked = F.filter(
        F.transform(F.map_entries(assets), lambda e, i: F.struct(rank(e["key"], e["value"]).alias("rank"), i.alias("i"), e["key"].alias("asset"), e["value"]["href"].alias("href"))),
        lambda r: r["rank"].isNotNull(),
    )
    best = items.withColumn("__best", F.array_min(ranked))
    return best.select(*items.columns, F.col("__best.asset").alias("asset"), F.col("__best.href").alias("href"))


def latest_item(items: DataFrame, lon: float, lat: float, start: str, end: str) -> DataFrame:
    """The most recent item (bbox array, datetime) over a place within a range of dates."""
    b = F.col("bbox")
    over = (b[0] <= lon) & (b[2] >= lon) & (b[1] <= lat) & (b[3] >= lat)
    return items.where(over & F.col("datetime").between(start, end)).orderBy(F.desc("datetime"), "id").limit(1)


def window_of(affine: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """struct<col_off, row_off, w, h>: the least window of a raster that holds an area of interest in its coordinates."""
    corners = F.transform(
        F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]),
        lambda p: to_pixel(affine, p["x"], p["y"]),
    )

    def side(c: str) -> tuple[Column, Column]:
        own = F.transform(corners, lambda p: F.round(p[c], 6))  # what rounding left of whole pixels doesn't add one
        return F.floor(F.array_min(own)).cast("int"), F.ceil(F.array_max(own)).cast("int")

    (c0, c1), (r0, r1) = side("x"), side("y")
    return F.struct(c0.alias("col_off"), r0.alias("row_off"), (c1 - c0).alias("w"), (r1 - r0).alias("h"))

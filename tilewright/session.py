"""The user's way in: a raster, a detector, and lazy results."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.errors import CRSError, ExportError, MissingCRSError
from tilewright.functions.geo import check_gsd, from_utm, parse_epsg, to_utm, unit_of
from tilewright.functions.pixels import band_numbers
from tilewright.model import BrightBlocks, Detector
from tilewright.operators.spatial import display_filter, top_n
from tilewright.plans.detect import detect_tiles
from tilewright.sources import sinks
from tilewright.sources.geotiff import read_limits, read_metadata, read_tiles
from tilewright.sources.resolve import resolve

FULL_READ_WARNS_AT = 1_000_000_000


class RasterDetector:
    """Detections of one raster or a folder of rasters, as DataFrames."""

    def __init__(self, spark: SparkSession, make: Callable[[], Detector] = BrightBlocks, names: Mapping[int, str] | None = None, strict_gsd: bool = False):
        self.spark, self.make, self.names, self.strict = spark, make, names, strict_gsd
        self.path: str | None = None
        self.bands: list[int] = [1, 2, 3]
        self.meta: dict | None = None
        self.detections: DataFrame | None = None
        self._epsg: int | None = None
        self._georeferenced, self._crs_given = True, False

    @property
    def crs(self) -> int | None:
        return self._epsg

    @crs.setter
    def crs(self, value: object) -> None:
        if not isinstance(value, (str, int)) or isinstance(value, bool):
            raise CRSError(f"not a coordinate system: {value!r}", crs=value)
        self._epsg, self._georeferenced, self._crs_given = parse_epsg(value), True, True

    def set_image(self, source: object, bands: str | list[int] = "rgb", georeferenced: bool = True, suppress_gsd_warning: bool = False) -> RasterDetector:
        """Reads metadata only."""
        self.path, self.bands, self._georeferenced = resolve(source), band_numbers(bands), georeferenced
        first = read_metadata(self.spark, self.path).first()
        self.meta = first.asDict(recursive=True) if first else None
        self._epsg, self._crs_given = self.meta["epsg"] if self.meta else None, False
        if georeferenced and self._epsg is None:
            raise MissingCRSError("the raster has no coordinate system; set crs or georeferenced=False", source=self.path)
        if not suppress_gsd_warning and self.meta:
            check_gsd(self.meta["gsd_m"], self.strict)
        return self

    def _tiles(self, tile: int, overlap: float) -> DataFrame:
        if self.path is None or self.meta is None:
            raise ValueError("set_image comes first")
        return read_tiles(self.spark, self.path, tile, overlap, self.bands)

    def detect(self, threshold: float = 0.5, classes: list[str] | None = None) -> DataFrame:
        """The whole raster as one tile."""
        size = max(self.meta["width"], self.meta["height"]) if self.meta else 1
        if self.meta and self.meta["width"] * self.meta["height"] * 12 > FULL_READ_WARNS_AT:
            warnings.warn("the whole raster is read at once; detect_tiled reads windows", ResourceWarning, stacklevel=2)
        return self._detected(self._tiles(size, 0.0), threshold, 1.0, classes, fallback_names=True)

    def detect_tiled(
        self, tile: int = 576, overlap: float = 0.2, threshold: float = 0.5, nms_threshold: float = 0.5, nodata_threshold: float = 0.5, classes: list[str] | None = None
    ) -> DataFrame:
        return self._detected(self._tiles(tile, overlap), threshold, nms_threshold, classes, nodata_threshold)

    def _detected(self, tiles: DataFrame, threshold: float, nms_threshold: float, classes: list[str] | None, nodata: float = 1.0, fallback_names: bool = False) -> DataFrame:
        limits = read_limits(self.spark, self.path, self.bands) if self.path else None
        found = detect_tiles(tiles, self.make, threshold, nms_threshold, nodata, "percentile", classes, self.names, limits, fallback_names)
        own = read_metadata(self.spark, self.path).select(F.col("raster_id").alias("__r"), F.col("epsg").alias("__e"), "gsd_m")  # a row for each raster
        given = F.lit(self._epsg if self._crs_given else None).cast("int")
        found = found.join(own, F.col("raster_id") == F.col("__r"), "left").withColumn("epsg", F.coalesce(given, "__e")).drop("__r", "__e")
        self.detections = found if self._georeferenced else found.drop("ring", "centroid_x", "centroid_y", "area", "epsg")
        return self.detections

    def to_geojson(self, path: str, simplify_tolerance: float | None = None) -> None:
        sinks.to_geojson(self._rows(), path, self._epsg, simplify_tolerance)

    def to_geopackage(self, path: str, layer: str = "detections", append: bool = False) -> None:
        sinks.to_geopackage(self._rows(), path, layer, self._epsg, append)

    def to_shapefile(self, path: str) -> None:
        sinks.to_shapefile(self._rows(), path, self._epsg)

    def _rows(self) -> DataFrame:
        if self.detections is None or "ring" not in self.detections.columns:
            raise ExportError("there are no georeferenced detections")
        return self.detections

    def show(self, min_confidence: float = 0.0, classes: list[str] | None = None, max_detections: int = 1000) -> DataFrame:
        """The rows to draw, the most confident first."""
        own = display_filter(self._rows(), min_confidence, classes)
        if own.limit(max_detections + 1).count() > max_detections:
            warnings.warn(f"only the {max_detections} most confident are shown", RuntimeWarning, stacklevel=2)
        return top_n(own, max_detections)


def areas_m2(df: DataFrame, epsg: int | None) -> DataFrame:
    """``df`` (ring) with area_m2: as measured, or for degrees in the UTM zone of the first ring's middle, for all rows."""
    from tilewright.functions.boxes import ring_area
    from tilewright.functions.geo import utm_epsg

    first = F.col("ring")[0]
    if unit_of(epsg) == "degree":
        mean = lambda c: F.aggregate(F.slice("ring", 1, F.size("ring") - 1), F.lit(0.0), lambda s, p: s + p[c]) / (F.size("ring") - 1)
        zone = df.select(utm_epsg(mean("x"), mean("y"))).first()
        if zone is None:
            return df.withColumn("area_m2", F.lit(None).cast("double"))
        ring = F.transform("ring", lambda p: to_utm(p["x"], p["y"], F.lit(zone[0])))
        return df.withColumn("__utm", ring).withColumn("area_m2", ring_area(_moved("__utm"))).drop("__utm")
    return df.withColumn("area_m2", F.when(first.isNotNull(), ring_area(_moved("ring"))))


def _moved(column: str) -> F.Column:
    """A ring relative to its first point, which keeps digits in products."""
    first = F.col(column)[0]
    return F.transform(column, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))


__all__ = ["RasterDetector", "areas_m2", "from_utm"]

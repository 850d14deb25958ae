"""Schemas of the relations that operators exchange."""

from __future__ import annotations

AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
RING = "array<struct<x:double,y:double>>"
RASTERS = (
    f"raster_id string, uri string, epsg int, affine {AFFINE}, width int, height int, band_count int, dtype string, nodata double, "
    "has_alpha boolean, bounds struct<left:double,bottom:double,right:double,top:double>, gsd_m double"
)
TILES = "raster_id string, tile_idx int, col_off int, row_off int, w int, h int"
TILE_PIXELS = f"{TILES}, bands array<array<float>>, mask array<boolean>"
DETECTION = "struct<x1:double,y1:double,x2:double,y2:double,confidence:double,class_id:int>"
DETECTIONS_PX = "raster_id string, tile_idx int, det_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
ANNOTATIONS = f"ann_id bigint, class_id int, class_name string, rings array<{RING}>, epsg int"

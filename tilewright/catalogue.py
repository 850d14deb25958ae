"""The raster operators' queries over the given tables, each with DuckDB SQL for the same rows.

The tables hold no rasters, so boxes, scenes, annotations and pixels are derived from them by arithmetic that
Spark and DuckDB both run: ``INPUTS`` is shared text, and what an operator does is written twice, once with the
package and once in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import boxes as bx
from tilewright.functions import geo, labels, pixels
from tilewright.operators import augment, grid, nms, reports, spatial, split

#: Derived inputs: name -> (tables, SQL for both engines).
INPUTS = {
    "det": (
        ["events"],
        """SELECT event_id AS det_id, user_id % 16 AS scene, event_type AS cls, CAST((event_id * 7919) % 4000 AS DOUBLE) AS x1,
  CAST((event_id * 104729) % 4000 AS DOUBLE) AS y1, (event_id * 7919) % 4000 + 40 + value % 200 AS x2,
  (event_id * 104729) % 4000 + 40 + value % 150 AS y2, (value % 100) / 100 AS conf,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 7 ELSE 9 END AS class_id FROM events""",
    ),
    "scene": (
        ["part"],
        """SELECT p_partkey AS raster_id, CAST(150 + p_size * 7 AS INT) AS width, CAST(120 + p_size * 5 AS INT) AS height,
  CAST(1 + p_size % 5 AS INT) AS band_count, CAST(p_size AS DOUBLE) / 10 AS a, CASE WHEN p_partkey % 7 = 0 THEN CAST(0.125 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS b,
  500000 + CAST(p_partkey AS DOUBLE) * 10 AS c, CASE WHEN p_partkey % 7 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS d,
  -CAST(p_size AS DOUBLE) / 10 AS e, 4000000 - CAST(p_partkey AS DOUBLE) * 10 AS f,
  CASE p_partkey % 5 WHEN 0 THEN 'metre' WHEN 1 THEN 'foot' WHEN 2 THEN 'us_survey_foot' WHEN 3 THEN 'degree' ELSE 'other' END AS unit FROM part""",
    ),
    "ann": (
        ["orders"],
        """SELECT o_orderkey AS ann_id, o_custkey % 16 AS scene, o_orderpriority AS class_name, CAST((o_orderkey * 613) % 1200 AS DOUBLE) AS x1,
  CAST((o_orderkey * 389) % 1200 AS DOUBLE) AS y1, CAST((o_orderkey * 613) % 1200 + 5 + o_orderkey % 60 AS DOUBLE) AS x2,
  CAST((o_orderkey * 389) % 1200 + 4 + o_orderkey % 45 AS DOUBLE) AS y2 FROM orders""",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = INPUTS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f" FROM {t}", f" FROM {{{t}}}")
    return spark.sql(text, **frames)


def _scenes(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("scene"), F.lit(1280).alias("width"), F.lit(1280).alias("height"))


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = ()) -> Callable:
    """Registers a query, and SQL whose derived inputs come first."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            heads = ", ".join(f"{i} AS ({INPUTS[i][1]})" for i in inputs)
            text = sql.strip()
            if heads and text.startswith("WITH "):
                text = text[5:]
                recursive = text.startswith("RECURSIVE ")
                SQL[name] = f"WITH {'RECURSIVE ' * recursive}{heads}, {text.removeprefix('RECURSIVE ')}"
            else:
                SQL[name] = f"WITH {heads} {text}" if heads else text
        return run

    return add


def _affine() -> F.Column:
    return F.struct("a", "b", "c", "d", "e", "f")


IOU_SQL = """CASE WHEN least({p}x2, {q}x2) > greatest({p}x1, {q}x1) AND least({p}y2, {q}y2) > greatest({p}y1, {q}y1)
  THEN (least({p}x2, {q}x2) - greatest({p}x1, {q}x1)) * (least({p}y2, {q}y2) - greatest({p}y1, {q}y1)) /
  (({p}x2 - {p}x1) * ({p}y2 - {p}y1) + ({q}x2 - {q}x1) * ({q}y2 - {q}y1)
   - (least({p}x2, {q}x2) - greatest({p}x1, {q}x1)) * (least({p}y2, {q}y2) - greatest({p}y1, {q}y1))) ELSE 0 END"""

# --- tile grids -------------------------------------------------------------

GRID_SQL = """
WITH rows_ AS (SELECT *, unnest(range(0, height, 48)) AS row_off FROM scene),
cells AS (SELECT *, unnest(range(0, width, 48)) AS col_off FROM rows_),
tiles AS (SELECT raster_id, width, height, CAST((row_off // 48) * ((width + 47) // 48) + col_off // 48 AS INT) AS tile_idx, CAST(col_off AS INT) AS col_off,
  CAST(row_off AS INT) AS row_off, CAST(least(64, width - col_off) AS INT) AS w, CAST(least(64, height - row_off) AS INT) AS h FROM cells)
"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(_input(spark, sf_dir, "scene"), 64, 0.25, keep=("raster_id",))


@query("tile_grid", GRID_SQL + "SELECT raster_id, tile_idx, col_off, row_off, w, h FROM tiles", ("scene",))
def _tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir)


@query(
    "tile_grid_coverage",
    GRID_SQL
    + """SELECT raster_id, count(*) AS tiles, CAST(max(col_off + w) AS INT) AS right_edge, CAST(max(row_off + h) AS INT) AS bottom_edge,
  CAST(sum(w * h) AS BIGINT) AS pixels FROM tiles GROUP BY raster_id""",
    ("scene",),
)
def _tile_grid_coverage(spark, sf_dir):
    tiles = _tiles(spark, sf_dir).groupBy("raster_id")
    area = F.sum((F.col("w") * F.col("h")).cast("bigint"))
    return tiles.agg(
        F.count("*").alias("tiles"), F.max(F.col("col_off") + F.col("w")).alias("right_edge"), F.max(F.col("row_off") + F.col("h")).alias("bottom_edge"), area.alias("pixels")
    )


@query(
    "valid_tile_sizes",
    """WITH m(variant, block_size) AS (VALUES ('nano', 32), ('small', 32), ('medium', 32), ('base', 56), ('large', 32))
SELECT variant, CAST(unnest(range(1, 2048 // block_size + 1)) * block_size AS INT) AS tile_size FROM m QUALIFY tile_size >= 128""".replace(
        " QUALIFY tile_size >= 128", ""
    ).replace("range(1,", "range((127 + block_size) // block_size,"),
)
def _valid_tile_sizes(spark, sf_dir):
    from tilewright.model import registry

    return grid.valid_tile_sizes(registry(spark).select("variant", "block_size"))


@query(
    "recommended_overlap",
    """SELECT raster_id, CASE WHEN height > 0 THEN least(0.49::DOUBLE, greatest(0.05::DOUBLE, (width / 10)::DOUBLE / height::DOUBLE / 0.3::DOUBLE)) ELSE 0.2::DOUBLE END AS overlap
FROM (SELECT raster_id, width::DOUBLE AS width, height::DOUBLE AS height FROM scene)""",
    ("scene",),
)
def _recommended_overlap(spark, sf_dir):
    s = _input(spark, sf_dir, "scene")
    return s.select("raster_id", labels.recommended_overlap(F.col("width").cast("double") / 10, F.col("height").cast("double")).alias("overlap"))


@query("detection_range", "SELECT raster_id, a * 10 AS least_m, width::DOUBLE * 0.8::DOUBLE * a AS most_m FROM scene", ("scene",))
def _detection_range(spark, sf_dir):
    s = _input(spark, sf_dir, "scene").select("raster_id", labels.detection_range(F.col("a"), F.col("width").cast("double")).alias("r"))
    return s.select("raster_id", F.col("r.least").alias("least_m"), F.col("r.most").alias("most_m"))


@query("coverage_km2", "SELECT raster_id, (width * a) * (height * a) / 1e6 AS km2 FROM scene", ("scene",))
def _coverage(spark, sf_dir):
    return _input(spark, sf_dir, "scene").select("raster_id", reports.coverage_km2(F.col("width"), F.col("height"), F.col("a")).alias("km2"))


# --- bands and pixels -------------------------------------------------------


@query(
    "band_clamp",
    """SELECT raster_id, array_to_string(list_transform([4, 3, 2], lambda n: least(n, band_count)), ',') AS bands,
  array_to_string(list_sort(list_distinct(list_transform([4, 3, 2], lambda n: least(n, band_count)))), ',') AS read_bands FROM scene""",
    ("scene",),
)
def _band_clamp(spark, sf_dir):
    n = pixels.clamped(F.array(*map(F.lit, pixels.band_numbers("sentinel2_rgb"))), F.col("band_count"))
    return _input(spark, sf_dir, "scene").select("raster_id", F.array_join(n.cast("array<string>"), ",").alias("bands"), F.array_join(pixels.read_order(n).cast("array<string>"), ",").alias("read_bands"))


def _four_bands(spark, sf_dir):
    """(vec_id, bands): 16 pixels in each of four bands; values under -0.2 are nodata, -1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda v: F.when(v < -0.2, F.lit(-1.0)).otherwise(v.cast("double"))
    bands = F.array(*[F.transform(F.slice("embedding", 16 * k + 1, 16), value) for k in range(4)])
    return e.select("vec_id", bands.alias("bands"))


FOUR_SQL = """
WITH px AS (SELECT vec_id, (i - 1) // 16 AS band, (i - 1) % 16 AS px, CASE WHEN embedding[i] < -0.2::DOUBLE THEN -1.0::DOUBLE ELSE embedding[i]::DOUBLE END AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
masked AS (SELECT vec_id, px, bool_and(v = -1) AS gone FROM px WHERE band < 2 GROUP BY vec_id, px)
"""


@query(
    "band_select",
    FOUR_SQL
    + "SELECT vec_id, CAST(pos AS INT) AS pos, CAST(px AS INT) AS px, v FROM px JOIN (VALUES (0, 3), (1, 2), (2, 1)) AS t(pos, band) USING (band)",
)
def _band_select(spark, sf_dir):
    d = _four_bands(spark, sf_dir)
    own = pixels.select_bands(F.slice("bands", 2, 3), F.array(F.lit(2), F.lit(3), F.lit(4)), F.array(F.lit(4), F.lit(3), F.lit(2)))
    rows = d.select("vec_id", F.posexplode(own).alias("pos", "band"))
    return rows.select("vec_id", "pos", F.posexplode("band").alias("px", "v"))


def _masked(spark, sf_dir):
    """Two bands with their mask."""
    d = _four_bands(spark, sf_dir).select("vec_id", F.slice("bands", 1, 2).alias("bands"))
    return d.withColumn("mask", pixels.nodata_mask(F.col("bands"), F.lit(-1.0)))


@query(
    "nodata_fraction", FOUR_SQL + "SELECT vec_id, count(*) FILTER (gone) / count(*)::DOUBLE AS fraction FROM masked GROUP BY vec_id"
)
def _nodata_fraction(spark, sf_dir):
    return _masked(spark, sf_dir).select("vec_id", pixels.nodata_fraction(F.col("mask")).alias("fraction"))


@query(
    "nodata_skip",
    FOUR_SQL + "SELECT vec_id FROM masked GROUP BY vec_id HAVING count(*) FILTER (gone) / count(*)::DOUBLE <= 0.0625::DOUBLE",
)
def _nodata_skip(spark, sf_dir):
    return _masked(spark, sf_dir).where(pixels.nodata_fraction(F.col("mask")) <= 0.0625).select("vec_id")


@query(
    "nodata_fill",
    FOUR_SQL
    + """, own AS (SELECT vec_id, band, px, v, gone FROM px JOIN masked USING (vec_id, px) WHERE band < 2),
means AS (SELECT vec_id, band, coalesce(sum(v) FILTER (NOT gone) / count(*) FILTER (NOT gone), 0) AS mean FROM own GROUP BY vec_id, band)
SELECT vec_id, CAST(band AS INT) AS band, CAST(px AS INT) AS px, round(CASE WHEN gone THEN mean ELSE v END, 6) AS v FROM own JOIN means USING (vec_id, band)""",
)
def _nodata_fill(spark, sf_dir):
    own = _masked(spark, sf_dir).select("vec_id", F.posexplode(pixels.fill_nodata(F.col("bands"), F.col("mask"))).alias("band", "vs"))
    return own.select("vec_id", "band", F.posexplode("vs").alias("px", "v")).withColumn("v", F.round("v", 6))


def _long(spark, sf_dir):
    d = _four_bands(spark, sf_dir).select("vec_id", F.posexplode("bands").alias("band", "vs"))
    return d.select("vec_id", "band", F.posexplode("vs").alias("px", "v"))


def _scene_limits(long: DataFrame, low: float, high: float, mode: str) -> DataFrame:
    """(band, vmin, vmax) of all pixels that have data."""
    kept = long.where("v != -1").groupBy("band")
    if mode == "minmax":
        return kept.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    return kept.agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p")).select("band", F.col("p")[0].alias("vmin"), F.col("p")[1].alias("vmax"))


def _stretch(spark, sf_dir, mode):
    long = _long(spark, sf_dir)
    limits = _scene_limits(long, 0.02, 0.98, mode)  # one row for each band
    s = long.join(F.broadcast(limits), "band")
    return s.select("vec_id", "band", "px", F.round(pixels.stretched(F.col("v"), F.col("vmin"), F.col("vmax")), 6).alias("v"))


STRETCH_SQL = """, lim AS (SELECT band, {limits} FROM px WHERE v != -1 GROUP BY band)
SELECT vec_id, CAST(band AS INT) AS band, CAST(px AS INT) AS px, round(CASE WHEN vmax = vmin THEN 0 ELSE greatest(0, least(1, (v - vmin) / (vmax - vmin))) END, 6) AS v
FROM px JOIN lim USING (band)"""


@query("stretch_percentile", FOUR_SQL + STRETCH_SQL.format(limits="quantile_cont(v, 0.02) AS vmin, quantile_cont(v, 0.98) AS vmax"))
def _stretch_percentile(spark, sf_dir):
    return _stretch(spark, sf_dir, "percentile")


@query("stretch_minmax", FOUR_SQL + STRETCH_SQL.format(limits="min(v) AS vmin, max(v) AS vmax"))
def _stretch_minmax(spark, sf_dir):
    return _stretch(spark, sf_dir, "minmax")


@query("stretch_none", FOUR_SQL + "SELECT vec_id, CAST(band AS INT) AS band, CAST(px AS INT) AS px, round(v, 6) AS v FROM px")
def _stretch_none(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(
    "stretch_precomputed",
    FOUR_SQL
    + """SELECT vec_id, CAST(band AS INT) AS band, CAST(px AS INT) AS px,
  round(CASE WHEN band = 3 THEN 0 ELSE greatest(0, least(1, (v + 0.25) / (CASE band WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 1 END))) END, 6) AS v FROM px""",
)
def _stretch_precomputed(spark, sf_dir):
    vmin, vmax = F.array(*[F.lit(-0.25)] * 4), F.array(*map(F.lit, (0.25, 0.5, 0.75, -0.25)))
    own = _four_bands(spark, sf_dir).select("vec_id", F.posexplode(pixels.stretch_bands(F.col("bands"), vmin, vmax)).alias("band", "vs"))
    return own.select("vec_id", "band", F.posexplode("vs").alias("px", "v")).withColumn("v", F.round("v", 6))


@query("to_uint8", FOUR_SQL + "SELECT vec_id, CAST(band AS INT) AS band, CAST(px AS INT) AS px, CAST(floor(greatest(0, least(1, v)) * 255) AS INT) AS v FROM px")
def _to_uint8(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("v", pixels.to_byte(F.col("v")))


@query(
    "stac_asset_pick",
    """WITH a AS (SELECT p_partkey AS item, unnest(['visual', 'data', 'thumb', 'extra']) AS k, unnest([CASE WHEN p_partkey % 3 = 0 THEN 'image/tiff' ELSE 'image/png' END,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'text/html' END, 'image/png', CASE WHEN p_partkey % 5 = 0 THEN 'image/tiff; application=geotiff' ELSE 'x' END]) AS media FROM part),
r AS (SELECT item, k, CASE WHEN k IN ('visual', 'data') AND (media LIKE '%tiff%' OR media = '') THEN CASE k WHEN 'visual' THEN 1 ELSE 3 END
  WHEN media LIKE '%tiff%' THEN 100 END AS rank FROM a)
SELECT item, arg_min(k, rank) AS asset FROM r WHERE rank IS NOT NULL GROUP BY item""",
)
def _stac_asset_pick(spark, sf_dir):
    from tilewright.sources.resolve import pick_assets

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    media = (
        ("visual", F.when(k % 3 == 0, "image/tiff").otherwise("image/png")),
        ("data", F.when(k % 2 == 0, "").otherwise("text/html")),
        ("thumb", F.lit("image/png")),
        ("extra", F.when(k % 5 == 0, "image/tiff; application=geotiff").otherwise("x")),
    )
    assets = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in media]), F.array(*[F.struct(F.concat(F.lit("h/"), F.lit(n)).alias("href"), m.alias("media_type")) for n, m in media])
    )
    picked = pick_assets(p.select(k.alias("item"), assets.alias("assets")), "assets")
    return picked.where("asset IS NOT NULL").select("item", "asset")


# --- ground distance, affine and coordinates ---------------------------------


@query(
    "gsd_compute",
    """SELECT raster_id, CASE unit WHEN 'metre' THEN (abs(a) + abs(e)) / 2 WHEN 'us_survey_foot' THEN (abs(a) + abs(e)) / 2 * 0.304800609601::DOUBLE
  WHEN 'foot' THEN (abs(a) + abs(e)) / 2 * 0.3048::DOUBLE WHEN 'degree' THEN (abs(a) + abs(e)) / 2 * 111000::DOUBLE END AS gsd_m FROM scene""",
    ("scene",),
)
def _gsd_compute(spark, sf_dir):
    return _input(spark, sf_dir, "scene").select("raster_id", geo.gsd(_affine(), F.col("unit")).alias("gsd_m"))


@query(
    "gsd_level",
    """SELECT raster_id, CASE WHEN g < 0.05::DOUBLE THEN 'far_too_fine' WHEN g < 0.1::DOUBLE THEN 'too_fine' WHEN g > 5 THEN 'too_coarse' WHEN g > 1 THEN 'coarse'
  WHEN g > 0.5::DOUBLE THEN 'rather_coarse' WHEN g IS NOT NULL THEN 'good' END AS level
FROM (SELECT raster_id, CASE unit WHEN 'metre' THEN a WHEN 'foot' THEN a * 0.3048::DOUBLE WHEN 'us_survey_foot' THEN a * 0.304800609601::DOUBLE WHEN 'degree' THEN a * 111000 END AS g FROM scene)""",
    ("scene",),
)
def _gsd_level(spark, sf_dir):
    return _input(spark, sf_dir, "scene").select("raster_id", geo.gsd_level(geo.gsd(_affine(), F.col("unit"))).alias("level"))


@query(
    "utm_zone",
    """SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6) + 1) AS INT) AS epsg
FROM (SELECT c_custkey, (c_custkey * 37) % 361 - 180 AS lon, (c_custkey * 17) % 160 - 80 AS lat FROM customer)""",
)
def _utm_zone(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lon, lat = (F.col("c_custkey") * 37) % 361 - 180, (F.col("c_custkey") * 17) % 160 - 80
    return c.select("c_custkey", geo.utm_epsg(lon, lat).alias("epsg"))


@query("offset_boxes", "SELECT det_id, x1 + (scene * 64) AS x1, y1 + (scene * 32) AS y1, x2 + (scene * 64) AS x2, y2 + (scene * 32) AS y2 FROM det", ("det",))
def _offset_boxes(spark, sf_dir):
    return _input(spark, sf_dir, "det").select("det_id", *bx.offset(F.col("scene") * 64, F.col("scene") * 32))


#: Every detection in one of the sixteen rasters that have its scene.
PLACED_SQL = "SELECT {} FROM det JOIN scene ON det.scene + 1 = scene.raster_id"


def _placed(spark, sf_dir):
    d, s = _input(spark, sf_dir, "det"), _input(spark, sf_dir, "scene")
    return d.join(F.broadcast(s.where("raster_id <= 16")), F.col("scene") + 1 == F.col("raster_id"))  # sixteen rows


@query(
    "pixel_to_geo",
    PLACED_SQL.format(
        "det_id, "
        + ", ".join(f"a * {x} + b * {y} + c AS gx{i}, d * {x} + e * {y} + f AS gy{i}" for i, (x, y) in enumerate((("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    ),
    ("det", "scene"),
)
def _pixel_to_geo(spark, sf_dir):
    q = _placed(spark, sf_dir).select("det_id", bx.quad(_affine(), bx.box()).alias("ring"))
    return q.select("det_id", *[F.col("ring")[i][v].alias(f"g{v}{i}") for i in range(4) for v in "xy"])


@query("geo_to_pixel_roundtrip", PLACED_SQL.format("det_id, round(x1, 4) AS px, round(y1, 4) AS py"), ("det", "scene"))
def _roundtrip(spark, sf_dir):
    q = _placed(spark, sf_dir).select("det_id", _affine().alias("t"), bx.to_geo(_affine(), F.col("x1"), F.col("y1")).alias("g"))
    q = q.select("det_id", bx.to_pixel(F.col("t"), F.col("g.x"), F.col("g.y")).alias("p"))
    return q.select("det_id", F.round("p.x", 4).alias("px"), F.round("p.y", 4).alias("py"))


@query("has_rotation", "SELECT raster_id, b <> 0 OR d <> 0 AS rotated FROM scene", ("scene",))
def _has_rotation(spark, sf_dir):
    return _input(spark, sf_dir, "scene").select("raster_id", bx.has_rotation(_affine()).alias("rotated"))


@query(
    "centroids",
    PLACED_SQL.format("det_id, round(a * (x1 + x2) / 2 + b * (y1 + y2) / 2 + c, 6) AS cx, round(d * (x1 + x2) / 2 + e * (y1 + y2) / 2 + f, 6) AS cy"),
    ("det", "scene"),
)
def _centroids(spark, sf_dir):
    q = _placed(spark, sf_dir).select("det_id", bx.quad_centroid(_affine(), bx.box()).alias("p"))
    return q.select("det_id", F.round("p.x", 6).alias("cx"), F.round("p.y", 6).alias("cy"))


@query(
    "quad_area",
    PLACED_SQL.format("det_id, round(abs(a * e - b * d) * (x2 - x1) * (y2 - y1) * 1.0000001::DOUBLE, 3) AS area_m2"),
    ("det", "scene"),
)
def _quad_area(spark, sf_dir):
    q = _placed(spark, sf_dir).select("det_id", bx.quad(_affine(), bx.box()).alias("ring"))
    # relative to the ring's first corner, where products are small enough to keep their digits
    moved = F.transform("ring", lambda p: F.struct((p["x"] - F.col("ring")[0]["x"]).alias("x"), (p["y"] - F.col("ring")[0]["y"]).alias("y")))
    return q.select("det_id", F.round(bx.ring_area(moved) * 1.0000001, 3).alias("area_m2"))  # off ties of rounding


# --- overlaps and suppression -------------------------------------------------


@query(
    "iou_pairs",
    f"""SELECT p.det_id AS hi, q.det_id AS lo FROM det p JOIN det q ON p.scene = q.scene AND p.cls = q.cls
AND (p.conf > q.conf OR (p.conf = q.conf AND p.det_id < q.det_id)) AND {IOU_SQL.format(p="p.", q="q.")} > 0.3::DOUBLE""",
    ("det",),
)
def _iou_pairs(spark, sf_dir):
    return nms.overlaps(_input(spark, sf_dir, "det"), 0.3, ["scene", "cls"], "conf", "det_id")


NMS_SQL = """
WITH RECURSIVE d AS (SELECT * FROM det WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY scene, cls ORDER BY conf DESC, det_id) AS rk FROM d),
walk AS (
  SELECT scene, cls, rk, [struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM r WHERE rk = 1
  UNION ALL
  SELECT r.scene, r.cls, r.rk, CASE WHEN len(list_filter(s.kept, lambda k: {iou} > {threshold}::DOUBLE)) = 0
    THEN list_append(s.kept, struct_pack(det_id := r.det_id, x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)) ELSE s.kept END
  FROM walk s JOIN r ON r.scene = s.scene AND r.cls = s.cls AND r.rk = s.rk + 1)
, stays AS (SELECT unnest(k).det_id AS det_id FROM (SELECT arg_max(kept, rk) AS k FROM walk GROUP BY scene, cls))
"""


def _nms_sql(threshold: float, where: str = "true") -> str:
    return NMS_SQL.format(where=where, threshold=threshold, iou=IOU_SQL.format(p="k.", q="r."))


def _nms(spark, sf_dir, threshold, strategy="auto", least=None):
    d = _input(spark, sf_dir, "det")
    d = d if least is None else d.where(F.col("conf") >= least)  # below the suppression, with which it commutes
    return nms.nms(d, threshold, ["scene", "cls"], "conf", "det_id", strategy)


@query("nms", _nms_sql(0.3) + "SELECT det_id FROM stays", ("det",))
def _nms_query(spark, sf_dir):
    return _nms(spark, sf_dir, 0.3).select("det_id")


@query("nms_rounds", _nms_sql(0.3) + "SELECT det_id FROM stays", ("det",))
def _nms_rounds(spark, sf_dir):
    return _nms(spark, sf_dir, 0.3, "rounds").select("det_id")


@query("nms_low_threshold", _nms_sql(0.01) + "SELECT det_id FROM stays", ("det",))
def _nms_low(spark, sf_dir):
    return _nms(spark, sf_dir, 0.01).select("det_id")


@query("nms_threshold_pushdown", _nms_sql(0.3) + "SELECT stays.det_id FROM stays JOIN det USING (det_id) WHERE conf >= 0.4::DOUBLE", ("det",))
def _nms_pushdown(spark, sf_dir):
    return _nms(spark, sf_dir, 0.3, least=0.4).select("det_id")


@query(
    "edge_zone_filter",
    f"""WITH t AS (SELECT *, (x1 + x2) / 2 - floor(x1 / 512) * 512 AS cx, (y1 + y2) / 2 - floor(y1 / 512) * 512 AS cy FROM det),
m AS (SELECT *, cx < 51.2::DOUBLE OR cx > 512 - 51.2::DOUBLE OR cy < 51.2::DOUBLE OR cy > 512 - 51.2::DOUBLE AS edge FROM t)
SELECT p.det_id FROM m p WHERE NOT p.edge OR NOT EXISTS (SELECT 1 FROM m q WHERE q.scene = p.scene AND NOT q.edge AND {IOU_SQL.format(p="p.", q="q.")} > 0.3::DOUBLE)""",
    ("det",),
)
def _edge_zone(spark, sf_dir):
    d = _input(spark, sf_dir, "det").withColumns(
        {"col_off": F.floor(F.col("x1") / 512) * 512, "row_off": F.floor(F.col("y1") / 512) * 512, "w": F.lit(512), "h": F.lit(512)}
    )
    return nms.edge_zone_filter(d, 0.3, 0.1, "scene").select("det_id")


# --- labels, filters, reports ---------------------------------------------------

NAMES = {1: "click", 2: "view", 3: "purchase"}
NAME_SQL = "CASE class_id WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'purchase' ELSE 'class_' || class_id END"


def _named(spark, sf_dir):
    d = _input(spark, sf_dir, "det").withColumnRenamed("conf", "confidence")
    return d.withColumns({"class_name": labels.class_label(F.col("class_id"), NAMES), "area_m2": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))})


NAMED_SQL = f"WITH named AS (SELECT det_id, scene, x1, y1, x2, y2, conf AS confidence, class_id, {NAME_SQL} AS class_name, (x2 - x1) * (y2 - y1) AS area_m2 FROM det)\n"


@query("label_fallback", NAMED_SQL + "SELECT det_id, class_name FROM named", ("det",))
def _label_fallback(spark, sf_dir):
    return _named(spark, sf_dir).select("det_id", "class_name")


@query("class_filter", NAMED_SQL + "SELECT det_id FROM named WHERE class_name IN ('click', 'class_7')", ("det",))
def _class_filter(spark, sf_dir):
    return spatial.display_filter(_named(spark, sf_dir), classes=["click", "class_7"]).select("det_id")


@query("conf_filter", NAMED_SQL + "SELECT det_id FROM named WHERE confidence >= 0.35::DOUBLE", ("det",))
def _conf_filter(spark, sf_dir):
    return spatial.display_filter(_named(spark, sf_dir), 0.35).select("det_id")


@query("high_confidence", NAMED_SQL + "SELECT det_id FROM named WHERE confidence > 0.7::DOUBLE", ("det",))
def _high_confidence(spark, sf_dir):
    return _named(spark, sf_dir).where("confidence > 0.7D").select("det_id")


@query("aoi_filter", NAMED_SQL + "SELECT det_id FROM named WHERE x1 <= 900 AND x2 >= 500 AND y1 <= 1400 AND y2 >= 700", ("det",))
def _aoi_filter(spark, sf_dir):
    return _named(spark, sf_dir).where(spatial.intersects_box(bx.box(), (500, 700, 900, 1400))).select("det_id")


@query("top_n", NAMED_SQL + "SELECT det_id, confidence FROM named ORDER BY confidence DESC, det_id LIMIT 300", ("det",))
def _top_n(spark, sf_dir):
    return spatial.top_n(_named(spark, sf_dir), 300).select("det_id", "confidence")


@query(
    "confidence_rank",
    NAMED_SQL + "SELECT det_id, CAST(row_number() OVER (PARTITION BY scene, class_id ORDER BY confidence DESC, det_id) AS INT) AS rank FROM named",
    ("det",),
)
def _confidence_rank(spark, sf_dir):
    return nms.ranked(_named(spark, sf_dir), ["scene", "class_id"]).select("det_id", "rank")


@query(
    "class_colors",
    NAMED_SQL
    + f"""SELECT class_name, ([{", ".join("'#%02x%02x%02x'" % c for c in labels.PALETTE)}])[CAST(row_number() OVER (ORDER BY class_name) AS INT)] AS colour
FROM (SELECT DISTINCT class_name FROM named)""",
    ("det",),
)
def _class_colors(spark, sf_dir):
    from pyspark.sql import Window

    names = _named(spark, sf_dir).select("class_name").distinct()  # the classes are few
    return names.select("class_name", labels.palette_colour(F.row_number().over(Window.orderBy("class_name")) - 1).alias("colour"))


@query("rgb_hex", "SELECT det_id, '#' || lpad(lower(to_hex(CAST(floor(conf * 255) AS INT))), 2, '0') || '80ff' AS colour FROM det", ("det",))
def _rgb_hex(spark, sf_dir):
    return _input(spark, sf_dir, "det").select("det_id", labels.hex_colour(F.col("conf"), F.lit(0.503), F.lit(1.0)).alias("colour"))


@query(
    "class_counts", NAMED_SQL + "SELECT class_name, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM named GROUP BY class_name", ("det",)
)
def _class_counts(spark, sf_dir):
    return reports.class_counts(_named(spark, sf_dir))


@query(
    "conf_stats",
    NAMED_SQL
    + "SELECT min(confidence) AS min_conf, round(avg(confidence), 9) AS mean_conf, median(confidence) AS median_conf, max(confidence) AS max_conf FROM named",
    ("det",),
)
def _conf_stats(spark, sf_dir):
    return reports.confidence_stats(_named(spark, sf_dir)).withColumn("mean_conf", F.round("mean_conf", 9))


@query(
    "threshold_sweep",
    NAMED_SQL
    + """, t AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999]) AS DOUBLE) AS threshold)
SELECT threshold, count(det_id) AS detections, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, count(DISTINCT class_name) AS unique_classes
FROM t LEFT JOIN named ON confidence >= threshold GROUP BY threshold""",
    ("det",),
)
def _threshold_sweep(spark, sf_dir):
    out = reports.threshold_sweep(_named(spark, sf_dir), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999])
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "change_report",
    NAMED_SQL
    + """, b AS (SELECT class_name, count(*) AS n FROM named WHERE scene < 8 AND class_name <> 'view' GROUP BY 1),
a AS (SELECT class_name, count(*) AS n FROM named WHERE scene >= 8 AND class_name <> 'purchase' GROUP BY 1)
SELECT class_name, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change,
  CASE WHEN b.n > 0 THEN CASE WHEN coalesce(a.n, 0) >= b.n THEN '+' ELSE '' END || printf('%.1f', (coalesce(a.n, 0) - b.n) * 100.0 / b.n) || '%' WHEN a.n > 0 THEN 'new' ELSE '--' END AS pct
FROM b FULL OUTER JOIN a USING (class_name)""",
    ("det",),
)
def _change_report(spark, sf_dir):
    n = _named(spark, sf_dir)
    return reports.change_report(n.where("scene < 8 AND class_name <> 'view'"), n.where("scene >= 8 AND class_name <> 'purchase'"))


@query(
    "per_class_area",
    NAMED_SQL + "SELECT class_name, count(*) AS n, round(avg(area_m2), 6) AS mean_area, round(avg(confidence), 9) AS mean_confidence FROM named GROUP BY class_name",
    ("det",),
)
def _per_class_area(spark, sf_dir):
    out = reports.per_class(_named(spark, sf_dir))
    return out.withColumns({"mean_area": F.round("mean_area", 6), "mean_confidence": F.round("mean_confidence", 9)})


@query(
    "total_bounds",
    NAMED_SQL
    + """SELECT min_x, min_y, max_x, max_y, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y, CAST(15 AS INT) AS zoom
FROM (SELECT min(x1) AS min_x, min(y1) AS min_y, max(x2) AS max_x, max(y2) AS max_y FROM named)""",
    ("det",),
)
def _total_bounds(spark, sf_dir):
    return reports.total_bounds(_named(spark, sf_dir))


@query(
    "batch_summary",
    """WITH files AS (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN -1 ELSE count(*) END AS detections, round(sum(value), 2) AS seconds FROM events GROUP BY user_id)
SELECT count(*) AS files, count(*) FILTER (detections >= 0) AS succeeded, count(*) FILTER (detections < 0) AS failed,
  CAST(sum(detections) FILTER (detections >= 0) AS BIGINT) AS detections, round(sum(seconds) FILTER (detections >= 0), 2) AS seconds FROM files""",
)
def _batch_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id")
    files = e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("seconds"))
    files = files.select(F.when(F.col("user_id") % 11 == 0, -1).otherwise(F.col("n")).alias("detections"), "seconds")
    return reports.batch_summary(files).withColumn("seconds", F.round("seconds", 2))


@query(
    "gis_enrichment",
    NAMED_SQL + "SELECT det_id, round(area_m2, 2) AS area_m2, round(confidence, 4) AS confidence, round((x1 + x2) / 2, 6) AS cx, 'scene_' || scene AS source_image FROM named",
    ("det",),
)
def _gis_enrichment(spark, sf_dir):
    return _named(spark, sf_dir).select(
        "det_id",
        F.round("area_m2", 2).alias("area_m2"),
        F.round("confidence", 4).alias("confidence"),
        F.round((F.col("x1") + F.col("x2")) / 2, 6).alias("cx"),
        F.concat(F.lit("scene_"), F.col("scene").cast("string")).alias("source_image"),
    )


# --- training sets ---------------------------------------------------------------

TILES16_SQL = """
WITH cells AS (SELECT scene, r, unnest(range(0, 1280, 102)) AS c FROM (SELECT scene, unnest(range(0, 1280, 102)) AS r FROM (SELECT unnest(range(0, 16)) AS scene))),
tiles AS (SELECT scene, CAST((r // 102) * 13 + c // 102 AS INT) AS tile_idx, CAST(c AS DOUBLE) AS tx1, CAST(r AS DOUBLE) AS ty1,
  CAST(least(c + 128, 1280) AS DOUBLE) AS tx2, CAST(least(r + 128, 1280) AS DOUBLE) AS ty2, c AS col_off, r AS row_off FROM cells),
met AS (SELECT t.*, a.ann_id, a.class_name, a.x1, a.y1, a.x2, a.y2 FROM tiles t JOIN ann a ON a.scene = t.scene AND a.x1 <= t.tx2 AND a.x2 >= t.tx1 AND a.y1 <= t.ty2 AND a.y2 >= t.ty1)
"""


def _tiles16(spark):
    return grid.tile_grid(_scenes(spark), 128, 0.2, keep=("scene",))


def _met(spark, sf_dir):
    return spatial.tile_annotations(_tiles16(spark), _input(spark, sf_dir, "ann"), "scene")


@query("tile_ann_join", TILES16_SQL + "SELECT scene, tile_idx, ann_id FROM met", ("ann",))
def _tile_ann_join(spark, sf_dir):
    return _met(spark, sf_dir).select("scene", "tile_idx", "ann_id")


CLIP_SQL = TILES16_SQL + """, clip AS (SELECT scene, tile_idx, ann_id, class_name, tx1, ty1, tx2, ty2, greatest(x1, tx1) AS x1, greatest(y1, ty1) AS y1, least(x2, tx2) AS x2, least(y2, ty2) AS y2 FROM met
  WHERE least(x2, tx2) > greatest(x1, tx1) AND least(y2, ty2) > greatest(y1, ty1))
"""


@query("clip_to_tile", CLIP_SQL + "SELECT scene, tile_idx, ann_id, x1, y1, x2, y2 FROM clip", ("ann",))
def _clip_to_tile(spark, sf_dir):
    return spatial.clip_to_tiles(_met(spark, sf_dir)).select("scene", "tile_idx", "ann_id", "x1", "y1", "x2", "y2")


def _coco(spark, sf_dir):
    """Clipped annotations as boxes of their tile, through an affine of half-unit pixels."""
    c = spatial.clip_to_tiles(_met(spark, sf_dir))
    t = F.struct(F.lit(0.5).alias("a"), F.lit(0.0).alias("b"), (F.col("tx1") * 0.5).alias("c"), F.lit(0.0).alias("d"), F.lit(-0.5).alias("e"), (F.col("ty1") * -0.5).alias("f"))
    scaled = tuple(F.col(s) * k for s, k in (("x1", 0.5), ("y1", -0.5), ("x2", 0.5), ("y2", -0.5)))
    return c.select("scene", "tile_idx", "ann_id", "class_name", "tx1", "ty1", "tx2", "ty2", *bx.coco_bbox(t, scaled))


COCO_SQL = CLIP_SQL + ', coco AS (SELECT *, x1 - tx1 AS bx, y1 - ty1 AS "by", x2 - x1 AS bw, y2 - y1 AS bh FROM clip)\n'


@query("coco_bbox", COCO_SQL + 'SELECT scene, tile_idx, ann_id, bx, "by", bw, bh FROM coco', ("ann",))
def _coco_bbox(spark, sf_dir):
    return _coco(spark, sf_dir).select("scene", "tile_idx", "ann_id", "bx", "by", "bw", "bh")


@query("min_area_filter", COCO_SQL + "SELECT scene, tile_idx, ann_id FROM coco WHERE bw * bh >= 400", ("ann",))
def _min_area(spark, sf_dir):
    return spatial.at_least(_coco(spark, sf_dir), 400).select("scene", "tile_idx", "ann_id")


#: The scenes as the left part of rasters three times as wide, so that there are tiles without annotations.
MARKED_SQL = TILES16_SQL.replace("range(0, 1280, 102)) AS c", "range(0, 3840, 102)) AS c").replace("* 13 + c", "* 38 + c").replace("least(c + 128, 1280)", "least(c + 128, 3840)") + """, seen AS (SELECT DISTINCT scene, tile_idx FROM met),
marked AS (SELECT t.scene, t.tile_idx, s.scene IS NOT NULL AS annotated FROM tiles t LEFT JOIN seen s USING (scene, tile_idx))
"""


@query(
    "background_cap",
    MARKED_SQL
    + """SELECT scene, tile_idx, annotated FROM (SELECT *, row_number() OVER (PARTITION BY scene, annotated ORDER BY md5('42:' || scene || ':' || tile_idx), tile_idx) AS rk,
  floor(sum(CASE WHEN annotated THEN 1 ELSE 0 END) OVER (PARTITION BY scene) * 0.3) AS cap FROM marked) WHERE annotated OR rk <= cap""",
    ("ann",),
)
def _background_cap(spark, sf_dir):
    wide = grid.tile_grid(_scenes(spark).withColumn("width", F.lit(3840)), 128, 0.2, keep=("scene",))
    seen = spatial.tile_annotations(wide, _input(spark, sf_dir, "ann"), "scene").select("scene", "tile_idx").distinct().withColumn("annotated", F.lit(True))
    tiles = wide.join(seen, ["scene", "tile_idx"], "left").fillna(False, "annotated")
    return spatial.background_cap(tiles, 0.3, 42, "scene").select("scene", "tile_idx", "annotated")


@query(
    "class_mapping_auto",
    "SELECT ann_id, CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INT) AS class_id FROM ann",
    ("ann",),
)
def _class_mapping(spark, sf_dir):
    return spatial.map_classes(_input(spark, sf_dir, "ann")).select("ann_id", "class_id")


@query(
    "class_mapping_given",
    "SELECT ann_id, CAST(CASE class_name WHEN '1-URGENT' THEN 5 ELSE 6 END AS INT) AS class_id FROM ann WHERE class_name IN ('1-URGENT', '2-HIGH')",
    ("ann",),
)
def _class_mapping_given(spark, sf_dir):
    return spatial.map_classes(_input(spark, sf_dir, "ann"), {"1-URGENT": 5, "2-HIGH": 6}).select("ann_id", "class_id")


SPLIT_SQL = """
WITH cells AS (SELECT raster_id, width, height, row_off, unnest(range(0, width, 32)) AS col_off FROM (SELECT raster_id, width, height, unnest(range(0, height, 32)) AS row_off FROM scene)),
sized AS (SELECT *, greatest(1, width // 32) AS cols, greatest(1, height // 32) AS rws, greatest(1, floor(sqrt(greatest(3, floor(sqrt(count(*) OVER (PARTITION BY raster_id))))))) AS per, col_off // 32 AS gx, row_off // 32 AS gy FROM cells),
blk AS (SELECT *, greatest(1, ceil(cols / per)) AS bc, greatest(1, ceil(rws / per)) AS br FROM sized),
blocked AS (SELECT raster_id, gx, gy, (row_off // 32) * ((width + 31) // 32) + col_off // 32 AS tile_idx, CAST(least(floor(gx / bc), greatest(1, ceil(cols / bc)) - 1) AS INT) AS block_x,
  CAST(least(floor(gy / br), greatest(1, ceil(rws / br)) - 1) AS INT) AS block_y FROM blk),
dealt AS (SELECT raster_id, block_x, block_y, row_number() OVER (PARTITION BY raster_id ORDER BY md5('42:' || block_x || ':' || block_y), block_x, block_y) AS rk,
  count(*) OVER (PARTITION BY raster_id) AS n FROM (SELECT DISTINCT raster_id, block_x, block_y FROM blocked)),
cut AS (SELECT *, greatest(1, round_even(n * 0.8::DOUBLE, 0)) AS tr FROM dealt),
cut2 AS (SELECT *, least(greatest(0, round_even(n * 0.15::DOUBLE, 0)), n - tr) AS va FROM cut),
named AS (SELECT raster_id, block_x, block_y, CASE WHEN n <= 2 OR rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'val' ELSE 'test' END AS split FROM cut2),
parts AS (SELECT b.raster_id, CAST(b.tile_idx AS INT) AS tile_idx, b.gx, b.gy, b.block_x, b.block_y, n.split FROM blocked b JOIN named n USING (raster_id, block_x, block_y))
"""


def _split_tiles(spark, sf_dir):
    s = _input(spark, sf_dir, "scene")
    sized = s.select("raster_id", "width", "height", F.struct("width", "height").alias("size"))
    return grid.tile_grid(sized, 32, 0.0, keep=("raster_id", "size")).select("*", "size.width", "size.height").drop("size")


@query("block_split", SPLIT_SQL + "SELECT raster_id, tile_idx, block_x, block_y, split FROM parts", ("scene",))
def _block_split(spark, sf_dir):
    return split.block_split(_split_tiles(spark, sf_dir), 32).select("raster_id", "tile_idx", "block_x", "block_y", "split")


@query(
    "split_buffer",
    SPLIT_SQL
    + """SELECT p.raster_id, p.tile_idx, CASE WHEN EXISTS (SELECT 1 FROM parts q WHERE q.raster_id = p.raster_id AND abs(q.gx - p.gx) <= 1 AND abs(q.gy - p.gy) <= 1 AND q.split <> p.split)
  THEN 'buffer' ELSE p.split END AS split FROM parts p""",
    ("scene",),
)
def _split_buffer(spark, sf_dir):
    return split.block_split(_split_tiles(spark, sf_dir), 32, buffer=1).select("raster_id", "tile_idx", "split")


@query(
    "random_split",
    SPLIT_SQL
    + """, rk AS (SELECT raster_id, tile_idx, row_number() OVER (PARTITION BY raster_id ORDER BY md5('42:' || raster_id || ':' || tile_idx), tile_idx) AS rk, count(*) OVER (PARTITION BY raster_id) AS n FROM parts),
sz AS (SELECT *, round_even(n * 0.8::DOUBLE, 0) AS tr, least(round_even(n * 0.15::DOUBLE, 0), n - round_even(n * 0.8::DOUBLE, 0)) AS va FROM rk)
SELECT raster_id, tile_idx, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'val' ELSE 'test' END AS split FROM sz""",
    ("scene",),
)
def _random_split(spark, sf_dir):
    return split.random_split(_split_tiles(spark, sf_dir)).select("raster_id", "tile_idx", "split")


def _hash32(what: str) -> str:
    return f"('0x' || substr(md5('42:' || image_id || ':1:{what}'), 1, 8))::BIGINT"


@query(
    "bbox_augment",
    f"""WITH img AS (SELECT ann_id, scene AS image_id, x1 AS bx, y1 AS "by", x2 - x1 AS bw, y2 - y1 AS bh, 1280::DOUBLE AS w, 1200::DOUBLE AS h FROM ann),
c AS (SELECT *, CASE WHEN {_hash32("rot")} % 2 = 0 THEN {_hash32("k")} % 3 + 1 ELSE 0 END AS k, {_hash32("h")} % 2 = 0 AS hf, {_hash32("v")} % 2 = 0 AS vf FROM img),
t AS (SELECT ann_id, k, hf, vf, CASE k WHEN 0 THEN bx WHEN 1 THEN h - "by" - bh WHEN 2 THEN w - bx - bw ELSE "by" END AS bx, CASE k WHEN 0 THEN "by" WHEN 1 THEN bx WHEN 2 THEN h - "by" - bh ELSE w - bx - bw END AS "by",
  CASE WHEN k % 2 = 0 THEN bw ELSE bh END AS bw, CASE WHEN k % 2 = 0 THEN bh ELSE bw END AS bh, CASE WHEN k % 2 = 0 THEN w ELSE h END AS w, CASE WHEN k % 2 = 0 THEN h ELSE w END AS h FROM c)
SELECT ann_id, CAST(1 AS INT) AS copy, CASE WHEN hf THEN w - bx - bw ELSE bx END AS bx, CASE WHEN vf THEN h - "by" - bh ELSE "by" END AS "by", bw, bh, w, h FROM t
UNION ALL SELECT ann_id, CAST(0 AS INT), bx, "by", bw, bh, w, h FROM img""",
    ("ann",),
)
def _bbox_augment(spark, sf_dir):
    a = _input(spark, sf_dir, "ann")
    own = a.select(
        "ann_id", F.col("scene").alias("image_id"), F.col("x1").alias("bx"), F.col("y1").alias("by"), (F.col("x2") - F.col("x1")).alias("bw"), (F.col("y2") - F.col("y1")).alias("bh"),
        F.lit(1280.0).alias("w"), F.lit(1200.0).alias("h"),
    )
    out = augment.augment(own, augment.AUGMENTATION_PRESETS["satellite_default"], 2)
    return out.select("ann_id", "copy", "bx", "by", "bw", "bh", "w", "h")


@query(
    "coco_export_rows",
    NAMED_SQL
    + """SELECT CAST(row_number() OVER (ORDER BY det_id) - 1 AS BIGINT) AS id, CAST(0 AS INT) AS image_id, CAST(class_id AS INT) AS category_id, x1 AS bbox_x, y1 AS bbox_y,
  x2 - x1 AS bbox_w, y2 - y1 AS bbox_h, round((x2 - x1) * (y2 - y1), 6) AS area FROM named""",
    ("det",),
)
def _coco_rows(spark, sf_dir):
    from tilewright.sources.sinks import coco_annotations

    out = coco_annotations(_named(spark, sf_dir))
    return out.withColumn("area", F.round("area", 6))


@query(
    "yolo_lines",
    NAMED_SQL
    + """SELECT det_id, class_id || ' ' || printf('%.6f', greatest(0, least(1, (x1 + x2) / 2 / 4243))) || ' ' || printf('%.6f', greatest(0, least(1, (y1 + y2) / 2 / 4201)))
  || ' ' || printf('%.6f', greatest(0, least(1, (x2 - x1) / 4243))) || ' ' || printf('%.6f', greatest(0, least(1, (y2 - y1) / 4201))) AS line FROM named""",
    ("det",),
)
def _yolo_lines(spark, sf_dir):
    from tilewright.sources.sinks import yolo_line

    return _named(spark, sf_dir).select("det_id", yolo_line(F.col("class_id"), bx.box(), 4243, 4201).alias("line"))


@query(
    "styled_features",
    NAMED_SQL
    + """SELECT det_id, CASE class_name WHEN 'click' THEN '#1f77b4' ELSE '#ff0000' END AS fill, round(0.3::DOUBLE + 0.5::DOUBLE * (confidence * 1.0000001::DOUBLE), 6) AS opacity,
  'Class: ' || class_name || '<br>Confidence: ' || printf('%.3f', confidence * 1.0000001::DOUBLE) || '<br>Area: ' || printf('%.1f', area_m2 * 1.0000001::DOUBLE) || ' m2' AS popup FROM named""",
    ("det",),
)
def _styled(spark, sf_dir):
    from tilewright.sources.sinks import styled

    off_ties = {c: F.col(c) * 1.0000001 for c in ("confidence", "area_m2")}  # the engines print exact halves differently
    out = styled(_named(spark, sf_dir).withColumns(off_ties), {"click": "#1f77b4"})
    return out.select("det_id", F.col("fill"), F.round("opacity", 6).alias("opacity"), "popup")


@query(
    "split_stats",
    SPLIT_SQL + "SELECT split, count(*) AS tiles, count(DISTINCT raster_id) AS rasters FROM parts GROUP BY split",
    ("scene",),
)
def _split_stats(spark, sf_dir):
    return split.block_split(_split_tiles(spark, sf_dir), 32).groupBy("split").agg(F.count("*").alias("tiles"), F.count_distinct("raster_id").alias("rasters"))


# --- sources, coordinates and reports beyond boxes --------------------------------


@query(
    "alpha_mask",
    FOUR_SQL + "SELECT vec_id, CAST(px AS INT) AS px, v = -1 AS gone FROM px WHERE band = 3",
)
def _alpha_mask(spark, sf_dir):
    d = _four_bands(spark, sf_dir)
    zeroed = F.transform("bands", lambda b: F.transform(b, lambda v: F.when(v == -1, 0.0).otherwise(F.abs(v) + 1)))
    mask = pixels.alpha_mask(zeroed, F.array(F.lit(1), F.lit(2), F.lit(3)))
    return d.select("vec_id", F.posexplode(mask).alias("px", "gone"))


PLACES_SQL = "WITH places AS (SELECT c_custkey, ((c_custkey * 37) % 3590)::DOUBLE / 10 - 179.5::DOUBLE AS lon, ((c_custkey * 17) % 1600)::DOUBLE / 10 - 79.9::DOUBLE AS lat FROM customer)\n"


def _places(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lon = ((F.col("c_custkey") * 37) % 3590).cast("double") / 10 - 179.5
    lat = ((F.col("c_custkey") * 17) % 1600).cast("double") / 10 - 79.9
    return c.select("c_custkey", lon.alias("lon"), lat.alias("lat"))


@query("reproject_mercator", PLACES_SQL + "SELECT c_custkey, round(radians(lon) * 6378137, 3) + 0.0::DOUBLE AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0.0::DOUBLE AS y FROM places")
def _reproject_mercator(spark, sf_dir):
    ring = geo.reproject_ring(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))), 4326, 3857)
    p = _places(spark, sf_dir).select("c_custkey", ring[0].alias("p"))
    return p.select("c_custkey", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))


@query("utm_round_trip", PLACES_SQL + "SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM places")
def _utm_round_trip(spark, sf_dir):
    zone = geo.utm_epsg(F.col("lon"), F.col("lat"))
    p = _places(spark, sf_dir).withColumn("zone", zone).withColumn("m", geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone")))
    p = p.select("c_custkey", geo.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone")).alias("d"))
    return p.select("c_custkey", F.round("d.x", 7).alias("lon"), F.round("d.y", 7).alias("lat"))


@query(
    "align_annotations",
    PLACES_SQL
    + """, corners AS (SELECT c_custkey, i, lon + CASE WHEN i IN (1, 2) THEN 0.25::DOUBLE ELSE 0 END AS lon, lat + CASE WHEN i IN (2, 3) THEN 0.125::DOUBLE ELSE 0 END AS lat FROM places, (VALUES (0), (1), (2), (3)) AS t(i))
SELECT c_custkey AS ann_id, CAST(i AS INT) AS i, round(radians(lon) * 6378137, 3) + 0.0::DOUBLE AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0.0::DOUBLE AS y FROM corners""",
)
def _align_annotations(spark, sf_dir):
    from tilewright.plans.training import align

    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.25, 0.0), corner(0.25, 0.125), corner(0.0, 0.125))
    own = align(_places(spark, sf_dir).select(F.col("c_custkey").alias("ann_id"), F.array(ring).alias("rings")), 4326, 3857)
    points = own.select("ann_id", F.posexplode(F.col("rings")[0]).alias("i", "p"))
    return points.select("ann_id", "i", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))


@query("areas_m2", "SELECT det_id, round((x2 - x1) * (y2 - y1) * 1.0000001::DOUBLE, 3) AS area_m2 FROM det", ("det",))
def _areas_m2(spark, sf_dir):
    from tilewright.session import areas_m2

    unit = F.struct(*[F.lit(v).alias(c) for c, v in zip("abcdef", (1.0, 0.0, 500000.0, 0.0, -1.0, 4000000.0), strict=True)])
    own = areas_m2(_input(spark, sf_dir, "det").select("det_id", bx.quad(unit, bx.box()).alias("ring")), 32633)
    return own.select("det_id", F.round(F.col("area_m2") * 1.0000001, 3).alias("area_m2"))


@query(
    "geojson_features",
    "SELECT det_id, class_id, CAST(i AS INT) AS i, round((CASE WHEN i IN (1, 2) THEN x2 ELSE x1 END) / 100, 6) + 0.0::DOUBLE AS lon, round(-(CASE WHEN i IN (2, 3) THEN y2 ELSE y1 END) / 100, 6) + 0.0::DOUBLE AS lat FROM det, (VALUES (0), (1), (2), (3), (4)) AS t(i)",
    ("det",),
)
def _geojson_features(spark, sf_dir):
    """Features are written as text and read back from it."""
    from tilewright.sources.sinks import features

    hundredth = F.struct(*[F.lit(v).alias(c) for c, v in zip("abcdef", (0.01, 0.0, 0.0, 0.0, -0.01, 0.0), strict=True)])
    rows = _input(spark, sf_dir, "det").select("det_id", "class_id", bx.quad(hundredth, bx.box()).alias("ring"))
    schema = "type string, properties struct<det_id: bigint, class_id: int>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    read = features(rows, 4326).select(F.from_json("value", schema).alias("f")).where("f.type = 'Feature' AND f.geometry.type = 'Polygon'")
    points = read.select("f.properties.det_id", "f.properties.class_id", F.posexplode(F.col("f.geometry.coordinates")[0]).alias("i", "p"))
    return points.select("det_id", "class_id", "i", (F.col("p")[0] + 0.0).alias("lon"), (F.col("p")[1] + 0.0).alias("lat"))


@query(
    "bounds_window",
    """SELECT raster_id, CAST(10 AS INT) AS col_off, CAST(20 AS INT) AS row_off, CAST(31 AS INT) AS w, CAST(41 AS INT) AS h FROM scene WHERE b = 0 AND d = 0""",
    ("scene",),
)
def _bounds_window(spark, sf_dir):
    """An area that begins and ends a quarter into pixels takes these whole; rasters that aren't turned."""
    from tilewright.sources.resolve import window_of

    s = _input(spark, sf_dir, "scene").where("b = 0 AND d = 0")
    x, y = (lambda k: F.col("c") + F.col("a") * k), (lambda k: F.col("f") + F.col("e") * k)
    return s.select("raster_id", window_of(_affine(), x(10.25), y(60.25), x(40.25), y(20.25)).alias("w")).select("raster_id", "w.*")


@query(
    "latest_item",
    """SELECT o_orderkey AS id, o_custkey AS provider FROM orders WHERE (o_orderkey * 613) % 340 - 180 <= 5 AND (o_orderkey * 613) % 340 - 160 >= 5
  AND (o_orderkey * 389) % 160 - 85 <= 10 AND (o_orderkey * 389) % 160 - 70 >= 10 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""",
)
def _latest_item(spark, sf_dir):
    from tilewright.sources.resolve import latest_item

    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    x, y = (k * 613) % 340 - 180, (k * 389) % 160 - 85
    items = o.select(k.alias("id"), F.col("o_custkey").alias("provider"), F.array(x, y, x + 20, y + 15).alias("bbox"), F.col("o_orderdate").cast("date").alias("datetime"))
    return latest_item(items, 5, 10, "1993-01-01", "1997-12-31").select("id", "provider")


def _coco_labels_sql() -> str:
    from tilewright.model import COCO_LABELS

    values = ", ".join(f"({i}, '{n}')" for i, n in COCO_LABELS.items())
    return f"SELECT p_partkey, coalesce(name, 'class_' || k) AS label FROM (SELECT p_partkey, p_partkey % 95 AS k FROM part) LEFT JOIN (VALUES {values}) AS t(id, name) ON k = id"


@query("coco_labels", _coco_labels_sql())
def _coco_labels(spark, sf_dir):
    from tilewright.model import class_names

    names = class_names({i: str(i) for i in range(1, 91)} | {0: "class_0"})  # numbers are ids of the dataset; those without a name stay numbers
    known = {i: n for i, n in names.items() if not n.isdigit()}
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", labels.class_label((F.col("p_partkey") % 95).cast("int"), known).alias("label"))


@query(
    "batch_sizes",
    """SELECT variant, device, CAST(CASE device WHEN 'cpu' THEN 1 ELSE greatest(1, least(64, floor(0.7::DOUBLE * free / (resolution * resolution * 96)))) END AS INT) AS batch
FROM (VALUES ('nano', 384), ('small', 512), ('medium', 576), ('base', 560), ('large', 704)) AS v(variant, resolution), (VALUES ('cpu', 8589934592::BIGINT), ('cuda', 268435456::BIGINT), ('cuda:big', 8589934592::BIGINT)) AS d(device, free)""",
)
def _batch_sizes(spark, sf_dir):
    from tilewright.model import VARIANTS, batch_size, variant

    free = {"cpu": 1 << 33, "cuda": 1 << 28, "cuda:big": 1 << 33}
    rows = [(v, d, batch_size(d, n, variant(v)["resolution"])) for v in VARIANTS for d, n in free.items()]
    return spark.createDataFrame(rows, "variant string, device string, batch int")


@query("top_classes", NAMED_SQL + "SELECT class_name, count(*) AS n FROM named GROUP BY class_name ORDER BY n DESC, class_name LIMIT 3", ("det",))
def _top_classes(spark, sf_dir):
    return reports.top_classes(_named(spark, sf_dir), 3)


@query(
    "model_registry",
    """SELECT model_size, CAST(resolution AS INT) AS resolution, CAST(block_size AS INT) AS block_size, CAST(patch_size AS INT) AS patch_size, CAST(num_windows AS INT) AS num_windows, approx_params, license, CAST(300 AS INT) AS num_select
FROM (VALUES ('nano', 384, 32, 16, 2, '15M', 'Apache 2.0'), ('small', 512, 32, 16, 2, '22M', 'Apache 2.0'), ('medium', 576, 32, 16, 2, '25M', 'Apache 2.0'),
  ('base', 560, 56, 14, 4, '29M', 'Apache 2.0'), ('large', 704, 32, 16, 2, '30M', 'Apache 2.0')) AS t(model_size, resolution, block_size, patch_size, num_windows, approx_params, license)""",
)
def _model_registry(spark, sf_dir):
    from tilewright.model import VARIANTS, model_info, num_select

    names = ("model_size", "resolution", "block_size", "patch_size", "num_windows", "approx_params", "license")
    rows = [(*(model_info(v)[n] for n in names), num_select()) for v in VARIANTS]
    return spark.createDataFrame(rows, "model_size string, resolution int, block_size int, patch_size int, num_windows int, approx_params string, license string, num_select int")


@query(
    "scene_limits",
    """WITH px AS (SELECT vec_id % 10 AS raster_id, (i - 1) // 16 AS band, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
SELECT raster_id, CAST(band AS INT) AS band, round(quantile_cont(v, 0.02), 6) AS vmin, round(quantile_cont(v, 0.98), 6) AS vmax FROM px GROUP BY raster_id, band""",
)
def _scene_limits_query(spark, sf_dir):
    from tilewright.plans.detect import derived_scene_tiles, scene_limits

    own = scene_limits(derived_scene_tiles(spark, sf_dir))
    rows = own.select("raster_id", F.posexplode(F.arrays_zip("vmin", "vmax")).alias("band", "l"))
    return rows.select("raster_id", "band", F.round("l.vmin", 6).alias("vmin"), F.round("l.vmax", 6).alias("vmax"))


@query(
    "detect_tiled",
    None,
)
def _detect_tiled(spark, sf_dir):
    """The whole tiled detection over pixels derived from the embeddings, with the stand-in detector."""
    from tilewright.plans.detect import derived_scene_tiles, detect_tiles

    return detect_tiles(derived_scene_tiles(spark, sf_dir), names=NAMES).select("raster_id", "det_id", "class_id", "class_name", "confidence", "centroid_x", "centroid_y", "area")

"""Goldens and round trips of the raster operators."""

import json
import math
import sqlite3
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright import model
from tilewright.errors import BandError, CRSError, ExportError, GSDWarning, MissingCRSError, ModelError, TilewrightError, TilingError
from tilewright.functions import boxes as bx
from tilewright.functions import clip, geo, labels, pixels
from tilewright.operators import augment, grid, nms, reports, spatial, split
from tilewright.plans import training
from tilewright.session import RasterDetector, areas_m2
from tilewright.sources import geotiff, resolve, samples, sinks, vectors

AFFINE = (0.3, 0.0, 500000.0, 0.0, -0.3, 4000000.0)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


def affine_lit(values=AFFINE):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", values)])


# --- boxes ------------------------------------------------------------------


def test_iou_goldens(spark):
    cases = [((0, 0, 10, 10), (0, 0, 10, 10), 1), ((0, 0, 10, 10), (20, 20, 30, 30), 0), ((0, 0, 20, 20), (10, 10, 30, 30), 100 / 700),
             ((0, 0, 100, 100), (25, 25, 75, 75), 0.25), ((0, 0, 10, 10), (10, 0, 20, 10), 0), ((5, 5, 5, 5), (5, 5, 5, 5), 0)]
    got = one(spark, *[bx.iou(lits(*a), lits(*b)) for a, b, _ in cases])
    assert list(got) == pytest.approx([w for *_, w in cases])


def test_quad_and_inverse(spark):
    got = one(spark, bx.quad(affine_lit(), lits(0, 0, 100, 100)), bx.has_rotation(affine_lit()))
    want = [500000, 4000000, 500030, 4000000, 500030, 3999970, 500000, 3999970, 500000, 4000000]
    assert [v for p in got[0] for v in (p["x"], p["y"])] == pytest.approx(want)
    assert not got[1]
    turned = (math.cos(0.5), -math.sin(0.5) * 2, 10, math.sin(0.5), math.cos(0.5) * 2, 20)
    back = one(spark, bx.to_pixel(affine_lit(turned), *(lambda p: (p["x"], p["y"]))(bx.to_geo(affine_lit(turned), F.lit(12.5), F.lit(-3.0)))))[0]
    assert (back["x"], back["y"]) == pytest.approx((12.5, -3.0))
    assert one(spark, bx.to_pixel(affine_lit((1, 2, 0, 2, 4, 0)), F.lit(1.0), F.lit(1.0)))[0]["x"] is None


# --- grids --------------------------------------------------------------------


@pytest.mark.parametrize("w,h,tile,overlap,n", [(100, 100, 50, 0, 4), (128, 128, 64, 0.25, 9), (128, 128, 32, 0, 16), (200, 200, 576, 0.2, 1), (237, 189, 64, 0.15, 20), (0, 5, 10, 0, 0)])
def test_grid_covers(spark, w, h, tile, overlap, n):
    got = grid.tile_grid(spark.createDataFrame([("r", w, h)], "raster_id string, width int, height int"), tile, overlap).orderBy("tile_idx").collect()
    assert len(got) == n and [r.tile_idx for r in got] == list(range(n))
    seen = np.zeros((h, w), bool)
    for r in got:
        seen[r.row_off : r.row_off + r.h, r.col_off : r.col_off + r.w] = True
    assert seen.all()
    if (w, overlap) == (128, 0.25):
        assert (got[1].col_off, got[1].row_off, got[1].w, got[1].h) == (48, 0, 64, 64)


@pytest.mark.parametrize("tile,overlap", [(0, 0.1), (-10, 0.1), (10, 0.5), (10, 0.7), (10, -0.1)])
def test_grid_refuses(tile, overlap):
    with pytest.raises(TilingError):
        grid.check_grid(tile, overlap)


def test_stride_overlap_and_range(spark):
    assert grid.stride(576, 0.2) == 460 and grid.stride(90, 0.3) == 62 and grid.stride(1, 0.49) == 1
    got = one(spark, *[labels.recommended_overlap(F.lit(float(o)), F.lit(float(t))) for o, t in ((1000, 100), (1, 1000), (5, 0), (30, 576))])
    assert list(got) == pytest.approx([0.49, 0.05, 0.2, 0.1736], abs=1e-4)
    r = one(spark, labels.detection_range(F.lit(0.3), F.lit(576.0)))[0]
    assert (r["least"], r["most"]) == pytest.approx((3.0, 138.24))


# --- suppression ------------------------------------------------------------------

DET = "raster_id int, det_id bigint, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def kept(spark, rows, threshold, **options):
    return sorted(r.det_id for r in nms.nms(spark.createDataFrame(rows, DET), threshold, **options).collect())


@pytest.mark.parametrize("strategy", ["grouped", "rounds", "fold", "auto"])
def test_nms_goldens(spark, strategy):
    a, b = (0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 11.0, 11.0)
    assert kept(spark, [(1, 0, 0, 0.9, *a), (1, 1, 0, 0.7, *b)], 0.5, strategy=strategy) == [0]
    assert kept(spark, [(1, 0, 0, 0.9, *a), (1, 1, 1, 0.7, *b)], 0.5, strategy=strategy) == [0, 1]
    assert kept(spark, [(1, i, 0, s, *a) for i, s in enumerate((0.5, 0.9, 0.7))], 0.5, strategy=strategy) == [1]
    far = (6.0, 6.0, 16.0, 16.0)
    assert kept(spark, [(1, 0, 0, 0.9, *a), (1, 1, 0, 0.7, *far)], 0.5, strategy=strategy) == [0, 1]
    assert kept(spark, [(1, 0, 0, 0.9, *a), (1, 1, 0, 0.7, *far)], 0.01, strategy=strategy) == [0]
    assert kept(spark, [], 0.5, strategy=strategy) == []


def test_nms_strategies_agree(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(400):
        x, y = r.uniform(0, 300, 2)
        w, h = r.uniform(20, 90, 2)
        rows.append((int(i % 2), i, int(r.integers(0, 2)), float(round(r.random(), 2)), float(x), float(y), float(x + w), float(y + h)))
    want = kept(spark, rows, 0.3, strategy="grouped")
    assert kept(spark, rows, 0.3, strategy="rounds") == kept(spark, rows, 0.3, strategy="fold") == want
    assert kept(spark, rows, 0.3, max_group=90) == want  # some groups by rounds, some grouped
    filtered = kept(spark, [x for x in rows if x[3] >= 0.4], 0.3)
    assert filtered == [i for i in want if rows[i][3] >= 0.4]


def test_edge_zone(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0, 0, 100, 100), (1, 1, 1.0, 1.0, 11.0, 11.0, -50, -50, 100, 100), (1, 2, 0.0, 90.0, 6.0, 99.0, 0, 0, 100, 100)]
    df = spark.createDataFrame(rows, "raster_id int, det_id int, x1 double, y1 double, x2 double, y2 double, col_off int, row_off int, w int, h int")
    assert sorted(r.det_id for r in nms.edge_zone_filter(df).collect()) == [1, 2]


# --- pixels ------------------------------------------------------------------------


def test_bands():
    assert pixels.band_numbers("sentinel2_rgb") == [4, 3, 2] and pixels.band_numbers([1]) == [1]
    for bad in ("nope", [], [0], [1.5]):
        with pytest.raises(BandError):
            pixels.band_numbers(bad)
    with pytest.warns(RuntimeWarning):
        assert pixels.clamp_bands([1, 2, 5], 3) == [1, 2, 3]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert pixels.clamp_bands([1, 2, 3], 1) == [1, 1, 1]


def test_pixel_expressions(spark):
    bands = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in ((10, 0, 30), (20, 0, 40), (1, 0, 3), (0, 5, 0))])
    read, wanted = F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (4, 2, 1)))
    three = F.slice(bands, 1, 3)
    mask = pixels.nodata_mask(three, F.lit(0.0))
    got = one(
        spark, pixels.select_bands(bands, read, wanted), pixels.alpha_mask(bands, wanted), mask, pixels.nodata_fraction(mask), pixels.fill_nodata(three, mask),
        pixels.nodata_fraction(F.lit(None).cast("array<boolean>")), pixels.select_bands(F.slice(bands, 1, 1), F.array(F.lit(1)), wanted),
        pixels.fill_nodata(three, F.array(*[F.lit(True)] * 3)), pixels.stretch_bands(three, F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(20.0), F.lit(0.0))),
        pixels.to_byte(F.lit(1.5)), pixels.to_byte(F.lit(0.5)), pixels.nodata_mask(three, F.lit(None).cast("double")),
    )
    assert got[0] == [[0, 5, 0], [20, 0, 40], [10, 0, 30]] and got[1] == [True, False, True] and got[2] == [False, True, False]
    assert got[3] == pytest.approx(1 / 3) and got[4] == [[10, 20, 30], [20, 30, 40], [1, 2, 3]] and got[5] == 0.0
    assert got[6] == [[10, 0, 30]] * 3 and got[7] == [[0, 0, 0]] * 3
    assert got[8] == [[0.5, 0, 1], [0, 0, 0], [0, 0, 0]] and got[9] == 255 and got[10] == 127 and got[11] is None


# --- distances and systems -----------------------------------------------------------


def test_gsd(spark):
    a = affine_lit((2.0, 0, 0, 0, -3.0, 0))
    got = one(spark, *[geo.gsd(a, F.lit(u)) for u in ("metre", "foot", "degree", "parsec")])
    assert list(got)[:3] == pytest.approx([2.5, 0.762, 277_500]) and got[3] is None
    for v in (0.03, 0.07, 2.0, 0.7, 10.0):
        with pytest.warns(GSDWarning):
            geo.check_gsd(v)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for v in (0.3, 0.1, 0.5, None):
            geo.check_gsd(v)
    with pytest.raises(TilewrightError):
        geo.check_gsd(10.0, strict=True)


def test_utm(spark):
    zones = one(spark, *[geo.utm_epsg(F.lit(float(x)), F.lit(float(y))) for x, y in ((-122, 37), (15, -34), (-0.1, 51.5), (180, 10))])
    assert list(zones) == [32610, 32733, 32630, 32660]
    # the central meridian at the equator, and a place known to the millimetre: 6 degrees east on the equator of zone 31's edge
    p = one(spark, geo.to_utm(F.lit(3.0), F.lit(0.0), F.lit(32631)), geo.to_utm(F.lit(3.0), F.lit(0.0), F.lit(32731)))
    assert (p[0]["x"], p[0]["y"], p[1]["y"]) == pytest.approx((500000, 0, 10_000_000))
    # meridian arc from the equator to 45 degrees on WGS 84 is 4984944.378 m
    north = one(spark, geo.to_utm(F.lit(3.0), F.lit(45.0), F.lit(32631)))[0]
    assert north["y"] == pytest.approx(4984944.378 * 0.9996, abs=2e-3)
    for lon, lat, epsg in ((-121.9, 37.33, 32610), (15.2, -34.1, 32733), (5.9, 70.0, 32631)):
        back = one(spark, (lambda q: geo.from_utm(q["x"], q["y"], F.lit(epsg)))(geo.to_utm(F.lit(lon), F.lit(lat), F.lit(epsg))))[0]
        assert (back["x"], back["y"]) == pytest.approx((lon, lat), abs=1e-9)
    web = one(spark, geo.from_degrees(F.lit(180.0), F.lit(0.0), 3857))[0]
    assert (web["x"], web["y"]) == pytest.approx((20037508.342789244, 0), abs=1e-6)
    with pytest.raises(CRSError):
        geo.parse_epsg("somewhere")
    with pytest.raises(CRSError):
        geo.to_degrees(F.lit(1.0), F.lit(1.0), 2154)


def ring_df(spark, points):
    return spark.createDataFrame([(1, points)], "det_id bigint, ring array<struct<x:double,y:double>>")


def box_ring(x1, y1, x2, y2):
    return [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]


def test_areas(spark):
    assert areas_m2(ring_df(spark, box_ring(500000, 4000000, 500100, 4000100)), 32617).first().area_m2 == pytest.approx(10000)
    assert areas_m2(ring_df(spark, box_ring(0, 0, 10, 10)), None).first().area_m2 == 100
    small = areas_m2(ring_df(spark, box_ring(-122.4, 37.7, -122.399, 37.701)), 4326).first().area_m2
    assert small == pytest.approx(111.0e3 * 0.001 * 88.2e3 * 0.001, rel=0.01)


# --- labels, reports, splits ------------------------------------------------------------


def test_labels_and_colours(spark):
    got = one(spark, labels.class_label(F.lit(99), {1: "a"}), labels.class_label(F.lit(1), {1: "a"}), labels.class_label(F.lit(3), None),
              labels.hex_colour(F.lit(1.0), F.lit(0.0), F.lit(0.0)), labels.palette_colour(F.lit(20)))
    assert list(got) == ["class_99", "a", "class_3", "#ff0000", "#1f77b4"]


def test_change_report(spark):
    before = spark.createDataFrame([("a",), ("a",), ("b",)], "class_name string")
    after = spark.createDataFrame([("a",), ("c",)], "class_name string")
    got = {r.class_name: (r.change, r.pct) for r in reports.change_report(before, after).collect()}
    assert got == {"a": (-1, "-50.0%"), "b": (-1, "-100.0%"), "c": (1, "new")}


def test_block_split_golden(spark):
    r = spark.createDataFrame([("r", 1000, 1000, {"w": 1})], "raster_id string, width int, height int, m map<string,int>")
    tiles = grid.tile_grid(r, 100, 0.0).crossJoin(r.select("width", "height"))
    count = lambda **o: {x["split"]: x["count"] for x in split.block_split(tiles, 100, order="parity", **o).groupBy("split").count().collect()}
    assert count() == {"train": 76, "val": 16, "test": 8}
    assert count(buffer=1) == {"train": 65, "val": 6, "test": 3, "buffer": 26}
    done = split.block_split(tiles, 100, buffer=1).where("split != 'buffer'").select("gx", "gy", "split").collect()
    assert not any(abs(a.gx - b.gx) <= 1 and abs(a.gy - b.gy) <= 1 and a.split != b.split for a in done for b in done)


def test_nms_regions(spark):
    rng = np.random.default_rng(5)
    at, by = rng.integers(0, 700, (900, 2)), rng.integers(20, 130, (900, 2))
    rows = [(1, i, i % 2, float(rng.integers(0, 9)), *map(float, at[i]), *map(float, at[i] + by[i])) for i in range(900)]
    rows += [(1, 900 + i, 0, 5.0, 10.0, 10.0, 10.0, 60.0) for i in range(2)]  # without an area: both stay
    for threshold in (0.01, 0.3, 0.7):
        want = kept(spark, rows, threshold, strategy="grouped")
        assert kept(spark, rows, threshold, strategy="regions") == kept(spark, rows, threshold, max_group=90) == want
    d = spark.createDataFrame([(r[1], 0, *r[3:]) for r in rows], "det_id long, k int, confidence double, x1 double, y1 double, x2 double, y2 double")
    for size in (50.0, 200.0):  # most boxes are in several regions
        got = nms._regions(d, 0.05, ["k"], "confidence", "det_id", size)
        assert sorted(r.det_id for r in got.collect()) == sorted(r.det_id for r in nms.nms(d, 0.05, ["k"], strategy="grouped").collect())


def test_nms_of_large_groups_writes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(nms, "overlaps", lambda *_: pytest.fail("pairs grow with the square of a group"))
    d = spark.range(3000).selectExpr("id AS det_id", "0 AS k", "id / 3000 AS confidence", "0D AS x1", "0D AS y1", "10D AS x2", "10D AS y2")
    assert [r.det_id for r in nms.nms(d, 0.01, ["k"], max_group=1000).collect()] == [2999]


def _many_tiles(spark):
    """Tiles whose number a plan can't tell beforehand: its estimate is that of the few rows they are exploded from."""
    r = spark.range(60).repartition(3).selectExpr("id AS raster_id", "CAST(300 + id % 7 * 50 AS INT) AS width", "CAST(300 + id % 5 * 50 AS INT) AS height")
    return grid.tile_grid(r.withColumn("size", F.struct("width", "height")), 32, 0.0, keep=("raster_id", "size")).select("*", "size.width", "size.height").drop("size")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_split_takes_no_broadcast(spark):
    plan = _plan(split.block_split(_many_tiles(spark), 32))
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_split_buffer_takes_no_broadcast(spark):
    tiles = _many_tiles(spark)
    plan = _plan(split.block_split(tiles, 32, buffer=2))
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    plain = {(x.raster_id, x.tile_idx): x for x in split.block_split(tiles, 32).collect()}
    cells = {(x.raster_id, x.gx, x.gy): x.split for x in plain.values()}
    around = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
    for x in split.block_split(tiles, 32, buffer=2).collect():
        own = plain[x.raster_id, x.tile_idx].split
        close = any(cells.get((x.raster_id, x.gx + dx, x.gy + dy), own) != own for dx, dy in around)
        assert x.split == ("buffer" if close else own)


def test_split_stats_takes_no_broadcast(spark):
    plan = _plan(split.block_split(_many_tiles(spark), 32).groupBy("split").agg(F.count("*"), F.count_distinct("raster_id")))
    assert "Broadcast" not in plan and "Join" not in plan


def test_random_split_and_checks(spark):
    tiles = spark.range(100).selectExpr("'r' AS raster_id", "CAST(id AS INT) AS tile_idx")
    with pytest.warns(UserWarning):
        got = {x["split"]: x["count"] for x in split.random_split(tiles).groupBy("split").count().collect()}
    assert got == {"train": 80, "val": 15, "test": 5}
    for method, ratios in (("block", (0.5, 0.2, 0.2)), ("nope", (0.8, 0.15, 0.05)), ("block", (1.2, -0.1, -0.1)), ("random", (0.5, 0.5))):
        with pytest.raises(ValueError):
            split.check_split(method, ratios)


def test_turns(spark):
    w, h = F.lit(20.0), F.lit(10.0)
    sides = lits(2, 3, 4, 5)
    for k in range(4):
        x, y, bw, bh, W, H = 2.0, 3.0, 4.0, 5.0, 20.0, 10.0
        for _ in range(k):
            x, y, bw, bh, W, H = H - y - bh, x, bh, bw, H, W
        assert list(one(spark, *augment.turned(sides, w, h, F.lit(k)))) == [x, y, bw, bh, W, H]


# --- models -----------------------------------------------------------------------------


def test_registry_and_checks(spark):
    assert {r.variant: (r.resolution, r.block_size) for r in model.registry(spark).collect()} == {
        "nano": (384, 32), "small": (512, 32), "medium": (576, 32), "base": (560, 56), "large": (704, 32)}
    for bad in ("xlarge", "2xlarge", "giant"):
        with pytest.raises(ModelError):
            model.variant(bad)
    assert len(model.COCO_LABELS) == 80 and model.COCO_LABELS[90] == "toothbrush" and model.COCO_LABELS[13] == "stop sign"
    assert model.class_names({0: "3", 1: "999", 2: "tree"}) == {0: "car", 1: "999", 2: "tree"}
    assert model.normalise(None) == [] and model.normalise((np.zeros((0, 4)), [], [])) == []
    model.check_tile(np.ones((3, 64, 64), np.float32))
    with pytest.raises(ModelError):
        model.check_tile(np.full((3, 64, 64), 1.0001, np.float32))
    for shape in ((4, 64, 64), (64, 64)):
        with pytest.raises(BandError):
            model.check_tile(np.zeros(shape, np.uint8))
    with pytest.warns(UserWarning):
        model.check_tile(np.zeros((257, 257, 3), np.uint8))
    with pytest.warns(UserWarning):
        assert model.device("cuda") == "cpu"
    assert model.device(None, ("mps", "cpu")) == "mps" and model.batch_size("cuda", 10**12, 576) == 64 and model.batch_size("cpu", 1, 1) == 1
    assert model.valid_tile_sizes(56)[0] == 168


# --- files -------------------------------------------------------------------------------


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("tile", [None, 32])
def test_geotiff_round_trip(tmp_path, dtype, tile):
    data = (np.random.default_rng(1).random((3, 70, 53)) * 200).astype(dtype)
    path = str(tmp_path / "r.tif")
    geotiff.write_geotiff(path, data, AFFINE, 32617, nodata=0, tile=tile, rows_per_strip=16)
    with open(path, "rb") as f:
        t = geotiff.GeoTiff(f)
        assert (t.width, t.height, t.bands, t.epsg, t.nodata) == (53, 70, 3, 32617, 0.0) and t.affine == pytest.approx(AFFINE) and t.dtype.name == dtype
        got, mask = t.window(0, 0, 53, 70)
        assert (got == data).all() and (mask == (data == 0).all(0)).all()
        part, mask = t.window(-5, 60, 20, 20, [2])
        want = np.zeros((20, 20), dtype)
        want[:10, 5:] = data[1, 60:, :15]
        assert (part[0] == want).all() and mask[:, :5].all()
        with pytest.raises(BandError):
            t.window(0, 0, 1, 1, [4])


def scene(path, epsg=32617, size=128, alpha=False):
    data = np.full((4 if alpha else 3, size, size), 40, np.uint8)
    data[:, 20:40, 30:60] = 250
    data[:, 90:100, 80:110] = 240
    geotiff.write_geotiff(str(path), data, AFFINE, epsg, alpha=alpha)
    return data


def test_reading_with_spark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = scene(tmp_path / "in" / "a.tif")
    scene(tmp_path / "in" / "b.TIFF", None, 64, alpha=True)
    meta = {r.raster_id: r for r in geotiff.read_metadata(spark, str(tmp_path / "in")).collect()}
    assert meta["a.tif"].epsg == 32617 and meta["a.tif"].gsd_m == pytest.approx(0.3) and meta["b.TIFF"].has_alpha and meta["b.TIFF"].epsg is None
    assert [r.path.rsplit("/", 1)[1] for r in geotiff.raster_files(spark, str(tmp_path / "in")).collect()] == ["a.tif", "b.TIFF"]
    tiles = geotiff.read_tiles(spark, str(tmp_path / "in" / "a.tif"), 64, 0.25).orderBy("tile_idx").collect()
    spark.dataSource.register(geotiff.GeoTiffSource)
    again = spark.read.format("geotiff").option("path", str(tmp_path / "in" / "a.tif")).option("tile", 64).option("overlap", 0.25).load().orderBy("tile_idx").collect()
    assert tiles == again and len(tiles) == 9
    t = tiles[4]
    assert (np.array(t.bands).reshape(3, t.h, t.w) == data[:, t.row_off : t.row_off + t.h, t.col_off : t.col_off + t.w]).all()
    vmin, vmax = geotiff.sample_limits(geotiff.GeoTiff(open(tmp_path / "in" / "a.tif", "rb")))
    assert len(vmin) == 3 and all(0 <= a < b <= 255 for a, b in zip(vmin, vmax))


def test_facade(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    scene(path)
    d = RasterDetector(spark, names={1: "x", 2: "y", 3: "z"})
    with pytest.raises(ExportError):
        d.to_geojson(str(tmp_path / "no.json"))
    found = d.set_image(path).detect_tiled(tile=64, overlap=0.25, threshold=0.9)
    rows = found.collect()
    assert rows and found.columns[:5] == ["raster_id", "det_id", "class_id", "class_name", "confidence"]
    assert all(r.confidence >= 0.9 and r.epsg == 32617 and 500000 <= r.centroid_x <= 500000 + 128 * 0.3 for r in rows)
    with pytest.warns(RuntimeWarning):
        d.to_geojson(str(tmp_path / "o.geojson"))
    doc = json.load(open(tmp_path / "o.geojson"))
    assert len(doc["features"]) == len(rows) and -81.01 < doc["features"][0]["geometry"]["coordinates"][0][0][0] < -80.99
    d.to_geopackage(str(tmp_path / "o.gpkg"), "first")
    d.to_geopackage(str(tmp_path / "o.gpkg"), "second", append=True)
    assert {r[0] for r in sqlite3.connect(tmp_path / "o.gpkg").execute("SELECT table_name FROM gpkg_contents")} == {"first", "second"}
    with pytest.warns(RuntimeWarning):
        d.to_shapefile(str(tmp_path / "o.shp"))
    for name in ("o.gpkg", "o.shp", "o.geojson"):
        back = vectors.read_vectors(spark, str(tmp_path / name)).collect()
        assert len(back) == len(rows) and all(len(r.rings[0]) == 5 for r in back) and {r.class_id for r in back} == {r.class_id for r in rows}
    assert d.show(max_detections=10_000).count() == len(rows)
    with pytest.warns(RuntimeWarning):
        assert d.show(max_detections=1).count() == 1
    assert d.detect(threshold=0.9, classes=["x"]).where("class_name != 'x'").count() == 0
    scene(tmp_path / "n.tif", None)
    with pytest.raises(MissingCRSError):
        d.set_image(str(tmp_path / "n.tif"))
    assert "ring" not in d.set_image(str(tmp_path / "n.tif"), georeferenced=False).detect(threshold=0.9).columns
    d.crs = "EPSG:32617"
    assert "ring" in d.detect(threshold=0.9).columns
    with pytest.raises(CRSError):
        d.crs = 3.5


def test_single_band_and_presets(spark, tmp_path):
    geotiff.write_geotiff(str(tmp_path / "one.tif"), np.random.default_rng(0).integers(0, 255, (1, 64, 64)).astype(np.uint8), AFFINE, 32617)
    geotiff.write_geotiff(str(tmp_path / "six.tif"), np.random.default_rng(0).integers(0, 255, (6, 64, 64)).astype(np.uint16), AFFINE, 32617)
    d = RasterDetector(spark)
    assert d.set_image(str(tmp_path / "one.tif")).detect_tiled(32, 0.0).count() > 0
    assert d.set_image(str(tmp_path / "six.tif"), "sentinel2_rgb").detect_tiled(32, 0.0).count() > 0


def test_coco_and_yolo(spark, tmp_path):
    rows = [(1, 5, 0.0, 0.0, 100.0, 100.0, "a"), (2, 7, None, None, None, None, "b"), (3, 5, 10.0, 20.0, 400.0, 60.0, "a")]
    df = spark.createDataFrame(rows, "det_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double, class_name string")
    sinks.to_coco(df, str(tmp_path / "c.json"), 200, 200, "x/y.png")
    images, anns, cats = vectors.read_coco(spark, str(tmp_path / "c.json"))
    assert [r.id for r in anns.orderBy("id").collect()] == [0, 2] and anns.orderBy("id").first().bbox == [0, 0, 100, 100]
    assert [(r.id, r.name) for r in cats.collect()] == [(5, "a"), (7, "b")] and images.first().file_name == "y.png"
    sinks.to_yolo(df, str(tmp_path / "y"), 200, 200)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "y")).collect()) == ["5 0.250000 0.250000 0.500000 0.500000", "5 1.000000 0.200000 1.000000 0.200000"]
    sinks.to_yolo(df, str(tmp_path / "z"), None, None)
    assert spark.read.text(str(tmp_path / "z")).count() == 0
    with pytest.raises(ExportError):
        sinks.to_coco(df.limit(0), str(tmp_path / "e.json"))


class Item:
    id = "i"

    def __init__(self, **assets):
        self.assets = {k: {"href": h, "media_type": m} for k, (h, m) in assets.items()}


def test_resolve(tmp_path):
    assert resolve.resolve("s3://b/k.tif") == "s3://b/k.tif"
    with pytest.raises(FileNotFoundError):
        resolve.resolve(str(tmp_path / "no.tif"))
    with pytest.raises(TilewrightError):
        resolve.resolve(3)
    assert resolve.resolve(Item(visual=("v", "image/png"), data=("d", ""), extra=("e", "image/tiff"))) == "d"
    assert resolve.resolve(Item(thumb=("t.tif", "x"))) == "t.tif"
    with pytest.raises(TilewrightError):
        resolve.resolve(Item(thumb=("t.png", "image/png")))


def test_sample_cache(spark, tmp_path):
    calls = []

    def fetch(url, path):
        calls.append(url)
        open(path, "wb").write(b"data")

    asset = {"url": "u", "filename": "f.bin", "sha256": "PLACEHOLDER"}
    path = samples.download_sample(asset, str(tmp_path / "c"), fetch=fetch)
    samples.download_sample(asset, str(tmp_path / "c"), fetch=fetch)
    assert calls == ["u"] and samples.digests(spark, path).first().sha256 == samples.sha256(path)
    samples.download_sample(asset, str(tmp_path / "c"), force=True, fetch=fetch)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        samples.download_sample(asset | {"sha256": "00"}, str(tmp_path / "c"), fetch=fetch)
    import os

    assert not os.path.exists(path)


# --- training sets --------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(1, 20)), min_size=3, max_size=9), st.integers(-15, 10), st.integers(1, 15))
def test_clip_keeps_area(profile, left, width):
    """A comb over the x axis: clipping between two x limits keeps the area between them."""
    xs = sorted({x for x, _ in profile})
    if len(xs) < 2:
        return
    tops = {x: y for x, y in profile}
    ring = [(float(x), 0.0) for x in (xs[0], xs[-1])] + [(float(x), float(tops[x])) for x in reversed(xs)]
    x1, x2 = float(left), float(left + width)
    top = lambda x: float(np.interp(x, xs, [tops[v] for v in xs]))
    lo, hi = max(x1, xs[0]), min(x2, xs[-1])
    knots = sorted({lo, hi, *[float(v) for v in xs if lo < v < hi]}) if lo < hi else []
    want = sum((b - a) * (top(a) + top(b)) / 2 for a, b in zip(knots, knots[1:]))
    assert sum(map(clip.ring_area, clip.clip_ring(ring, (x1, -1.0, x2, 50.0)))) == pytest.approx(want, abs=1e-6)


def test_clip_keeps_pieces_apart():
    u = [(0, 0), (30, 0), (30, 20), (20, 20), (20, 5), (10, 5), (10, 20), (0, 20)]
    pieces = clip.clip_ring([(float(x), float(y)) for x, y in u], (-5.0, 10.0, 50.0, 50.0))
    assert sorted(map(clip.ring_area, pieces)) == [100, 100]
    assert clip.clip_ring([(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)], (5.0, 0.0, 9.0, 9.0)) == []


def test_training_set(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    scene(path, size=256)
    rasters = geotiff.read_metadata(spark, path)
    features = []
    for k, (x, y, s) in enumerate(((20, 20, 30), (100, 100, 50), (200, 30, 20), (60, 200, 40), (130, 10, 3))):
        c = [[500000 + 0.3 * px, 4000000 - 0.3 * py] for px, py in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
        features.append({"type": "Feature", "properties": {"class_name": "ab"[k % 2]}, "geometry": {"type": "Polygon", "coordinates": [c]}})
    json.dump({"type": "FeatureCollection", "features": features}, open(tmp_path / "ann.geojson", "w"))
    ann = training.align(vectors.read_geojson(spark, str(tmp_path / "ann.geojson")), 32617, 32617)
    own = training.to_pixels(spatial.map_classes(ann), rasters)
    tiles = grid.tile_grid(rasters.select("raster_id", "width", "height", "affine"), 64, 0.0).join(rasters.select("raster_id", "width", "height"), "raster_id")
    stay, boxes = training.plan_dataset(tiles, own, 64, max_background=0.5, min_area=16.0)
    n = stay.groupBy("annotated").count().collect()
    counts = {r.annotated: r["count"] for r in n}
    assert counts[False] <= counts[True] * 0.5 and boxes.where("bw * bh < 16").count() == 0
    images, anns = training.number(stay, boxes)
    assert sorted(r.id for r in anns.collect()) == list(range(anns.count()))
    pngs = training.images_of(geotiff.read_tiles(spark, path, 64, 0.0))
    stats = training.write_dataset(images, anns, {"a": 0, "b": 1}, str(tmp_path / "set"), pngs)
    assert sum(stats[f"{s}_tiles"] for s in ("train", "val", "test")) == stay.count()
    doc = json.load(open(tmp_path / "set" / "train" / "_annotations.coco.json"))
    assert len(doc["annotations"]) == stats["train_annotations"] and (tmp_path / "set" / "train" / doc["images"][0]["file_name"]).read_bytes()[:4] == b"\x89PNG"
    with pytest.raises(CRSError):
        training.align(ann, 4326, None)
    with pytest.warns(UserWarning):
        training.align(ann, 4326, 32617)


def test_train_hook():
    seen = {}
    assert training.train(lambda **o: seen.update(o) or {"map": 1}, learning_rate=0.5, resume="r") == {"map": 1} and seen == {"lr": 0.5, "resume": "r"}
    assert training.train(lambda **o: None) == {}
    with pytest.raises(ModelError):
        training.train(lambda **o: 1 / 0)
    with pytest.raises(ModelError):
        training.train(lambda **o: {}, boxes=object(), preset="nope")


def test_stream(spark, tmp_path):
    from tilewright.streaming.rasters import detect_stream

    (tmp_path / "in").mkdir()
    scene(tmp_path / "in" / "a.tif")
    run = lambda: detect_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 64, 0.25, threshold=0.9).awaitTermination(60)
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    scene(tmp_path / "in" / "b.tif")
    run()
    assert first > 0 and spark.read.parquet(str(tmp_path / "out")).groupBy("raster_id").count().count() == 2


def test_errors_keep_context():
    assert issubclass(MissingCRSError, CRSError) and TilewrightError("x", a=1).context == {"a": 1}


def test_pixels_turn_with_boxes(spark):
    cube = np.zeros((3, 6, 10), np.float32)
    cube[:, 1:3, 2:5] = 200
    tiles = spark.createDataFrame([(i, 6, 10, [b.ravel().tolist() for b in cube]) for i in range(6)], "image_id int, h int, w int, bands array<array<float>>")
    boxes = spark.createDataFrame([(i, i, 2.0, 1.0, 3.0, 2.0, 10.0, 6.0) for i in range(6)], "image_id int, ann_id int, bx double, by double, bw double, bh double, w double, h double")
    preset = augment.AUGMENTATION_PRESETS["satellite_default"]
    placed = {(r.image_id, r.copy): r for r in augment.augment(boxes, preset, 3).collect()}
    for r in augment.augment_pixels(tiles, augment.augment(boxes, preset, 3), preset).collect():
        own, b = np.array(r.bands).reshape(3, r.h, r.w), placed[r.image_id, r.copy]
        bright = own.mean(0) > own.mean(0).max() / 2
        ys, xs = np.nonzero(bright)
        assert (xs.min(), ys.min(), xs.max() + 1 - xs.min(), ys.max() + 1 - ys.min()) == (b.bx, b.by, b.bw, b.bh) and (r.w, r.h) == (b.w, b.h)


def test_reports_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "class_name string, confidence double")
    sinks.to_csv(reports.threshold_sweep(df, [0.1, 0.6]), str(tmp_path / "s.csv"))
    assert open(tmp_path / "s.csv").read().splitlines()[0] == "threshold,detections,mean_confidence,unique_classes"
    sinks.to_summary(df, str(tmp_path / "s.json"), source="x")
    assert json.load(open(tmp_path / "s.json"))["by_class"] == {"a": 1, "b": 1}


def test_detect_tiled_against_brute_force(spark, sf_dir):
    """The whole plan over the derived rasters, tile by tile in numpy; the model is called once for each tile."""
    import pandas as pd
    import xxhash

    from tilewright.catalogue import NAMES, QUERIES
    from tilewright.plans.detect import derived_scene_tiles

    tiles = derived_scene_tiles(spark, sf_dir).toPandas()
    limits = {}
    for raster, own in tiles.groupby("raster_id"):
        cube = np.stack([np.stack([np.asarray(b, float) for b in bands]) for bands in own["bands"]])
        limits[raster] = np.percentile(cube[:, :3].transpose(1, 0, 2).reshape(3, -1), (2, 98), axis=1)
    rows = []
    for t in tiles.itertuples():
        low, high = limits[t.raster_id]
        cube = np.stack([np.asarray(b, float) for b in t.bands])[:3]
        cube = np.clip((cube - low[:, None]) / (high - low)[:, None], 0, 1).astype(np.float32).reshape(3, 4, 4)
        (found,) = model.BrightBlocks().predict([(cube * 255).astype(np.uint8).transpose(1, 2, 0)], 0.5)
        for i, (b, c, k) in enumerate(zip(*found)):
            h = 42
            for part in (int(t.raster_id).to_bytes(8, "little"), int(t.tile_idx).to_bytes(4, "little"), i.to_bytes(4, "little")):
                h = xxhash.xxh64_intdigest(part, seed=h)
            x1, y1, x2, y2 = b + [t.col_off, t.row_off] * 2
            rows.append((t.raster_id, h - (1 << 64) * (h >> 63), int(k), c, x1, y1, x2, y2))
    want = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        def iou(o):
            w, h = min(r[6], o[6]) - max(r[4], o[4]), min(r[7], o[7]) - max(r[5], o[5])
            both = max(0, w) * max(0, h)
            return both / ((r[6] - r[4]) * (r[7] - r[5]) + (o[6] - o[4]) * (o[7] - o[5]) - both)

        if all(o[0] != r[0] or o[2] != r[2] or iou(o) <= 0.5 for o in want):
            want.append(r)
    got = QUERIES["detect_tiled"](spark, sf_dir).toPandas()
    assert len(rows) > len(want) > 50 and got["det_id"].is_unique
    frame = pd.DataFrame(want, columns=["raster_id", "det_id", "class_id", "confidence", "x1", "y1", "x2", "y2"]).sort_values("det_id")
    got = got.sort_values("det_id")
    assert got["det_id"].tolist() == frame["det_id"].tolist()
    assert got["class_id"].tolist() == frame["class_id"].tolist() and got["class_name"].tolist() == [NAMES[k] for k in frame["class_id"]]
    np.testing.assert_allclose(got["confidence"], frame["confidence"])
    np.testing.assert_allclose(got["centroid_x"], 500000 + 0.3 * (frame["x1"] + frame["x2"]) / 2)
    np.testing.assert_allclose(got["area"], 0.09 * (frame["x2"] - frame["x1"]) * (frame["y2"] - frame["y1"]))


class CountingDetector(model.BrightBlocks):
    calls = None

    def predict(self, tiles, threshold):
        CountingDetector.calls.add(len(tiles))
        return super().predict(tiles, threshold)


def test_the_model_runs_once_for_each_tile(spark, sf_dir):
    from tilewright.plans.detect import derived_scene_tiles, detect_tiles

    calls = spark.sparkContext.accumulator(0)

    def make():
        CountingDetector.calls = calls
        return CountingDetector()

    tiles = derived_scene_tiles(spark, sf_dir)
    detect_tiles(tiles, make, names={1: "a"}, classes=["a", "class_2"]).collect()
    assert calls.value == tiles.count()


def test_class_filter_by_given_names_only(spark, sf_dir):
    from tilewright.plans.detect import derived_scene_tiles, detect_tiles

    tiles = derived_scene_tiles(spark, sf_dir)
    ids = lambda **o: {r[0] for r in detect_tiles(tiles, names={1: "a"}, classes=["a", "class_2"], **o).select("class_id").distinct().collect()}
    assert ids() == {1} and ids(fallback_names=True) == {1, 2}


def test_numbers_follow_the_order(spark):
    from tilewright.operators.numbering import numbered

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 3 AS z").repartition(7)
    assert [r.n for r in numbered(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    assert numbered(df.limit(0), ["k"], "n").collect() == []


def test_a_bad_file_is_a_row(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"not a raster")
    (got,) = geotiff.unreadable(spark, str(tmp_path)).collect()
    assert got.path.endswith("bad.tif") and got.detections == -1 and got.error


def test_models_that_can_prepare_themselves():
    class Able:
        num_select = 77

        def optimize_for_inference(self, batch_size):
            self.batch = batch_size

    own = Able()
    assert model.optimised(own, 4) and own.batch == 4 and model.num_select(own) == 77
    assert not model.optimised(object()) and model.num_select() == 300
    model.unoptimised(own)


def test_no_temporary_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from tilewright.plans.state import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))

import json
import math

import numpy as np
import pandas as pd
import pytest
from gridloom import NODATA, Pipeline, run
from gridloom.__main__ import main
from gridloom.functions import crs, quantise
from gridloom.operators.raster import densify, north_up, reproject_nearest
from gridloom.sources.points import exact_sample, finite, read_table
from gridloom.sources.sinks import read_geotiff, write_geotiff, write_raster
from gridloom.spec import GridSpec
from pyspark.sql import functions as F


@pytest.fixture
def csv(tmp_path):
    r = np.random.default_rng(42)
    p = tmp_path / "points.csv"
    pd.DataFrame({"lon": 144.5 + r.uniform(-0.5, 0.5, 500), "lat": -37.5 + r.uniform(-0.5, 0.5, 500), "val": r.uniform(10, 100, 500)}).to_csv(p, index=False)
    return str(p)


COLS = {"value_col": "val", "lng_col": "lon", "lat_col": "lat"}


def test_empty_input(spark, tmp_path):
    p = tmp_path / "none.csv"
    p.write_text("value,longitude,latitude\n")
    with pytest.raises(ValueError, match="No valid points"):
        Pipeline(spark, str(p), out=str(tmp_path)).run()


def test_scale_overflow(spark):
    with pytest.raises(ValueError, match="exceeds int16 max"):
        Pipeline(spark, "x.csv", scale=400)


def test_halo_beyond_block(spark, tmp_path):
    p = tmp_path / "one.csv"
    p.write_text("value,longitude,latitude\n1.0,0.0,0.0\n")
    with pytest.raises(ValueError, match="halo .* exceeds block size"):
        run(spark, str(p), out=str(tmp_path), cap_km=1.0, block=1, res=500, skip_calibration=True)


def test_blocks_and_whole_grid_agree(spark, csv, tmp_path):
    got = []
    for block in (64, 100_00):
        path = run(spark, csv, out=str(tmp_path / str(block)), res=500, cap_km=10, block=block, skip_calibration=True, **COLS)
        got.append(spark.read.parquet(path).orderBy("row", "col").toPandas())
    assert len(got[0]) > 1000 and got[0].equals(got[1])
    assert got[0].value_dn.between(0, 10000).all()


def test_coverage_is_stable_across_resolutions(spark, csv, tmp_path):
    area = []
    for res in (500, 2000):
        p = Pipeline(spark, csv, out=str(tmp_path), res=res, cap_km=10, skip_calibration=True, out_crs=6933, **COLS)
        p.ingest()
        p.calibrate()
        spec = p.grid()
        area.append(p.raster().count() / (spec.nx * spec.ny))
    assert abs(area[0] - area[1]) < 0.03


def test_points_fall_on_their_pixels(spark, tmp_path):
    r = np.random.default_rng(0)
    lon, lat = 144.9631 + r.uniform(-0.005, 0.005, 100), -37.8136 + r.uniform(-0.005, 0.005, 100)
    src = tmp_path / "c.parquet"
    pd.DataFrame({"lon": lon, "lat": lat, "val": np.arange(100.0)}).to_parquet(src)
    path = run(spark, str(src), out=str(tmp_path / "o"), res=100, cap_km=5, skip_calibration=True, **COLS)
    about = json.loads((tmp_path / "o/raster.json").read_text())
    pixels = {(x.row, x.col) for x in spark.read.parquet(path).select("row", "col").collect()}
    x, y = 6378137 * np.radians(lon), 6378137 * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    hit = [(int((about["top"] - b) // about["pixel"]), int((a - about["left"]) // about["pixel"])) in pixels for a, b in zip(x, y, strict=True)]
    assert np.mean(hit) == 1 and about["crs"] == "EPSG:3857" and about["units"] == "percentile"


def test_calibration_is_written_reused_and_overridden(spark, csv, tmp_path):
    f = str(tmp_path / "cal.json")
    opts = {"blocks_km": (10.0, 20.0), "levels": 4, "n_boot": 10, "min_n": 20}
    p = Pipeline(spark, csv, out=str(tmp_path), res=2000, calibration=f, calibration_options=opts, **COLS)
    p.ingest()
    doc = p.calibrate()
    assert len(doc["percentile_quantiles"]) == 1001 and set(doc["cv"]) == {"10.0", "20.0"} and doc["cap_km"] == p.cap
    json.loads((tmp_path / "cal.json").read_text(), parse_constant=lambda c: pytest.fail(f"{c} is no JSON"))
    other = "log10" if doc["transform"] != "log10" else "sqrt"
    q = Pipeline(spark, csv, out=str(tmp_path), res=2000, calibration=f, transform=other, cap_km=3, skip_calibration=True, **COLS)
    q.ingest()
    assert q.calibrate()["transform"] == doc["transform"] and q.cap == 3 and q.tf.name == other
    q.grid()
    assert q.raster().count() > 0


def test_percentile_without_calibration(spark, csv, tmp_path):
    path = run(spark, csv, out=str(tmp_path), res=2000, cap_km=10, transform="percentile", skip_calibration=True, **COLS)
    assert spark.read.parquet(path).where("value_dn not between 0 and 10000").count() == 0


def test_transform_that_does_not_apply(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("value,longitude,latitude\n-1.0,0.0,0.0\n2.0,0.1,0.1\n")
    with pytest.raises(ValueError, match="does not apply"):
        run(spark, str(p), out=str(tmp_path), transform="log10", cap_km=1, skip_calibration=True)


def test_no_calibration_takes_the_fixed_cap(spark, csv, tmp_path):
    p = Pipeline(spark, csv, out=str(tmp_path), skip_calibration=True, **COLS)
    p.ingest()
    p.calibrate()
    assert p.cap == 64 and p.tf.name == "identity"


def test_command_line(spark, csv, tmp_path, capsys):
    path = main([csv, "--out", str(tmp_path), "--res", "2000", "--cap-km", "8", "--skip-calibration", "--value-col", "val", "--lng-col", "lon", "--lat-col", "lat", "--out-crs", "6933", "--scale", "12.5"])
    assert json.loads((tmp_path / "raster.json").read_text())["scale"] == 12.5
    assert path in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([csv, "--res", "0"])
    with pytest.raises(SystemExit):
        main(["--version"])


def test_reading_casts_and_raises(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("value,longitude,latitude\nx,0,0\n")
    with pytest.raises(Exception, match="CAST|cast"):
        read_table(spark, str(p)).collect()


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),), (float("-inf"),)], "v double")
    assert [r.v for r in finite(df, "v").collect()] == [1.0]


def test_equal_area_half_width_and_round_trips(spark):
    df = spark.createDataFrame([(180.0, 0.0), (-71.3, 42.5), (10.0, -65.0), (0.0, 89.0)], "lon double, lat double")
    for code in (6933, 3857):
        x, y = crs.project(F.col("lon"), F.col("lat"), 4326, code)
        there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        a, b = crs.project(F.col("x"), F.col("y"), code, 4326)
        for r in there.select("lon", "lat", "x", a.alias("a"), b.alias("b")).collect():
            assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-6
            if code == 6933 and r.lon == 180:
                assert abs(r.x - 17367530.445) < 1e-2
    with pytest.raises(ValueError, match="unknown coordinate system"):
        crs.project(F.col("lon"), F.col("lat"), 4326, 1)


def test_quantising(spark):
    df = spark.createDataFrame([(2.5, 1000.0), (3.5, 0.0), (12.344, 1e12), (100.0, 8000.0)], "p double, m double")
    got = [tuple(r) for r in df.select(quantise.encode_value(F.col("p"), 1).alias("a"), quantise.encode_support(F.col("m")).alias("b")).collect()]
    assert got == [(2, 0), (4, -80), (12, round(8 * math.log2(1e9))), (100, 24)]
    r = spark.createDataFrame([(NODATA,)], "d short").select(quantise.decode_value(F.col("d"), 100), quantise.decode_support(F.col("d")), quantise.masked(F.lit(5), F.lit(False))).first()
    assert tuple(r) == (None, None, NODATA)


def test_orientation_and_filling(spark):
    r = spark.createDataFrame([(0, 0, 7)], "ix long, iy long, dn short")
    got = {(x.row, x.col): x.dn for x in densify(north_up(r, 3), 3, 2).collect()}
    assert got == {(i, j): 7 if (i, j) == (2, 0) else NODATA for i in range(3) for j in range(2)}


def test_reprojection_looks_up_the_source_cell(spark):
    spec = GridSpec(0.0, 0.0, 1000.0, 4, 4, 1, 0.0)
    src = spark.createDataFrame([(i, j, 10 * i + j) for i in range(4) for j in range(4)], "ix long, iy long, dn int")
    got = {(r.row, r.col): r.dn for r in reproject_nearest(src, spec, (-1000.0, 5000.0, 1000.0, 6, 6), 6933, 6933).collect()}
    assert got == {(4 - j, i + 1): 10 * i + j for i in range(4) for j in range(4)}


@pytest.mark.parametrize("big", [False, True])
def test_geotiff_has_its_pixels(spark, tmp_path, big):
    r = spark.createDataFrame([(0, 1, 5), (40, 0, -3), (20, 33, 7)], "row int, col int, dn short")
    path = write_geotiff(r, "dn", 41, 50, 0.0, 410.0, 10.0, 3857, str(tmp_path / "a.tif"), {"units": "a < b"}, 100, tile=16, big=big)
    pixels, place = read_geotiff(spark, path)
    got = {(x.row, x.col): x.dn for x in pixels.collect()}
    assert len(got) == 41 * 50 and {k: v for k, v in got.items() if v != NODATA} == {(0, 1): 5, (40, 0): -3, (20, 33): 7}
    assert place == {"rows": 41, "cols": 50, "left": 0.0, "top": 410.0, "pixel": 10.0, "epsg": 3857, "note": {"units": "a < b"}}
    assert open(path, "rb").read()[:4] == (b"II\x2b\0" if big else b"II\x2a\0") and not (tmp_path / "a.tif.tiles").exists()


def test_run_writes_both_bands(spark, csv, tmp_path):
    path = run(spark, csv, out=str(tmp_path / "o"), res=2000, cap_km=10, skip_calibration=True, scale=12.5, **COLS)
    sparse = {(x.row, x.col): (x.value_dn, x.support_dn) for x in spark.read.parquet(path).collect()}
    for k, band in enumerate(("value", "support")):
        pixels, _ = read_geotiff(spark, str(tmp_path / "o" / f"{band}.tif"))
        assert {(x.row, x.col): x.dn for x in pixels.where(f"dn <> {NODATA}").collect()} == {at: v[k] for at, v in sparse.items()}


def test_failed_writes_leave_the_old_raster(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    r = spark.createDataFrame([(0, 0, 1)], "row int, col int, dn short")
    write_raster(r, path, {"n": 1})
    with pytest.raises(Exception, match="planned"):
        write_raster(r.select("row", "col", F.raise_error(F.lit("planned")).cast("short").alias("dn")), path, {"n": 2})
    assert spark.read.parquet(path).collect() == r.collect() and json.loads((tmp_path / "r.json").read_text()) == {"n": 1}
    write_raster(r.withColumn("dn", F.lit(2).cast("short")), path, {"n": 3})
    assert spark.read.parquet(path).first().dn == 2 and not (tmp_path / "r.old").exists()


@pytest.mark.parametrize(("work", "out"), [(6933, 3857), (3857, 6933), (6933, 4326)])
def test_sparse_reprojection_equals_a_look_up_of_every_pixel(spark, work, out):
    r = np.random.default_rng(5)
    spec = GridSpec(-1.7e7, -7.4e6, 4e5, 85, 37, 1, 0.0) if work == 6933 else GridSpec(-2e7, -1.6e7, 6e5, 67, 54, 1, 0.0)
    src = spark.createDataFrame([(int(i), int(j), int(i * 100 + j)) for i, j in {(r.integers(spec.nx), r.integers(spec.ny)) for _ in range(900)}], "ix long, iy long, dn int")
    for size in (0.3, 1.0, 4.0):
        wide = 360.0 if out == 4326 else 4e7
        pixel = size * wide / 80
        rows, cols = int(0.5 * wide / pixel * (2 if out == 3857 else 1)), int(wide / pixel)
        left, top = -wide / 2, rows * pixel / 2
        grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
        x, y = crs.project(F.lit(left) + (F.col("col") + 0.5) * F.lit(pixel), F.lit(top) - (F.col("row") + 0.5) * F.lit(pixel), out, work)
        at = grid.select("row", "col", F.floor((x - F.lit(spec.x0)) / spec.res).alias("ix"), F.floor((y - F.lit(spec.y0)) / spec.res).alias("iy"))
        want = {tuple(p) for p in at.join(src, ["ix", "iy"]).select("row", "col", "dn").collect()}
        got = reproject_nearest(src, spec, (left, top, pixel, rows, cols), work, out).collect()
        assert {tuple(p) for p in got} == want and len(got) == len(want) > 0


def test_exact_samples(spark):
    p = spark.range(1000).selectExpr("id", "id * 2.0 as x")
    got = exact_sample(p, 100, 1000, seed=3).collect()
    assert len(got) == len({x.id for x in got}) == 100 and got == exact_sample(p, 100, 1000, seed=3).collect()
    assert exact_sample(p, 2000, 1000).count() == 1000 and exact_sample(p, 995, 1000).count() == 995


def test_stream_of_points_keeps_cells(spark, tmp_path):
    from gridloom.streaming.cells import stream_cells, write_cells

    src = tmp_path / "in"
    spark.createDataFrame([(0.5, 0.5, 1.0), (0.6, 0.2, 2.0)], "x double, y double, v double").write.parquet(str(src))
    q = write_cells(stream_cells(spark.readStream.schema("x double, y double, v double").parquet(str(src)), 0, 0, 1.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    spark.createDataFrame([(0.1, 0.1, 4.0), (3.5, 0.0, float("nan"))], "x double, y double, v double").write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 0, 7.0, 3)]


def test_calibration_of_a_sample(spark, csv, tmp_path):
    p = Pipeline(spark, csv, out=str(tmp_path), calib_max_points=200, calibration_options={"blocks_km": (20.0,), "levels": 3, "n_boot": 5, "min_n": 10}, **COLS)
    p.ingest()
    assert p.calibrate()["n_calibration_points"] == 200

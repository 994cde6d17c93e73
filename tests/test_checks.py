"""Checks of points, images and rasters, profiles of outputs, and lookups that find nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.errors import ParamError, TerralithError
from terralith.functions import checks as K
from terralith.operators import catalog as J
from terralith.operators import gcpcamera, pansharp
from terralith.sources import sinks


def test_points_need_numbers(spark):
    good = spark.createDataFrame([(1.0, 2.0, 3)], "x double, y float, z int")
    assert K.world_points(good) is good
    for ddl, values in (("x double, y double", (1.0, 2.0)), ("x double, y double, z string", (1.0, 2.0, "3"))):
        with pytest.raises(ParamError):
            K.world_points(spark.createDataFrame([values], ddl))
    with pytest.raises(ParamError):
        K.pixel_points(good)


def test_affine_round_trip(spark):
    t = (2.0, 0.5, 100.0, -0.25, -3.0, 900.0)
    x, y = K.affine(t, F.lit(7.0), F.lit(11.0))
    j, i = K.affine_inverse(t, x, y)
    assert tuple(spark.range(1).select(j, i).first()) == pytest.approx((7.0, 11.0))
    with pytest.raises(ParamError):
        K.affine_inverse((1.0, 2.0, 0.0, 2.0, 4.0, 0.0), F.lit(1.0), F.lit(1.0))


def test_profiles():
    assert sinks.profile("uint8", 3) == {"dtype": "uint8", "bands": 3, "nodata": None, "mask": True, "compress": "jpeg", "tiled": True, "blocksize": 512, "bigtiff": "if_safer", "photometric": "ycbcr"}
    assert sinks.profile("uint16", 1, "jpeg")["nbits"] == 12
    plain = sinks.profile("int16", 4)
    assert (plain["compress"], plain["nodata"], plain["mask"]) == ("deflate", -32768, False)
    assert sinks.profile("uint8", 1, options={"tiled": False}) == {"dtype": "uint8", "bands": 1, "nodata": None, "mask": True, "tiled": False}
    for bad in (("float32", 1, "jpeg"), ("int8", 1, None)):
        with pytest.raises(ParamError):
            sinks.profile(*bad)


def test_conversion_of_types():
    a = np.array([-1.0, 0.5, 1.5, 254.6, 300.0, math.nan])
    assert sinks.converted(a, "uint8").tolist() == [0, 0, 2, 255, 255, 0]
    assert sinks.converted(a, "int16").tolist() == [-1, 0, 2, 255, 300, -32768]
    assert np.isnan(sinks.converted(a, "float32")[-1])


def test_pan_rasters():
    pan = pansharp.Raster(0.0, 100.0, 1.0, -1.0, 100, 100)
    assert pansharp.check_rasters(pan, pansharp.Raster(10.5, 90.5, 4.0, -4.0, 10, 10)) == ((10, 9, 51, 50), (0, 0, 10, 10))
    with pytest.raises(TerralithError, match="overlap"):
        pansharp.check_rasters(pan, pansharp.Raster(100.0, 100.0, 4.0, -4.0, 10, 10))
    with pytest.raises(TerralithError, match="coarser"):
        pansharp.check_rasters(pan, pansharp.Raster(0.0, 100.0, 0.5, -0.5, 10, 10))
    assert pansharp.fitted_over(pan, 25, 50) == pansharp.Raster(0.0, 100.0, 2.0, -4.0, 25, 50)
    assert pansharp.colour_bands([False, True, False]) == [1, 3]
    for bad in ([0.5], [0.5, -0.1]):
        with pytest.raises(ParamError):
            pansharp.check_weights(bad, 2)


def test_lookups_keep_rows_and_say_why(spark):
    images = spark.createDataFrame([("d/a.tif", 1), ("d/a.tif", 2), ("d/b.jpg", 3), ("none.tif", 4)], "path string, filename int")
    params = spark.createDataFrame([("a.tif", 1.0), ("a", 2.0), ("b", 3.0)], "filename string, x double")
    got = sorted(map(tuple, J.by_name(images, params).select("path", "x", "reason").collect()), key=str)
    assert [r[:2] for r in got] == [("d/a.tif", 1.0), ("d/a.tif", 1.0), ("d/b.jpg", 3.0), ("none.tif", None)] and "none.tif" in got[-1][2]
    shots = spark.createDataFrame([("s1", "p"), ("s2", None), ("s3", "gone")], "filename string, camera string")
    cams = spark.createDataFrame([("p", 5.0), ("q", 6.0)], "camera string, focal double")
    rows = {r.filename: r for r in J.with_interior(shots, cams, "camera").collect()}
    assert rows["s1"].focal == 5.0 and rows["s2"].reason == "A camera must be named" and "gone" in rows["s3"].reason
    alone = {r.filename: r for r in J.with_interior(shots, cams.where("camera = 'p'"), "camera").collect()}
    assert alone["s2"].focal == 5.0 and alone["s2"].reason is None
    with pytest.raises(Exception, match="No exterior parameters"):
        J.required(J.by_name(images, params)).collect()
    assert J.required(J.by_name(images.where("filename < 4"), params)).count() == 3


def test_orders_of_control_point_cameras():
    assert [gcpcamera.order_for(n) for n in (2, 3, 5, 6, 9, 10, 50)] == [0, 1, 1, 2, 2, 3, 3]
    assert gcpcamera.powers(2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]

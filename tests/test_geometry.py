"""Round trips and known values of camera models, rotations and projections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF

from terralith.errors import CrsError
from terralith.functions import angles as A
from terralith.functions import cameras as C
from terralith.functions import crs as X
from terralith.functions import inverse
from terralith.operators import pansharp as P
from terralith.operators import raster
from terralith.plans import catalog
from terralith.plans import views as V
from terralith.plans.cameras import K, POSE, frame, rpc_struct


def test_known_pixels(spark):
    world = spark.createDataFrame([(20050.0, 29960.0, 800.0), (20000.0, 30000.0, 825.0), (19900.0, 30080.0, 0.0)], "x double, y double, z double")
    want = {
        ("pinhole", 0): (140.033647, 110.949835), ("brown", 0): (139.578129, 110.643023), ("fisheye", 0): (137.702972, 109.171713),
        ("pinhole", 1): (104.749385, 70.903480), ("brown", 2): (90.700049, 55.096064), ("fisheye", 2): (90.687465, 55.141391),
    }
    for kind, d in (("pinhole", {}), ("brown", V.BROWN), ("fisheye", V.FISHEYE)):
        got = world.select(*frame(kind, d).world_to_pixel(F.col("x"), F.col("y"), F.col("z"))).collect()
        for k, r in enumerate(got):
            if (kind, k) in want:
                assert tuple(r) == pytest.approx(want[kind, k], abs=1e-5)


@pytest.mark.parametrize("kind,d", [("pinhole", {}), ("brown", V.BROWN), ("opencv", V.BROWN), ("fisheye", V.FISHEYE)])
def test_pixel_world_pixel(spark, kind, d):
    px = spark.range(300).select((F.col("id") % 20 * 5 + 50).cast("double").alias("j"), (F.expr("id div 20") * 4 + 40).cast("double").alias("i"))
    c = frame(kind, d)
    if kind == "pinhole":
        x, y = c.pixel_to_world(F.col("j"), F.col("i"), 700.0)
        w = px.select("j", "i", x.alias("x"), y.alias("y"))
    else:
        uv = px.withColumn("uv", inverse.undistorted(kind, d, (F.col("j") - K.cx) / K.fx, (F.col("i") - K.cy) / K.fy))
        x, y = c.ray_to_world(F.col("uv.u"), F.col("uv.v"), 700.0)
        w = uv.select("j", "i", x.alias("x"), y.alias("y"))
    j, i = c.world_to_pixel(F.col("x"), F.col("y"), 700.0)
    far = w.select(F.max(F.greatest(F.abs(j - F.col("j")), F.abs(i - F.col("i")))).alias("d")).first()["d"]
    assert far < 0.1


def test_brown_is_general_model_with_five_coefficients(spark):
    w = spark.createDataFrame([(20030.0, 30010.0, 300.0)], "x double, y double, z double")
    a, b = (w.select(*frame(k, V.BROWN).world_to_pixel(F.col("x"), F.col("y"), F.col("z"))).first() for k in ("brown", "opencv"))
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)


def test_fisheye_on_axis_is_the_principal_point(spark):
    c = C.Frame(K, C.pose(0.0, 0.0, 100.0, 0.0, 0.0, 0.0), "fisheye", V.FISHEYE)
    got = spark.range(1).select(*c.world_to_pixel(0.0, 0.0, 0.0)).first()
    assert tuple(got) == pytest.approx((97.5, 78.5))


def test_rpc_round_trip(spark):
    px = spark.createDataFrame([(60.0, 40.0, 200.0), (120.0, 100.0, 300.0)], "j double, i double, z double").withColumn("rpc", rpc_struct())
    px = px.withColumn("w", inverse.rpc_to_world(F.col("rpc"), F.col("j"), F.col("i"), F.col("z")))
    j, i = C.rpc_to_pixel(F.col("rpc"), F.col("w.lon"), F.col("w.lat"), F.col("z"))
    for r in px.select("j", "i", j.alias("j2"), i.alias("i2")).collect():
        assert (r.j2, r.i2) == pytest.approx((r.j, r.i), abs=1e-6)


def test_transverse_mercator_known_place(spark):
    x, y = X.forward(X.utm(34, True), F.lit(16.690410), F.lit(0.270646))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((19999.994, 29999.911), abs=0.02)


def test_crs_parsing():
    assert X.parse_crs("EPSG:32735") == X.utm(35, False)
    assert X.parse_crs("+proj=tmerc +lon_0=25").lon0 == 25
    with pytest.raises(CrsError):
        X.parse_crs("EPSG:2154")


def test_weights_are_refitted_without_negative_ones():
    rng = np.random.default_rng(1)
    ms = rng.normal(size=(1000, 3))
    pan = ms @ [0.7, -0.2, 0.5]
    cov = np.cov(np.column_stack([pan, ms]).T)
    w = P.fit_weights(cov)
    assert (w >= 0).all() and w.sum() == pytest.approx(1) and w[1] == 0
    assert P.fit_weights(cov, [-1, 0, 1]).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        P.fit_weights(cov, [0, 0, 0])


def test_gram_schmidt_coefficients_match_image_domain():
    rng = np.random.default_rng(2)
    ms = rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 3)) + [5, 6, 7]
    cov, w = np.cov(ms.T), np.array([0.5, 0.3, 0.2])
    comps = [ms @ w]
    for k in range(3):
        phi = [np.cov(g, ms[:, k])[0, 1] / g.var(ddof=1) for g in comps]
        assert P.fit_phi(cov, w)[k] == pytest.approx(phi, abs=1e-9)
        comps.append(ms[:, k] - ms[:, k].mean() - sum(f * (g - g.mean()) for f, g in zip(phi, comps, strict=True)))


def test_pose_is_a_rotation(spark):
    m = [[math.nan] * 3 for _ in range(3)]
    row = spark.range(1).select(*(POSE.rotation[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3))).first()
    m = np.array(list(row)).reshape(3, 3)
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_body_angles_at_all_latitudes(spark):
    p = V.places(spark, SF)
    lam = F.radians(F.col("lon") - (F.floor((F.col("lon") + 180) / 6) * 6 - 177.0))
    turn = F.atan(F.tan(lam) * F.sin(F.radians("lat")))
    angles = [F.radians(F.lit(v) + F.col("id") % m) for v, m in ((-5.0, 11), (-4.0, 9), (0.0, 350))]
    want = p.select("id", "lat", *(v.alias(f"w{k}") for k, v in enumerate(A.rpy_to_opk(angles, [-F.sin(turn), F.cos(turn), F.lit(0.0)]))))
    got = catalog.queries()["rpy_opk"](spark, SF).join(want, "id").collect()
    assert len(got) == p.count() and sum(abs(r.lat) >= 70 for r in got) > 0
    for r in got:
        for a, b in ((r.omega, r.w0), (r.phi, r.w1), (r.kappa, r.w2)):
            assert math.remainder(a - b, 2 * math.pi) == pytest.approx(0, abs=2e-6)


@pytest.mark.parametrize("kind,d", [("brown", V.BROWN), ("opencv", V.OPENCV), ("opencv", V.OPENCV | {"s1": 0.01, "s3": -0.01, "t1": 0.05, "t2": -0.03}), ("fisheye", V.FISHEYE), ("pinhole", {})])
def test_inverse_of_every_kind(spark, kind, d):
    """Undistorting what a camera distorts gives the same place, for one camera and for cameras that differ by row."""
    px = spark.createDataFrame([(0.1 * a - 0.3, 0.1 * b - 0.2) for a in range(7) for b in range(5)], "u double, v double")
    at = C.Frame(K, POSE, kind, d).distorted(F.col("u"), F.col("v"))
    bent = px.withColumns({"du": at[0], "dv": at[1]})
    each = {k: F.lit(float(d.get(k, 0.0))) for k in C.COEFFICIENTS["opencv"]}
    rows = bent.withColumn("a", inverse.undistorted(kind, d, F.col("du"), F.col("dv"))).withColumn("b", inverse.undistorted_each(F.lit(kind), each, F.col("du"), F.col("dv"))).collect()
    for r in rows:
        assert (r.a.u, r.a.v) == pytest.approx((r.u, r.v), abs=1e-6) and (r.b.u, r.b.v) == pytest.approx((r.u, r.v), abs=1e-6)


def test_medians(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 5.0, 5.0], list(range(101)), [0.1 * k * k for k in range(50)], [None, 2.0, None, 9.0, 4.0]):
        got = raster.median(spark.createDataFrame([(None if v is None else float(v),) for v in values], "z double"), bins=8).first()["z"]
        assert got == pytest.approx(np.median([v for v in values if v is not None]))
    assert raster.median(spark.createDataFrame([], "z double")).first()["z"] is None


def test_images_and_bands_stay_apart(spark):
    """Rasters in one table are resampled, dilated and averaged each by itself, across the edges of blocks too."""
    rng = np.random.default_rng(3)
    data = {(im, b): rng.random((300, 20)) for im in ("p", "q") for b in (1, 2)}
    source = spark.createDataFrame([(im, b, i, j, float(a[i, j])) for (im, b), a in data.items() for i in range(240, 300) for j in range(20)], "image string, band int, i long, j long, v double")
    cells = spark.createDataFrame([(im, k, 250.0 + 0.37 * k, 4.0 + 0.21 * k) for im in ("p", "q") for k in range(40)], "image string, id long, i double, j double")
    got = raster.interpolated(cells, source, F.col("j"), F.col("i"), "bilinear", ["image"]).collect()
    assert len(got) == 160
    for r in got:
        y, x = 250 + 0.37 * r.id, 4 + 0.21 * r.id
        a, i, j = data[r.image, r.band], int(y), int(x)
        want = sum(a[i + di, j + dj] * (1 - abs(y - i - di)) * (1 - abs(x - j - dj)) for di in (0, 1) for dj in (0, 1))
        assert r.v == pytest.approx(want)
    mask = source.where("band = 1").select("image", "i", "j", (F.col("v") > 0.97).cast("int").alias("m"))
    for r in raster.dilated(mask, 2, ["image"]).collect():
        part = data[r.image, 1][max(240, r.i - 2) : r.i + 3, max(0, r.j - 2) : r.j + 3]
        assert r.m == int((part > 0.97).any())


def test_a_task_refines_few_models(spark, monkeypatch):
    """Models are wide but shrink in a shuffle: they are parted by their number, and points don't carry them."""
    from pyspark.sql import functions as F

    from terralith.operators import refine
    from terralith.plans import tags

    monkeypatch.setattr(refine, "MODELS", 20)
    models, gcps = tags.rpc_models(spark, SF), tags.V.gcps(spark, SF)
    out = refine.refine(models, gcps, "shift")
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0] < 60
    assert out.count() == models.count()
    twice = refine.refine(models.union(models), gcps, "shift").where("n > 0")
    assert {r["n"] for r in twice.select("n").collect()} == {2 * r["n"] for r in out.where("n > 0").select("n").collect()}


def test_cells_shared_by_many_images(spark, monkeypatch):
    """Images that share cells are dealt to tasks, a few to each, with the same values."""
    from terralith.operators import blocks

    source = spark.range(40 * 30).selectExpr("id div 30 as image", "id % 30 div 6 as i", "id % 6 as j", "cast(id as double) as v")
    cells = spark.range(12).selectExpr("id as r", "id * 0.3 as i", "id * 0.4 as j")
    monkeypatch.setattr(blocks, "TOGETHER", 1000)
    want = {(r["image"], r["r"]): r["v"] for r in blocks.interpolated(cells, source, "bilinear").collect()}
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    out = blocks.interpolated(cells, source, "bilinear")
    assert "block_deal" in out._jdf.queryExecution().toString()
    assert {(r["image"], r["r"]): r["v"] for r in out.collect()} == want and len(want) == 40 * 12


def test_equal_rays_are_followed_once(spark):
    from terralith.operators import ortho

    rays = spark.range(1000).selectExpr("id", "0.0D as x", "0.0D as y", "if(id % 4 = 3, null, 10.0D) as z", "if(id % 4 = 0, 1.0D, 0.5D) as dx", "0.0D as dy", "-1.0D as dz")
    dem = spark.range(40).selectExpr("0L as i", "id as j", "3.0D as z")
    out = ortho.ray_hits(rays, dem, 9, lambda x, y: F.floor(y), lambda x, y: F.floor(x))
    got = {r["id"]: (r["step"], r["x"], r["hit"]) for r in out.collect()}
    assert got == {k: (9, 4.5, False) if k % 4 == 3 else (7, 7.0 if k % 4 == 0 else 3.5, True) for k in range(1000)}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.rindex("Aggregate")  # below the steps, equal rays are one

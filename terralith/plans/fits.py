"""Queries without SQL: fits that iterate, and scans of files that they write first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.num import shown
from terralith.operators import calibrate, gcpcamera, pose
from terralith.plans import views as V
from terralith.plans.cameras import K, POSE
from terralith.functions import cameras as C
from terralith.plans.catalog import query


@query("fit_exterior", "select o_custkey::varchar as filename, 20000.0::double as x, 30000.0::double as y, 1000.0::double as z, round(radians(-3.0::double), 4) as omega, round(radians(2.0::double), 4) as phi, round(radians(10.0::double), 4) as kappa from orders group by o_custkey having count(*) >= 4")
def fit_exterior(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and angles of the cameras of all images with four points or more, which a known pose has projected."""
    o = F.col("o_orderkey")
    world = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("filename"), (20000.0 + (o * 37) % 300 - 150).alias("x"), (30000.0 + (o * 53) % 240 - 120).alias("y"), (o % 90).cast("double").alias("z"))
    j, i = C.Frame(K, POSE).world_to_pixel(F.col("x"), F.col("y"), F.col("z"))
    out = pose.fit_exterior(world.select("filename", "x", "y", "z", j.alias("j"), i.alias("i")), pose.Interior(500 / 3, 500 / 3, 97.5, 78.5), least=4)
    return out.select("filename", *(shown(F.col(c), 2).alias(c) for c in "xyz"), *(shown(F.col(c), 4).alias(c) for c in ("omega", "phi", "kappa")))


#: The boundary of each shot's image on the ground, and its area by the shoelace formula.
SHOT_RING = "select filename, ord, x + ax*(0 - z)/aw as wx, y + ay*(0 - z)/aw as wy from (select s.*, ord, cos(phi)*cos(kappa)*u + cos(phi)*sin(kappa)*v - sin(phi) as ax, (cos(omega)*sin(kappa)+sin(omega)*sin(phi)*cos(kappa))*u - (cos(omega)*cos(kappa)-sin(omega)*sin(phi)*sin(kappa))*v + sin(omega)*cos(phi) as ay, (sin(omega)*sin(kappa)-cos(omega)*sin(phi)*cos(kappa))*u - (sin(omega)*cos(kappa)+cos(omega)*sin(phi)*sin(kappa))*v - cos(omega)*cos(phi) as aw from v_shot s, (select ord, (j-99.5)/160 as u, (i-74.5)/160 as v from (values (0, 0.0::double, 0.0::double), (1, 99.5, 0.0), (2, 199.0, 0.0), (3, 199.0, 74.5), (4, 199.0, 149.0), (5, 99.5, 149.0), (6, 0.0, 149.0), (7, 0.0, 74.5)) as t(ord, j, i)) b)"


@query("gsd_by_camera", V.sql("select filename, round(sqrt(abs(sum(wx * ny - nx * wy)) / 2 / (199.0::double * 149)), 6) + 0.0 as gsd from (select filename, wx, wy, coalesce(lead(wx) over w, first_value(wx) over w) as nx, coalesce(lead(wy) over w, first_value(wy) over w) as ny from ring window w as (partition by filename order by ord)) group by filename", "v_shot", ring=SHOT_RING))
def gsd_by_camera(spark: SparkSession, sf: str) -> DataFrame:
    """Ground size of a pixel of every camera at once: one projection of eight boundary points each."""
    from terralith.operators.boundary import pixel_boundary
    from terralith.operators.raster import ring_area

    s = V.shots(spark, sf).withColumn("_k", F.lit(1))
    p = C.pose(*(F.col(c) for c in ("x", "y", "z", "omega", "phi", "kappa")))
    x, y = C.Frame(C.intrinsic(*V.SIZE, 0.8), p).pixel_to_world(F.col("j"), F.col("i"), 0.0)
    ring = s.join(F.broadcast(pixel_boundary(spark, *V.SIZE).withColumn("_k", F.lit(1))), "_k").select("filename", "ord", x.alias("wx"), y.alias("wy"))
    return ring_area(ring, ["filename"], "ord", "wx", "wy").select("filename", shown(F.sqrt(F.col("area") / (199 * 149))).alias("gsd"))


#: Control points of images that a known affine map has projected, seven or more an image.
AFFINE = "select 'img_' || c as filename, k as ord, lon, lat, 5000 * (lon - 24) + 300 * (lat + 33) + c as j, 200 * (lon - 24) - 4000 * (lat + 33) + 50 as i from (select c_custkey as c, k, 24.0::double + ((c_custkey * 7 + k * 13) % 50) * 0.01::double as lon, -33.0::double - ((c_custkey * 3 + k * k * 3 + k * 7) % 37) * 0.01::double as lat from customer, unnest(range(0, 20)) as t(k))"


def affine_points(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(c, F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    k = F.col("k")
    at = rows.select(c, F.concat(F.lit("img_"), c.cast("string")).alias("filename"), k.alias("ord"), (24.0 + ((c * 7 + k * 13) % 50) * 0.01).alias("lon"), (-33.0 - ((c * 3 + k * k * 3 + k * 7) % 37) * 0.01).alias("lat"))
    lon, lat = F.col("lon") - 24, F.col("lat") + 33
    return at.select("filename", "ord", "lon", "lat", (5000 * lon + 300 * lat + c).alias("j"), (200 * lon - 4000 * lat + 50).alias("i"))


@query("gcp_camera", f"select filename, round(5000 * 0.123::double + 300 * -0.05::double + substr(filename, 5)::bigint, 4) as j, round(200 * 0.123::double - 4000 * -0.05::double + 50, 4) as i, 24.123::double as lon, -33.05::double as lat from ({AFFINE}) group by filename")
def gcp_camera(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras of control points alone: where each image shows a place, and which place that pixel is."""
    fitted = gcpcamera.fit(affine_points(spark, sf))
    j, i = gcpcamera.to_pixel(F.lit(24.123), F.lit(-33.05))
    at = fitted.withColumns({"j": j, "i": i})
    lon, lat = gcpcamera.to_world(F.col("j"), F.col("i"))
    return at.select("filename", F.round("j", 4).alias("j"), F.round("i", 4).alias("i"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("fit_frame", "select 'cam ' || m as camera, count(*)::bigint as images, 160.0::double as fx, 99.0::double as cx, 75.0::double as cy, round(-0.1::double, 4) as k1 from (select unnest(range(1, 61)) % 20 as m) group by m")
def fit_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras calibrated by the points of three images each, which a known camera with distortion has projected."""
    c, k = F.col("c"), F.col("k")
    # sixty images of twenty cameras at all scales
    images = spark.range(1, 61).select(F.col("id").alias("c"))
    points = images.select("c", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    x, y, z = (k * 37 + c * 11) % 100 - 50.0, (k * 53 + c * 7) % 80 - 40.0, ((k * 29 + c) % 31).cast("double")
    at = points.select("c", "k", x.alias("x"), y.alias("y"), z.alias("z"))
    p = C.pose((c % 3 - 1) * 20.0, (c % 5 - 2) * 6.0, 100.0 + c % 7, (c % 3 - 1) * 0.15, (c % 4 - 1.5) * 0.1, c * 0.1)
    made = C.Frame(C.Intrinsic(*(F.lit(v) for v in (160.0, 160.0, 99.0, 75.0))), p, "brown", {"k1": -0.1, "k2": 0.02, "p1": 0.001, "p2": -0.002})
    j, i = made.world_to_pixel(F.col("x"), F.col("y"), F.col("z"))
    seen = at.select(F.concat(F.lit("cam "), (c % 20).cast("string")).alias("camera"), F.concat(F.lit("im "), c.cast("string")).alias("filename"), "x", "y", "z", j.alias("j"), i.alias("i"))
    out = calibrate.fit_frame(seen, "brown", (200, 150))
    return out.groupBy("camera").agg(F.count("*").alias("images"), *(shown(F.avg(n), d).alias(n) for n, d in (("fx", 3), ("cx", 3), ("cy", 3), ("k1", 4))))

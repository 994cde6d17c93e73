"""Deterministic views of the driver's tables that stand for rasters, cameras and control points, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The camera of all single-camera queries: position, angles in degrees, image size, and normalised interior.
POSITION, ANGLES = (20000.0, 30000.0, 1000.0), (-3.0, 2.0, 10.0)
SIZE, FOCAL, SENSOR, CENTRE = (200, 150), 5.0, (6.0, 4.5), (-0.01, 0.02)
BROWN = {"k1": -0.25, "k2": 0.2, "p1": 0.01, "p2": 0.01, "k3": -0.1}
OPENCV = BROWN | {"k4": 0.001, "k5": 0.001, "k6": -0.001}
FISHEYE = {"k1": -0.25, "k2": 0.1, "k3": 0.01, "k4": -0.01}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raster(spark: SparkSession, d: str) -> DataFrame:
    """i, j, v: a pixel table, one row a pixel."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return e.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def dem(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).select("i", "j", (F.lit(825.0) + F.lit(25.0) * F.col("v")).alias("z"))


def world(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), (20000.0 + (e % 997) - 498).alias("x"), (30000.0 + ((e * 7) % 991) - 495).alias("y"), F.col("value").alias("z"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), (e % 200).cast("double").alias("j"), ((e * 3) % 150).cast("double").alias("i"), F.col("value").alias("z"))


def panms(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    b1, b2, b3 = F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_tax") * 1000
    return table(spark, d, "lineitem").select(*keys, (0.5 * b1 + 0.3 * b2 + 0.2 * b3 + F.col("l_extendedprice") / 50000).alias("pan"), b1.alias("b1"), b2.alias("b2"), b3.alias("b3"))


def panms_raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("pan"), F.col("l_quantity").alias("b1"), (F.col("l_discount") * 1000).alias("b2"), (F.col("l_tax") * 1000).alias("b3"))


def shots(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    name = F.concat(F.lit("img_"), o.cast("string"), F.when(o % 2 == 0, ".tif").otherwise(""))
    return table(spark, d, "orders").select(
        name.alias("filename"), F.col("o_custkey").alias("cam_id"), (20000.0 + o % 1000).alias("x"), (30000.0 + (o * 3) % 1000).alias("y"), (1000.0 + o % 50).alias("z"),
        ((o % 21 - 10) * 0.01).alias("omega"), ((o % 19 - 9) * 0.01).alias("phi"), ((o % 180) * 0.03).alias("kappa"),
    )


def cams(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    # shots name customers: every seventh camera goes by a number that none names
    return table(spark, d, "customer").select((c + F.when(c % 7 == 3, 10_000_000).otherwise(0)).alias("cam_id"), (0.7 + (c % 40) * 0.01).alias("focal"), ((c % 11 - 5) * 0.001).alias("cx"), ((c % 13 - 6) * 0.001).alias("cy"), ((c % 9 - 4) * 0.01).alias("k1"))


def gcps(spark: SparkSession, d: str) -> DataFrame:
    """Control points: an image a customer, a point an order."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("img_"), F.col("o_custkey").cast("string"), F.lit(".tif")).alias("filename"), o.alias("ord"), (100.0 + o % 700 + (o % 13) * 0.25).alias("j"), (80.0 + (o * 7) % 500 + (o % 7) * 0.5).alias("i"),
        (24.0 + (o % 1000) * 0.001).alias("lon"), (-33.0 - ((o * 3) % 1000) * 0.001).alias("lat"), (500.0 + o % 300).alias("h"),
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), (-80.0 + ((e * 37) % 16399) * 0.01).alias("lat"), (-180.0 + ((e * 101) % 35999) * 0.01).alias("lon"), (F.col("value")).alias("alt"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "v_raster": "select vec_id as i, (p - 1)::bigint as j, embedding[p]::double as v from embeddings, unnest(range(1, 65)) as t(p)",
    "v_dem": "select i, j, 825.0::double + 25.0::double * v as z from v_raster",
    "v_world": "select event_id as id, 20000.0::double + (event_id % 997) - 498 as x, 30000.0::double + ((event_id * 7) % 991) - 495 as y, value as z from events",
    "v_pixel": "select event_id as id, (event_id % 200)::double as j, ((event_id * 3) % 150)::double as i, value as z from events",
    "v_panms": "select 0.5::double * l_quantity + 0.3::double * (l_discount * 1000) + 0.2::double * (l_tax * 1000) + l_extendedprice / 50000 as pan, l_quantity as b1, l_discount * 1000 as b2, l_tax * 1000 as b3 from lineitem",
    "v_panms_raw": "select l_extendedprice as pan, l_quantity as b1, l_discount * 1000 as b2, l_tax * 1000 as b3 from lineitem",
    "v_shot": "select 'img_' || o_orderkey || case when o_orderkey % 2 = 0 then '.tif' else '' end as filename, o_custkey as cam_id, 20000.0::double + o_orderkey % 1000 as x, 30000.0::double + (o_orderkey * 3) % 1000 as y, 1000.0::double + o_orderkey % 50 as z, (o_orderkey % 21 - 10) * 0.01::double as omega, (o_orderkey % 19 - 9) * 0.01::double as phi, (o_orderkey % 180) * 0.03::double as kappa from orders",
    "v_cam": "select c_custkey + case when c_custkey % 7 = 3 then 10000000 else 0 end as cam_id, 0.7::double + (c_custkey % 40) * 0.01::double as focal, (c_custkey % 11 - 5) * 0.001::double as cx, (c_custkey % 13 - 6) * 0.001::double as cy, (c_custkey % 9 - 4) * 0.01::double as k1 from customer",
    "v_gcp": "select 'img_' || o_custkey || '.tif' as filename, o_orderkey as ord, 100.0::double + o_orderkey % 700 + (o_orderkey % 13) * 0.25::double as j, 80.0::double + (o_orderkey * 7) % 500 + (o_orderkey % 7) * 0.5::double as i, 24.0::double + (o_orderkey % 1000) * 0.001::double as lon, -33.0::double - ((o_orderkey * 3) % 1000) * 0.001::double as lat, 500.0::double + o_orderkey % 300 as h from orders",
    "v_lla": "select event_id as id, -80.0::double + ((event_id * 37) % 16399) * 0.01::double as lat, -180.0::double + ((event_id * 101) % 35999) * 0.01::double as lon, value as alt from events",
}
_needs = {"v_dem": ["v_raster"]}


def sql(body: str, *views: str, **parts: str) -> str:
    """A query over the views it names, which may name further ones, and over parts of its own."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_needs.get(v, []), v] if n not in names]
    ctes = [f"{n} as ({SQL[n]})" for n in names] + [f"{n} as ({q})" for n, q in parts.items()]
    return f"with {', '.join(ctes)} {body}" if ctes else body

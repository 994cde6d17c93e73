"""Boundaries of images in pixels and in the world, and what a camera sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import cameras as C
from terralith.functions import inverse
from terralith.functions.num import shown


def pixel_boundary(spark: SparkSession, width: int, height: int) -> DataFrame:
    """ord, j, i: the corners and the middles of the sides, clockwise from the origin."""
    w, h = width - 1.0, height - 1.0
    ring = [(0.0, 0.0), (w / 2, 0.0), (w, 0.0), (w, h / 2), (w, h), (w / 2, h), (0.0, h), (0.0, h / 2)]
    return spark.createDataFrame([(k, j, i) for k, (j, i) in enumerate(ring)], "ord int, j double, i double")


def pixel_boundary_n(spark: SparkSession, width: int, height: int, points: int) -> DataFrame:
    """side, k, j, i: about so many points along the sides, each side's share rounded half to even."""
    w, h = width - 1.0, height - 1.0
    corners = [(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]
    sides = []
    for s in range(4):
        (j0, i0), (j1, i1) = corners[s], corners[(s + 1) % 4]
        sides.append((s, j0, i0, j1, i1, max(1, round(points * (abs(j1 - j0) + abs(i1 - i0)) / (2 * (w + h))))))
    t = spark.createDataFrame(sides, "side int, j0 double, i0 double, j1 double, i1 double, n int").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return t.select("side", "k", (F.col("j0") + (F.col("j1") - F.col("j0")) * F.col("k") / F.col("n")).alias("j"), (F.col("i0") + (F.col("i1") - F.col("i0")) * F.col("k") / F.col("n")).alias("i"))


def world_boundary(boundary: DataFrame, camera: C.Frame, z: Column | float) -> DataFrame:
    """ord, x, y: where the rays through boundary pixels meet a height."""
    x, y = camera.pixel_to_world(F.col("j"), F.col("i"), z)
    return boundary.select("ord", shown(x).alias("x"), shown(y).alias("y"))


def sees_horizon(shots: DataFrame, boundary: DataFrame, k: C.Intrinsic) -> DataFrame:
    """filename, horizon: whether the ray through any boundary pixel doesn't go down. The boundary has eight rows."""
    p = C.pose(0.0, 0.0, 0.0, F.col("omega"), F.col("phi"), F.col("kappa"))
    u, v = (F.col("j") - k.cx) / k.fx, (F.col("i") - k.cy) / k.fy
    rz = p.rotation[2][0] * u + p.rotation[2][1] * v + p.rotation[2][2]
    rays = shots.withColumn("_b", F.lit(1)).join(F.broadcast(boundary.withColumn("_b", F.lit(1))), "_b")
    return rays.groupBy("filename").agg(F.bool_or(rz >= 0).alias("horizon"))


def undistorted_rectangles(spark: SparkSession, k: C.Intrinsic, size: tuple[int, int], kind: str, d: dict) -> DataFrame:
    """rect (inner or outer), u0, v0, u1, v1: in ideal camera coordinates, from a 9 x 9 grid of pixels."""
    n = 9
    grid = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("a"), (F.col("id") % n).cast("int").alias("b"))
    j, i = F.col("b") * ((size[0] - 1) / (n - 1)), F.col("a") * ((size[1] - 1) / (n - 1))
    g = grid.withColumn("uv", inverse.undistorted(kind, d, (j - k.cx) / k.fx, (i - k.cy) / k.fy)).select("a", "b", "uv.u", "uv.v")
    u, v = F.col("u"), F.col("v")
    at = lambda c, name, value: F.when(F.col(name) == value, c)
    one = g.agg(
        F.max(at(u, "b", 0)).alias("iu0"), F.max(at(v, "a", 0)).alias("iv0"), F.min(at(u, "b", n - 1)).alias("iu1"), F.min(at(v, "a", n - 1)).alias("iv1"),
        F.min("u").alias("ou0"), F.min("v").alias("ov0"), F.max("u").alias("ou1"), F.max("v").alias("ov1"),
    )
    rows = [F.struct(F.lit(name).alias("rect"), *(F.col(f"{p}{c}").alias(c) for c in ("u0", "v0", "u1", "v1"))) for name, p in (("inner", "i"), ("outer", "o"))]
    return one.select(F.inline(F.array(*rows)))


def undistorted_intrinsic(rects: DataFrame, size: tuple[int, int], blends: list[float]) -> DataFrame:
    """alpha, fx, fy, cx, cy: intrinsics that show the inner rectangle (0), the outer one (1) or a blend."""
    fx, fy = (size[0] - 1) / (F.col("u1") - F.col("u0")), (size[1] - 1) / (F.col("v1") - F.col("v0"))
    k = rects.select("rect", fx.alias("fx"), fy.alias("fy"), (-fx * F.col("u0")).alias("cx"), (-fy * F.col("v0")).alias("cy"))
    both = k.groupBy().pivot("rect", ["inner", "outer"]).agg(*(F.first(c).alias(c) for c in ("fx", "fy", "cx", "cy")))
    a = F.col("alpha")
    return both.withColumn("alpha", F.explode(F.array(*map(F.lit, blends)))).select("alpha", *((F.col(f"inner_{c}") * (1 - a) + F.col(f"outer_{c}") * a).alias(c) for c in ("fx", "fy", "cx", "cy")))

"""Orthorectification: heights for a grid, its projection into the image, and rays that meet a surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import cameras as C


def with_heights(cells: DataFrame, dem: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Cells with the elevation raster's z of the same row and column, and more of its columns; cells without one are left out."""
    return cells.join(dem.select(*(more or []), F.col("i").alias("r"), F.col("j").alias("c"), "z"), ["r", "c"]).where("z is not null")


def seen(cells: DataFrame, camera: C.Frame) -> DataFrame:
    """Cells (x, y, z) with where they lie in the camera's image (j, i)."""
    j, i = camera.world_to_pixel(F.col("x"), F.col("y"), F.col("z"))
    return cells.withColumn("j", j).withColumn("i", i).where("j is not null and i is not null")


def ray_hits(rays: DataFrame, dem: DataFrame, steps: int, row: Callable[[Column, Column], Column], column: Callable[[Column, Column], Column]) -> DataFrame:
    """id, step, x, y, hit: the first of the steps at which each ray (x, y, z, dx, dy, dz) is at or below the surface.

    A ray that meets no surface gives its last step, the lowest point, and hit is false. Rays with the same place and
    direction are followed once.
    """
    s, way = F.col("step"), F.struct("x", "y", "z", "dx", "dy", "dz").alias("way")
    named = rays.select("id", way)
    at = rays.select(way).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)).cast("array<long>")))
    along = lambda c: F.col(f"way.{c}") + F.col(f"way.d{c}") * s
    at = at.select("way", "step", along("x").alias("x"), along("y").alias("y"), along("z").alias("rz"))
    at = at.withColumn("i", row(F.col("x"), F.col("y")).cast("long")).withColumn("j", column(F.col("x"), F.col("y")).cast("long"))
    met = at.join(dem.select("i", "j", F.col("z").alias("surface")), ["i", "j"], "left")
    point = F.struct("step", "x", "y")
    ends = met.groupBy("way").agg(F.min(F.when(F.col("rz") <= F.col("surface"), point)).alias("first"), F.max(point).alias("last"))
    found = ends.select("way", F.coalesce("first", "last").alias("h"), F.col("first").isNotNull().alias("hit"))
    return named.join(found, "way").select("id", "h.step", "h.x", "h.y", "hit")

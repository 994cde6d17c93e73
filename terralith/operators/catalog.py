"""Lookups of camera parameters as joins: image to exterior, exterior to interior, image to control points.

Every row that looks something up stays. One that finds nothing has NULLs and says so in the column reason;
required() turns such rows into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.errors import ParamError
from terralith.functions.text import file_name, stem


def by_name(images: DataFrame, params: DataFrame, key: str = "filename", what: str = "exterior") -> DataFrame:
    """Images (path) with the parameters of their file name, or else of its stem, and reason.

    Two left joins on equal names; repeated images stay, and names that the images have already are replaced.
    """
    fields = F.struct(*params.columns)
    sides = [params.select(F.col(key).alias(f"key{k}"), fields.alias(f"p{k}")) for k in range(2)]
    name = file_name(F.col("path"))
    rows = images.select(F.struct(*images.columns).alias("row"), name.alias("key0"), stem(name).alias("key1"))
    for k, side in enumerate(sides):
        rows = rows.join(side, f"key{k}", "left")
    kept = [F.col(f"row.{c}") for c in images.columns if c not in params.columns and c != "reason"]
    found = F.coalesce("p0", "p1")
    reason = F.when(found.isNull(), F.concat(F.lit(f"No {what} parameters for "), F.col("key0")))
    return rows.select(*kept, *(found[c].alias(c) for c in params.columns), reason.alias("reason"))


def with_interior(exterior: DataFrame, interior: DataFrame, key: str = "cam_id") -> DataFrame:
    """Exterior parameters with those of their camera, and reason. A row that names no camera takes the only one, if there is just one."""
    only = interior.agg(F.count("*").alias("n"), F.first(key).alias("only"))
    own = [c for c in exterior.columns if c not in interior.columns and c != "reason"]
    named = exterior.select(F.struct(*own).alias("row"), F.col(key).alias("asked"), (F.col("reason") if "reason" in exterior.columns else F.lit(None).cast("string")).alias("before"))
    named = named.join(F.broadcast(only)).withColumn("id", F.coalesce("asked", F.when(F.col("n") == 1, F.col("only"))))
    rows = named.join(interior.select(F.col(key).alias("id"), F.struct(*interior.columns).alias("p")), "id", "left")
    why = F.when(F.col("id").isNull(), "A camera must be named").when(F.col("p").isNull(), F.concat(F.lit("No interior parameters for "), F.col("id").cast("string")))
    return rows.select(*(f"row.{c}" for c in own), *(F.coalesce(F.col("id"), F.col("p")[c]).alias(c) if c == key else F.col("p")[c].alias(c) for c in interior.columns), F.coalesce("before", why).alias("reason"))


def required(rows: DataFrame) -> DataFrame:
    """The rows without reason; one that has a reason stops the job with it."""
    checked = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("ParamError: "), F.col("reason")))).otherwise(F.lit(True))
    return rows.where(checked.cast("boolean")).drop("reason")


def check(rows: DataFrame) -> DataFrame:
    """The same at once: raises ParamError that names a row."""
    bad = rows.where("reason is not null").select("reason").first()
    if bad:
        raise ParamError(bad["reason"])
    return rows.drop("reason")


def unmatched(gcps: DataFrame, images: DataFrame) -> DataFrame:
    """File names of control points that belong to no image, which stay unused."""
    return gcps.select("filename").distinct().join(images.select(file_name(F.col("path")).alias("filename")), "filename", "left_anti")


def initialised(exterior: Column) -> Column:
    """A camera's position, or an error where it has none."""
    return F.when(exterior.isNull(), F.raise_error(F.lit("CameraInitError: the camera has no exterior parameters"))).otherwise(exterior)

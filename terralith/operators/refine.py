"""Refinement of rational polynomial models by control points: one grouped aggregate for all images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import cameras as C
from terralith.functions.num import over
from terralith.functions.text import stem


LEAST = {"shift": 1, "shift-drift": 2}


def _fits(points: DataFrame, method: str) -> DataFrame:
    aggs = []
    for a in "ji":
        if method == "shift":
            aggs += [F.lit(1.0).alias(f"m_{a}"), F.avg(F.col(a) - F.col(f"{a}_model")).alias(f"c_{a}")]
        else:
            aggs += [F.regr_slope(a, f"{a}_model").alias(f"m_{a}"), F.regr_intercept(a, f"{a}_model").alias(f"c_{a}")]
    return points.groupBy("filename").agg(F.count("*").alias("n"), *aggs)


def shift(points: DataFrame, method: str = "shift") -> DataFrame:
    """filename, n, and for each axis m and c so that m * model + c fits the marked pixels.

    points: filename and, by axis, the model's and the marked pixel, normalised (j_model, j, i_model, i). shift: m is
    1 and c the mean offset. shift-drift: least squares. Images with fewer points than that needs are left out.
    """
    return _fits(points, method).where(F.col("n") >= LEAST[method])


def refined(num: Column, den: Column, m: Column, c: Column) -> Column:
    """Numerator coefficients that give m * model + c: the denominator stays."""
    return F.zip_with(num, den, lambda a, b: m * a + c * b)


def errors(points: DataFrame, scale_j: float, scale_i: float) -> DataFrame:
    """filename, rmse, least and most: distances in pixels between model and marks."""
    dj, di = (F.col("j") - F.col("j_model")) * scale_j, (F.col("i") - F.col("i_model")) * scale_i
    d2 = dj * dj + di * di
    return points.groupBy("filename").agg(F.sqrt(F.avg(d2)).alias("rmse"), F.sqrt(F.min(d2)).alias("least"), F.sqrt(F.max(d2)).alias("most"))


def enough(gcps: DataFrame, least_each: int, least_all: int) -> DataFrame:
    """Whether there are enough control points: in the image with the fewest, and in all."""
    counts = gcps.groupBy("filename").agg(F.count("*").alias("n"))
    return counts.agg(F.min("n").alias("fewest"), F.sum("n").alias("total")).withColumn("enough", (F.col("fewest") >= least_each) & (F.col("total") >= least_all))


def coplanar(gcps: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """filename, coplanar: whether heights are all the same and zero, as a full fit of a camera needs."""
    return gcps.groupBy("filename").agg((~((F.avg("h") > tolerance) | (F.stddev_pop("h") > tolerance))).alias("coplanar"))


#: Models that a task joins and sorts, about 700 bytes each.
MODELS = 20_000


def _parts(models: DataFrame) -> int:
    """How many parts keep a task's models few. Models shrink much in a shuffle, so that parts merged by their size there would be large."""
    return max(models.sparkSession.sparkContext.defaultParallelism, -(-models.count() // MODELS))


def model_pixels(models: DataFrame, gcps: DataFrame, parts: int | None = None) -> DataFrame:
    """filename, rpc and, for each control point, the marked and the model's pixel, normalised.

    models: filename, rpc; gcps: filename (the model's, or its stem), lon, lat, h, j, i.
    """
    parts = parts or _parts(models)
    name = F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("rank"), F.col("filename").alias("name")), F.struct(F.lit(1).alias("rank"), stem(F.col("filename")).alias("name")))))
    # names find their points first: a model is as wide as a hundred points, and joins them last
    probes = models.select("filename", name.alias("probe")).select("filename", "probe.*").distinct()
    marks = gcps.select(F.col("filename").alias("name"), "lon", "lat", "h", "j", "i")
    # a point under the stem counts only where no point has the whole name
    whole = gcps.select(F.col("filename").alias("filename"), F.lit(True).alias("has")).distinct()
    pairs = probes.join(marks, "name").join(whole, "filename", "left").where((F.col("rank") == 0) | F.col("has").isNull())
    pairs = pairs.select("filename", "lon", "lat", "h", "j", "i").join(models.select("filename", "rpc").repartition(parts, "filename"), "filename")
    j, i = C.rpc_to_pixel(F.col("rpc"), F.col("lon"), F.col("lat"), F.col("h"))
    scaled = lambda v, axis: over(v - F.col(f"rpc.{axis}_off"), F.col(f"rpc.{axis}_scale"))
    return pairs.select("filename", "rpc", *(scaled(v, axis).alias(n) for v, axis, n in ((F.col("j"), "samp", "j"), (F.col("i"), "line", "i"), (j, "samp", "j_model"), (i, "line", "i_model"))))


def refine(models: DataFrame, gcps: DataFrame, method: str = "shift") -> DataFrame:
    """Models (filename, rpc and more) refined by control points; n says by how many, and is 0 where a model stays as it is.

    A model without points stays; one with fewer than the method needs has a reason.
    """
    least = LEAST[method]
    parts = _parts(models)
    rows = models.repartition(parts, "filename").join(_fits(model_pixels(models, gcps, parts).drop("rpc"), method), "filename", "left")
    new = F.col("rpc")
    for axis, name in (("j", "samp"), ("i", "line")):
        new = new.withField(f"{name}_num_coeff", refined(F.col(f"rpc.{name}_num_coeff"), F.col(f"rpc.{name}_den_coeff"), F.col(f"m_{axis}"), F.col(f"c_{axis}")))
    n = F.coalesce("n", F.lit(0))
    reason = F.when((n > 0) & (n < least), F.concat(F.lit(f"{method} needs {least} control points: "), F.col("filename")))
    out = rows.withColumn("rpc", F.when((n >= least) & F.col("m_j").isNotNull(), new).otherwise(F.col("rpc"))).withColumn("n", n).withColumn("reason", reason)
    return out.select(*models.columns, "n", "reason")

"""Rasters as pixel tables (i, j, v, and keys such as image and band): grids, gathers, resampling, masks, overviews and windows.

Masked pixels have no row or a NULL value. Gathers are equi-joins on whole coordinates, so that Catalyst
picks broadcast or shuffle by the size of the source; nothing here holds a raster in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.operators import blocks


def grid(spark: SparkSession, rows: int, cols: int, partitions: int | None = None) -> DataFrame:
    """r, c: every cell of a grid, row by row."""
    cells = spark.range(0, rows * cols, 1, partitions) if partitions else spark.range(rows * cols)
    return cells.select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))


def placed(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Adds x and y of the cells' centres."""
    return cells.withColumn("x", x0 + dx * (F.col("c") + 0.5)).withColumn("y", y0 + dy * (F.col("r") + 0.5))


def nearest(cells: DataFrame, source: DataFrame, j: Column, i: Column, by: list[str] | None = None) -> DataFrame:
    """Cells with the source's value at the pixel nearest to (j, i), half to even; cells without one are left out.

    by: columns that cells and source share, such as the image; other columns of the source, such as the band, multiply
    the cells.
    """
    by = by or []
    more = [c for c in source.columns if c not in (*by, "i", "j")]
    at = cells.withColumn("at_i", F.rint(i).cast("long")).withColumn("at_j", F.rint(j).cast("long"))
    src = source.select(*by, F.col("i").alias("at_i"), F.col("j").alias("at_j"), *more)
    return at.join(src, [*by, "at_i", "at_j"]).drop("at_i", "at_j")


def interpolated(cells: DataFrame, source: DataFrame, j: Column, i: Column, kernel: str, by: list[str] | None = None) -> DataFrame:
    """Cells with a weighted mean of the source's pixels around (j, i), in blocks: see blocks.interpolated()."""
    others = [c for c in cells.columns if c not in ("i", "j")]
    return blocks.interpolated(cells.select(*others, j.cast("double").alias("j"), i.cast("double").alias("i")), source, kernel, by)


def resampled(cells: DataFrame, source: DataFrame, j: Column, i: Column, kernel: str, by: list[str] | None = None) -> DataFrame:
    """By the nearest pixel or a kernel."""
    if kernel == "nearest":
        return nearest(cells, source, j, i, by).drop("i", "j")
    if kernel not in blocks.KERNELS:
        raise ValueError(f"Unknown kernel {kernel}: nearest, {', '.join(blocks.KERNELS)}")
    return interpolated(cells, source, j, i, kernel, by)


def overview_levels(rows: int, cols: int, most: int = 8, least_pixels: int = 256) -> int:
    """How many overviews leave the shorter side at least so many pixels."""
    short = min(rows, cols)
    return max(0, min(most, short.bit_length() - 1 - (least_pixels.bit_length() - 1)))


def overviews(source: DataFrame, levels: int, by: list[str] | None = None) -> DataFrame:
    """by, level, i, j, v: means of blocks of 2, 4, 8, ... pixels a side; each level adds up the sums of the one before."""
    by = by or []
    half = lambda c: F.shiftright(c, 1).alias(c)
    sums = source.where("v is not null").select(*by, "i", "j", F.col("v").alias("s"), F.lit(1).cast("long").alias("n"))
    out = source.limit(0).select(*by, F.lit(0).alias("level"), "i", "j", "v")
    for level in range(1, levels + 1):
        sums = sums.groupBy(*by, half("i"), half("j")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        out = out.unionByName(sums.select(*by, F.lit(level).alias("level"), "i", "j", (F.col("s") / F.col("n")).alias("v")))
    return out


def averaged(source: DataFrame, factor_i: float, factor_j: float, by: list[str] | None = None, shift_i: float = 0.0, shift_j: float = 0.0) -> DataFrame:
    """by, r, c, v: area-weighted means on a grid whose cells are so many pixels high and wide, and whose corner lies so many pixels before the source's."""
    by = by or []
    at = lambda c, s: F.col(c) + s

    def parts(c: str, f: float, s: float):
        first, last = F.floor(at(c, s) / f), F.ceil((at(c, s) + 1) / f) - 1
        return F.explode(F.sequence(first.cast("long"), last.cast("long")))

    share = lambda c, cell, f, s: F.least(at(c, s) + 1, (F.col(cell) + 1) * f) - F.greatest(at(c, s).cast("double"), F.col(cell) * f)
    cells = source.withColumn("r", parts("i", factor_i, shift_i)).withColumn("c", parts("j", factor_j, shift_j))
    cells = cells.withColumn("w", share("i", "r", factor_i, shift_i) * share("j", "c", factor_j, shift_j)).where("w > 1e-12 and v is not null")
    return cells.groupBy(*by, "r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def dilated(mask: DataFrame, reach: int, by: list[str] | None = None) -> DataFrame:
    """by, i, j, m: the maximum of a mask in a square of 2*reach+1 pixels."""
    return blocks.around(mask, reach, blocks.widest(reach), by, "m").withColumn("m", F.col("m").cast(mask.schema["m"].dataType))


def median(rows: DataFrame, value: str = "z", bins: int = 4096) -> DataFrame:
    """One row with the median of a column, NULLs left out; NULL of no rows.

    Exact without sorting all: values are counted in bins of equal width between the least and the greatest, and only
    those of the one or two bins that hold the middle are ranked. The table of counts is bounded by bins.
    """
    v = F.col(value)
    known = rows.where(v.isNotNull()).select(v.cast("double").alias("v"))
    ends = F.broadcast(known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
    bin_of = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))).cast("int")
    binned = known.join(ends).withColumn("bin", bin_of)
    upto = binned.groupBy("bin").agg(F.count("*").alias("m"), F.first("n").alias("n")).withColumn("upto", F.sum("m").over(Window.orderBy("bin")))
    # the middle one, or the two middle ones, of n values in order
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = lambda k: (k >= F.col("upto") - F.col("m")) & (k < F.col("upto"))
    chosen = upto.where(holds(low) | holds(high)).select("bin", (F.col("upto") - F.col("m")).alias("before"), low.alias("low"), high.alias("high"))
    ranked = binned.join(F.broadcast(chosen), "bin").withColumn("k", F.row_number().over(Window.partitionBy("bin").orderBy("v")) - 1 + F.col("before"))
    return ranked.where("k = low or k = high").agg(F.avg("v").alias(value))


def extremes(dem: DataFrame) -> DataFrame:
    """The lowest and highest cell with their places; of equals, the first by row, then column."""
    low, high = F.min(F.struct("z", "i", "j")).alias("low"), F.max(F.struct("z", -F.col("i"), -F.col("j"))).alias("high")
    d = dem.where("z is not null").agg(low, high)
    return d.select(F.col("low.z").alias("z_min"), F.col("low.i").alias("i_min"), F.col("low.j").alias("j_min"), F.col("high.z").alias("z_max"), (-F.col("high.col2")).alias("i_max"), (-F.col("high.col3")).alias("j_max"))


def block_windows(spark: SparkSession, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """col_off, row_off, width, height: blocks that cover a raster; those at the edges are cut."""
    c = spark.range(0, cols, width).select(F.col("id").alias("col_off"))
    r = F.explode(F.sequence(F.lit(0), F.lit(rows - 1), F.lit(height))).alias("row_off")
    return c.select("col_off", r).select("col_off", F.col("row_off").cast("long"), F.least(F.lit(width), cols - F.col("col_off")).cast("long").alias("width"), F.least(F.lit(height), rows - F.col("row_off")).cast("long").alias("height"))


def expanded(off: Column, size: Column, by: int = 0) -> tuple[Column, Column]:
    """A side of a window grown outward to whole pixels."""
    start = off - by
    return F.floor(start).cast("long"), F.ceil(size + 2 * by + (start - F.floor(start))).cast("long")


def ring_area(points: DataFrame, keys: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """keys and area of rings of points, by the shoelace formula with the last point joined to the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (x, y))
    return points.withColumn("_a", F.col(x) * ny - nx * F.col(y)).groupBy(*keys).agg((F.abs(F.sum("_a")) / 2).alias("area"))


def inside_ring(points: DataFrame, ring: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside a ring of (ord, x, y), by counting crossings; the ring is a boundary of fixed size."""
    w = Window.orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ring.select(F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1")).alias("e"))
    edges = edges.agg(F.collect_list("e").alias("_edges"))

    def crosses(e: Column) -> Column:
        spans = (e["y0"] > F.col(y)) != (e["y1"] > F.col(y))
        at = e["x0"] + (F.col(y) - e["y0"]) * F.try_divide(e["x1"] - e["x0"], e["y1"] - e["y0"])
        return spans & (F.col(x) < at)

    joined = points.withColumn("_k", F.lit(1)).join(F.broadcast(edges.withColumn("_k", F.lit(1))), "_k")
    return joined.where(F.size(F.filter("_edges", crosses)) % 2 == 1).drop("_edges", "_k")

"""Orthorectification of many images at once, from pixels, cameras and elevation to pixels on grids in the world.

cameras: a row an image (image, kind, width, height, fx, fy, cx, cy in pixels, x, y, z, omega, phi, kappa, and lens
coefficients), as frame_cameras() gives. Every step is a join or a map over tables: nothing of an image, a camera
or a raster comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import cameras as C
from terralith.functions import crs as X
from terralith.functions import inverse
from terralith.functions.num import applied, over, transposed
from terralith.operators import raster as R
from terralith.operators.ortho import ray_hits

#: Least and greatest heights on Earth above the ellipsoid: the highest mountain, and the geoid's range: fixed values.
LOWEST, HIGHEST = -106.71, 8850.0 + 82.28
#: Cells along a tile's side, and elevation cells along the side of the blocks that windows are joined by.
TILE, BLOCK = 512, 64
LENS = C.COEFFICIENTS["opencv"]


@dataclass(frozen=True)
class Grid:
    """A raster's place: the corner of its first pixel, the size of its pixels (dy is negative, north up) and its system."""

    x0: float
    y0: float
    dx: float
    dy: float
    crs: X.Crs | None = None

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Column and row of a place, whole at centres of pixels."""
        return (x - self.x0) / self.dx - 0.5, (y - self.y0) / self.dy - 0.5


class Ortho(NamedTuple):
    #: image, band, r, c, v on each image's own grid
    pixels: DataFrame
    #: image, x0, y0, res, rows, cols and reason, which says why an image gives nothing
    grids: DataFrame


def frame_cameras(rows: DataFrame, image: str = "filename") -> DataFrame:
    """Catalogue rows (kind, im_size, focal_len, sensor_size, ...) as cameras with intrinsics in pixels."""
    w, h = (F.col("im_size")[k].cast("double") for k in range(2))
    fx, fy = F.col("focal_len")[0], F.coalesce(F.get("focal_len", F.lit(1)), F.col("focal_len")[0])
    sensor = F.col("sensor_size")
    ux, uy = F.coalesce(over(w, sensor[0]), w), F.coalesce(over(h, sensor[1]), w)
    centre = lambda n, c: (n - 1) / 2 + F.greatest(w, h) * F.coalesce(F.col(c), F.lit(0.0))
    lens = [F.col(k) if k in rows.columns else F.lit(None).cast("double").alias(k) for k in LENS]
    return rows.select(F.col(image).alias("image"), "kind", w.alias("width"), h.alias("height"), (fx * ux).alias("fx"), (fy * uy).alias("fy"), centre(w, "cx").alias("cx"), centre(h, "cy").alias("cy"), "x", "y", "z", "omega", "phi", "kappa", *lens)


def _lens() -> dict[str, Column]:
    return {k: F.coalesce(F.col(k), F.lit(0.0)) for k in LENS}


def _intrinsic() -> C.Intrinsic:
    return C.Intrinsic(*(F.col(c) for c in ("fx", "fy", "cx", "cy")))


def _pose() -> C.Pose:
    return C.pose(*(F.col(c) for c in ("x", "y", "z", "omega", "phi", "kappa")))


def with_rays(cameras: DataFrame, points: int = 8) -> DataFrame:
    """A row for each camera and boundary pixel (ord) with its ray: u, v ahead of the camera and rx, ry, rz in the world.

    Points go around clockwise, as many on each side.
    """
    each = max(1, points // 4)
    k, side = (F.col("ord") % each) / each, F.floor(F.col("ord") / each)
    w, h = F.col("width") - 1, F.col("height") - 1
    j = F.when(side == 0, w * k).when(side == 1, w).when(side == 2, w * (1 - k)).otherwise(0.0)
    i = F.when(side == 0, 0.0).when(side == 1, h * k).when(side == 2, h).otherwise(h * (1 - k))
    rows = cameras.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4 * each - 1))))
    rows = rows.withColumn("uv", inverse.undistorted_each(F.col("kind"), _lens(), (j - F.col("cx")) / F.col("fx"), (i - F.col("cy")) / F.col("fy")))
    ray = applied(_pose().rotation, [F.col("uv.u"), F.col("uv.v"), F.lit(1.0)])
    return rows.select(*cameras.columns, "ord", F.col("uv.u").alias("u"), F.col("uv.v").alias("v"), *(r.alias(n) for r, n in zip(ray, ("rx", "ry", "rz"), strict=True)))


def ground(rays: DataFrame, height: Column) -> DataFrame:
    """Rays with gx and gy: where each meets a height, at most the camera's own."""
    s = over(F.least(height, F.col("z")) - F.col("z"), F.col("rz"))
    return rays.withColumns({"gx": F.col("x") + F.col("rx") * s, "gy": F.col("y") + F.col("ry") * s})


def _bounds(rays: DataFrame, heights: list[Column]) -> DataFrame:
    """image and the bounds (bx0, by0, bx1, by1) of its boundary at some heights."""
    at = ground(rays.withColumn("height", F.explode(F.array(*heights))), F.col("height"))
    return at.groupBy("image").agg(F.min("gx").alias("bx0"), F.min("gy").alias("by0"), F.max("gx").alias("bx1"), F.max("gy").alias("by1"))


def _to(crs: X.Crs | None, other: X.Crs | None, x: Column, y: Column) -> tuple[Column, Column]:
    if crs is None or other is None or crs == other:
        return x, y
    return X.forward(other, *X.back(crs, x, y))


def dem_windows(bounds: DataFrame, dem: DataFrame, grid: Grid, crs: X.Crs | None) -> DataFrame:
    """image, and the least, greatest and middle height (low, high, mid) of elevation cells within its bounds.

    Windows meet elevation cells on the blocks that they cover, so that an image reads no others. The middle is within
    a ten-thousandth in rank.
    """
    edges = [(F.col(f"bx{a}"), F.col(f"by{b}")) for a in range(2) for b in range(2)]
    places = [grid.pixel(*_to(crs, grid.crs, x, y)) for x, y in edges]
    js, is_ = ([p[k] for p in places] for k in range(2))
    w = bounds.select("image", *(f(*v).alias(n) for n, f, v in (("j0", F.least, js), ("j1", F.greatest, js), ("i0", F.least, is_), ("i1", F.greatest, is_))))
    w = w.join(F.broadcast(dem.agg(F.min("i").alias("di0"), F.max("i").alias("di1"), F.min("j").alias("dj0"), F.max("j").alias("dj1"))))
    # a cell more on each side, cut at the raster's edges
    w = w.select("image", *(F.greatest(F.floor(f"{c}0") - 1, F.col(f"d{c}0")).cast("long").alias(f"{c}0") for c in "ij"), *(F.least(F.ceil(f"{c}1") + 1, F.col(f"d{c}1")).cast("long").alias(f"{c}1") for c in "ij")).where("i0 <= i1 and j0 <= j1")
    for c in "ij":
        w = w.withColumn(f"b{c}", F.explode(F.expr(f"sequence({c}0 div {BLOCK}, {c}1 div {BLOCK})")))
    cells = dem.where("z is not null").select("i", "j", "z", F.expr(f"i div {BLOCK}").alias("bi"), F.expr(f"j div {BLOCK}").alias("bj"))
    inside = w.join(cells, ["bi", "bj"]).where("i between i0 and i1 and j between j0 and j1")
    return inside.groupBy("image").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.percentile_approx("z", 0.5, 10_000).alias("mid"))


def grids(cameras: DataFrame, dem: DataFrame, dem_grid: Grid, crs: X.Crs | None = None, resolution: float | None = None) -> DataFrame:
    """image, x0, y0, res, rows, cols, reason: a grid for each image that holds its bounds at all heights below it.

    Corners are whole multiples of the resolution; without one, it is the ground size of a pixel at the middle height.
    An image that sees the horizon, lies outside the elevation raster or is smaller than a cell has a reason and no grid.
    """
    rays = with_rays(cameras)
    level = rays.groupBy("image").agg(F.bool_or(F.col("rz") >= 0).alias("horizon"))
    down = rays.join(level.where("not horizon").select("image"), "image")
    wide = _bounds(down, [F.lit(LOWEST), F.lit(HIGHEST)])
    seen = dem_windows(wide, dem, dem_grid, crs)
    known = down.join(seen, "image")
    bounds = _bounds(known, [F.col("low"), F.col("high")])
    area = R.ring_area(ground(known, F.col("mid")), ["image"], "ord", "gx", "gy")
    size = cameras.select("image", ((F.col("width") - 1) * (F.col("height") - 1)).alias("px"))
    out = cameras.select("image").join(level, "image", "left").join(bounds, "image", "left").join(area.join(size, "image").select("image", F.sqrt(F.col("area") / F.col("px")).alias("gsd")), "image", "left")
    res = F.lit(float(resolution)) if resolution else F.col("gsd")
    out = out.withColumn("res", res)
    small = (F.col("bx1") - F.col("bx0") < F.col("res")) | (F.col("by1") - F.col("by0") < F.col("res"))
    reason = F.when(F.col("horizon"), "sees the horizon").when(F.col("bx0").isNull(), "lies outside the elevation raster").when(small, "is smaller than a cell")
    out = out.withColumn("reason", F.when(reason.isNotNull(), F.concat(F.col("image").cast("string"), F.lit(" "), reason)))
    ok = F.col("reason").isNull()
    first, last = F.floor(F.col("bx0") / F.col("res")), F.ceil(F.col("bx1") / F.col("res"))
    top, low = F.ceil(F.col("by1") / F.col("res")), F.floor(F.col("by0") / F.col("res"))
    return out.select("image", F.when(ok, first * F.col("res")).alias("x0"), F.when(ok, top * F.col("res")).alias("y0"), F.when(ok, F.col("res")).alias("res"), F.when(ok, top - low).cast("long").alias("rows"), F.when(ok, last - first).cast("long").alias("cols"), "reason")


def cells_of(made: DataFrame, tile: int = TILE) -> DataFrame:
    """image, tile_r, tile_c, r, c, wx, wy: the cells of grids, tile by tile, with their centres."""
    g = made.where("reason is null")
    count = lambda n: F.expr(f"sequence(0, ({n} - 1) div {tile})")
    t = g.withColumn("tile_r", F.explode(count("rows"))).withColumn("tile_c", F.explode(count("cols")))
    along = lambda t, n: F.expr(f"sequence({t} * {tile}, least({t} * {tile} + {tile}, {n}) - 1)")
    t = t.repartition("image", "tile_r", "tile_c").withColumn("r", F.explode(along("tile_r", "rows"))).withColumn("c", F.explode(along("tile_c", "cols")))
    return t.select("image", "tile_r", "tile_c", "r", "c", (F.col("x0") + F.col("res") * (F.col("c") + 0.5)).alias("wx"), (F.col("y0") - F.col("res") * (F.col("r") + 0.5)).alias("wy"))


def heights(cells: DataFrame, dem: DataFrame, grid: Grid, crs: X.Crs | None, kernel: str = "bilinear") -> DataFrame:
    """Cells with wz, the elevation at each, in the world's units; cells beyond the elevation raster are left out."""
    j, i = grid.pixel(*_to(crs, grid.crs, F.col("wx"), F.col("wy")))
    at = cells.withColumns({"j": j, "i": i})
    out = R.resampled(at, dem.where("z is not null").select("i", "j", F.col("z").alias("v")), F.col("j"), F.col("i"), kernel)
    scale = (grid.crs.z_scale if grid.crs else 1.0) / (crs.z_scale if crs else 1.0)
    return out.withColumnRenamed("v", "wz").withColumn("wz", F.col("wz") * scale)


def projected(cells: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cells (image, wx, wy, wz) with the pixel (j, i) at which their image shows them; others are left out.

    A camera shows what lies ahead of it within its boundary: distortion may fold what lies far outside into the image.
    """
    edge = with_rays(cameras, 32).groupBy("image").agg(*(f(c).alias(f"{c}{n}") for c in "uv" for n, f in ((0, F.min), (1, F.max))))
    rows = cells.join(cameras.join(edge, "image"), "image")
    ahead = applied(transposed(_pose().rotation), [F.col("wx") - F.col("x"), F.col("wy") - F.col("y"), F.col("wz") - F.col("z")])
    rows = rows.withColumns({"px": ahead[0], "py": ahead[1], "pz": ahead[2]}).where("pz > 0")
    rows = rows.withColumns({"pu": F.col("px") / F.col("pz"), "pv": F.col("py") / F.col("pz")})
    slack = 1e-9
    rows = rows.where((F.col("pu") >= F.col("u0") - slack) & (F.col("pu") <= F.col("u1") + slack) & (F.col("pv") >= F.col("v0") - slack) & (F.col("pv") <= F.col("v1") + slack))
    j = i = F.lit(None).cast("double")
    for kind in C.COEFFICIENTS:
        bent = C.Frame(_intrinsic(), _pose(), kind, _lens()).distorted(F.col("pu"), F.col("pv"))
        a, b = C.pixel(_intrinsic(), *bent)
        here = F.col("kind") == kind
        j, i = F.when(here, a).otherwise(j), F.when(here, b).otherwise(i)
    return rows.withColumns({"j": j, "i": i}).select(*cells.columns, "j", "i")


def orthorectify(images: DataFrame, cameras: DataFrame, dem: DataFrame, dem_grid: Grid, crs: X.Crs | None = None, resolution: float | None = None, kernel: str = "cubic", dem_kernel: str = "cubic", tile: int = TILE) -> Ortho:
    """Pixels (image, band, i, j, v) of images on grids in the world, by cameras and an elevation raster (i, j, z).

    All bands of a cell go in one pass. A cell without elevation, or that its image doesn't show, is left out.
    """
    made = grids(cameras, dem, dem_grid, crs, resolution)
    cells = heights(cells_of(made, tile), dem, dem_grid, crs, dem_kernel)
    seen = projected(cells, cameras)
    keep = seen.select("image", "r", "c", "j", "i")
    return Ortho(R.resampled(keep, images, F.col("j"), F.col("i"), kernel, ["image"]), made)


def rpc_grids(models: DataFrame, crs: X.Crs, resolution: float | None = None) -> DataFrame:
    """image, x0, y0, res, rows, cols, reason: a grid for each model (image, im_size, rpc) over the region it is normalised for.

    Without a resolution it is the root of the region's area over that of the pixels it is normalised to.
    """
    lon, lat = (F.array(F.col(f"rpc.{n}_off") - F.col(f"rpc.{n}_scale"), F.col(f"rpc.{n}_off") + F.col(f"rpc.{n}_scale")) for n in ("long", "lat"))
    edges = [X.forward(crs, lon[a], lat[b]) for a in range(2) for b in range(2)]
    xs, ys = ([e[k] for e in edges] for k in range(2))
    b = models.select("image", "rpc", F.least(*xs).alias("bx0"), F.greatest(*xs).alias("bx1"), F.least(*ys).alias("by0"), F.greatest(*ys).alias("by1"))
    gsd = F.sqrt((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) / (4 * F.col("rpc.samp_scale") * F.col("rpc.line_scale")))
    b = b.withColumn("res", F.lit(float(resolution)) if resolution else gsd)
    first, top = F.floor(F.col("bx0") / F.col("res")), F.ceil(F.col("by1") / F.col("res"))
    rows, cols = (top - F.floor(F.col("by0") / F.col("res"))).cast("long"), (F.ceil(F.col("bx1") / F.col("res")) - first).cast("long")
    return b.select("image", (first * F.col("res")).alias("x0"), (top * F.col("res")).alias("y0"), "res", rows.alias("rows"), cols.alias("cols"), F.lit(None).cast("string").alias("reason"))


def rpc_projected(cells: DataFrame, models: DataFrame, crs: X.Crs) -> DataFrame:
    """Cells (image, wx, wy, wz) with the pixel (j, i) by their image's rational polynomials, of those within the image."""
    lon, lat = X.back(crs, F.col("wx"), F.col("wy"))
    rows = cells.withColumns({"lon": lon, "lat": lat}).join(models.select("image", "im_size", "rpc"), "image")
    j, i = C.rpc_to_pixel(F.col("rpc"), F.col("lon"), F.col("lat"), F.col("wz") * crs.z_scale)
    rows = rows.withColumns({"j": j, "i": i})
    inside = F.col("j").between(-0.5, F.col("im_size")[0] - 0.5) & F.col("i").between(-0.5, F.col("im_size")[1] - 0.5)
    return rows.where(inside).select(*cells.columns, "j", "i")


def orthorectify_rpc(images: DataFrame, models: DataFrame, dem: DataFrame, dem_grid: Grid, crs: X.Crs, resolution: float | None = None, kernel: str = "cubic", dem_kernel: str = "cubic", tile: int = TILE) -> Ortho:
    """The same for images whose cameras are rational polynomial models."""
    made = rpc_grids(models, crs, resolution)
    seen = rpc_projected(heights(cells_of(made, tile), dem, dem_grid, crs, dem_kernel), models, crs)
    return Ortho(R.resampled(seen.select("image", "r", "c", "j", "i"), images, F.col("j"), F.col("i"), kernel, ["image"]), made)


def on_surface(rays: DataFrame, dem: DataFrame, grid: Grid, top: float, low: float, steps: int) -> DataFrame:
    """image, ord, x, y, hit: where boundary rays, followed down from one height to another in steps, first meet the elevation raster.

    A ray that meets it nowhere gives its lowest point.
    """
    down = over(F.lit((low - top) / steps), F.col("rz"))
    start = over(F.lit(top) - F.col("z"), F.col("rz"))
    from_top = rays.select(F.struct("image", "ord").alias("id"), (F.col("x") + F.col("rx") * start).alias("x"), (F.col("y") + F.col("ry") * start).alias("y"), F.lit(float(top)).alias("z"), (F.col("rx") * down).alias("dx"), (F.col("ry") * down).alias("dy"), F.lit((low - top) / steps).alias("dz"))
    met = ray_hits(from_top, dem, steps, lambda x, y: F.rint(grid.pixel(x, y)[1]), lambda x, y: F.rint(grid.pixel(x, y)[0]))
    return met.select("id.image", "id.ord", "x", "y", "hit")

"""Queries on rasters: orthorectification, resampling, masks, windows and elevation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.num import shown, to_dtype
from terralith.operators import boundary as B
from terralith.operators import ortho as O
from terralith.operators import orthorectify as ORTHO
from terralith.operators import raster as R
from terralith.operators import undistort as U
from terralith.plans import views as V
from terralith.plans.cameras import BROWN_SQL, BROWN_STEP, CAM, GRID81, K, PAIRS, POSE, RECT, RECT_PARTS, ROT, STRAIGHT, iterated_sql, lens
from terralith.functions import cameras as C
from terralith.plans.catalog import query
from terralith.sources import files, sinks, store

L = lambda c: F.col(c).cast("long").alias(c)
#: The ortho grid of an image: 60 x 64 cells of 4 m, north up, below the camera.
GRID = {"rows": 60, "cols": 64, "x0": 19880.0, "y0": 30120.0, "dx": 4.0, "dy": -4.0}
CELLS = "select r, c, 19880.0::double + 4.0::double * (c + 0.5::double) as x, 30120.0::double - 4.0::double * (r + 0.5::double) as y from (select unnest(range(0, 60)) as r), (select unnest(range(0, 64)) as c)"
#: Heights of an image's grid come from the elevation raster's pixels beside the image's rows.
Z = "select d.i // 150 as image, r, c, x, y, z from cells join v_dem d on d.i % 150 = r and d.j = c"
SHOT = "select image, r, c, (r00*(x-tx)+r10*(y-ty)+r20*(z-tz)) as a, (r01*(x-tx)+r11*(y-ty)+r21*(z-tz)) as b, (r02*(x-tx)+r12*(y-ty)+r22*(z-tz)) as w, fx, fy, cx, cy from cz, cam"
PXS = "select image, r, c, fx*(a/w)+cx as j, fy*(b/w)+cy as i from shot"
#: The raster is a pile of images of 150 rows and 64 columns with two bands; pixel columns beyond them are masked.
IMAGE = "select i // 150 as image, band, i % 150 as i, j, case when band = 1 then v else 2 * v + 1 end as v from v_raster, (values (1), (2)) as b(band)"
GRID_PARTS = {"cells": CELLS, "rot": ROT, "cam": CAM, "cz": Z, "shot": SHOT, "px": PXS, "image": IMAGE}


def image(spark: SparkSession, sf: str) -> DataFrame:
    """image, band, i, j, v: all images of the raster."""
    rows = V.raster(spark, sf).select(F.expr("i div 150").alias("image"), (F.col("i") % 150).alias("i"), "j", "v")
    both = F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("v").alias("v")), F.struct(F.lit(2).alias("band"), (2 * F.col("v") + 1).alias("v"))))
    return rows.withColumn("b", both).select("image", "b.band", "i", "j", "b.v")


def cells_in_pixels(spark: SparkSession, sf: str, kind: str = "pinhole", d: dict | None = None) -> DataFrame:
    """image, r, c, j, i: where each cell of each image's grid lies in it."""
    cells = R.placed(R.grid(spark, GRID["rows"], GRID["cols"]), GRID["x0"], GRID["y0"], GRID["dx"], GRID["dy"])
    heights = V.dem(spark, sf).select(F.expr("i div 150").alias("image"), (F.col("i") % 150).alias("i"), "j", "z")
    return O.seen(O.with_heights(cells, heights, ["image"]), C.Frame(K, POSE, kind, d or {})).select("image", "r", "c", "j", "i")


def _ortho(value_sql: str) -> str:
    return V.sql(value_sql, "v_raster", "v_dem", **GRID_PARTS)


NEAREST = "px join image on image.image = px.image and image.i = round_even(px.i, 0)::bigint and image.j = round_even(px.j, 0)::bigint"


@query("ortho_nearest", _ortho(f"select px.image::bigint as image, band::integer as band, r::bigint as r, c::bigint as c, v from {NEAREST}"))
def ortho_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Orthorectification of all images: grid, heights, projection through the camera, gather of the nearest pixel of all bands."""
    out = R.nearest(cells_in_pixels(spark, sf), image(spark, sf), F.col("j"), F.col("i"), ["image"])
    return out.select(L("image"), "band", L("r"), L("c"), "v")


@query("ortho_tiles", _ortho(f"select px.image::bigint as image, band::integer as band, (r // 16)::bigint as tile_r, (c // 16)::bigint as tile_c, count(*)::bigint as n, round(avg(v), 9) + 0.0 as mean from {NEAREST} group by 1, 2, 3, 4"))
def ortho_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """What each tile of the ortho images holds."""
    out = ortho_nearest(spark, sf).groupBy("image", "band", F.expr("r div 16").alias("tile_r"), F.expr("c div 16").alias("tile_c"))
    return out.agg(F.count("*").alias("n"), shown(F.avg("v"), 9).alias("mean"))


#: Places at fractions of pixels for the resampling queries.
TAPS = "select id, id % (select max(vec_id) // 150 + 1 from embeddings) as image, (id * 37 % 6100) * 0.01::double as j, (id * 53 % 14700) * 0.01::double as i from v_world"


def taps(spark: SparkSession, sf: str) -> DataFrame:
    images = V.table(spark, sf, "embeddings").agg(F.expr("max(vec_id) div 150 + 1")).first()[0]
    e = F.col("id")
    return V.world(spark, sf).select(L("id"), (e % images).cast("long").alias("image"), ((e * 37 % 6100) * 0.01).alias("j"), ((e * 53 % 14700) * 0.01).alias("i"))


@query("remap_nearest", V.sql("select id::bigint as id, band::integer as band, v from taps join image on image.image = taps.image and image.i = round_even(taps.i, 0)::bigint and image.j = round_even(taps.j, 0)::bigint", "v_world", "v_raster", taps=TAPS, image=IMAGE))
def remap_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest(taps(spark, sf), image(spark, sf), F.col("j"), F.col("i"), ["image"]).select("id", "band", "v")


BI = "greatest(0, 1 - abs(t.j - p.j)) * greatest(0, 1 - abs(t.i - p.i))"
CU = "(case when {d} <= 1 then (1.25::double*{d} - 2.25::double)*{d}*{d} + 1 when {d} < 2 then ((-0.75::double*{d} + 3.75::double)*{d} - 6)*{d} + 3 else 0 end)"
CUBIC = CU.format(d="abs(t.j - p.j)") + "*" + CU.format(d="abs(t.i - p.i)")


LANCZOS = "(case when {d} < 1e-12::double then 1 when {d} < 4 then 4 * sin(pi() * {d}) * sin(pi() * {d} / 4) / (pi() * pi() * {d} * {d}) else 0 end)"
LANCZOS_2D = LANCZOS.format(d="abs(t.j - p.j)") + "*" + LANCZOS.format(d="abs(t.i - p.i)")


def _kernel_sql(weight: str, reach: int, keys: str = "id", places: str = "taps", *views: str, **parts: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    spread = f"select t.*, floor(t.i)::bigint + di as pi, floor(t.j)::bigint + dj as pj from {places} t, (select unnest(range({1 - reach}, {reach + 1})) as di) a, (select unnest(range({1 - reach}, {reach + 1})) as dj) b"
    return V.sql(
        f"select {', '.join(f'{k}::bigint as {k}' for k in names)}, band::integer as band, round(sum(v * w) / sum(w), 6) + 0.0 as v from (select {', '.join(f't.{k}' for k in names)}, band, v, {weight} as w from spread t join image p on p.image = t.image and p.i = t.pi and p.j = t.pj) group by {keys}, band having count(*) = {4 * reach * reach}",
        "v_world", "v_raster", *views, **({"taps": TAPS, "image": IMAGE} | parts | {"spread": spread}),
    )


def _remap(kernel: str, digits: int = 6):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = R.interpolated(taps(spark, sf), image(spark, sf), F.col("j"), F.col("i"), kernel, ["image"])
        return out.select("id", "band", shown(F.col("v"), digits).alias("v"))

    return run


query("remap_bilinear", _kernel_sql(BI, 1))(_remap("bilinear"))
query("remap_cubic", _kernel_sql(CUBIC, 2))(_remap("cubic"))
query("remap_lanczos", _kernel_sql(LANCZOS_2D, 4))(_remap("lanczos"))


@query("ortho_bilinear", _kernel_sql(BI, 1, "image, r, c", "px", "v_dem", **GRID_PARTS))
def ortho_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    out = R.interpolated(cells_in_pixels(spark, sf), image(spark, sf), F.col("j"), F.col("i"), "bilinear", ["image"])
    return out.select(L("image"), L("r"), L("c"), "band", shown(F.col("v")).alias("v"))


@query("remap_mask", V.sql("select i::bigint as i, j::bigint as j, bool_and(v is null) as masked from (select i, j, 1 as band, case when v > -0.1 then v end as v from v_raster union all select i, j, 2, case when v < 0.05 then v end from v_raster union all select i, j, 3, case when v > 0.3 or v < -0.3 then v end from v_raster) group by i, j", "v_raster"))
def remap_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel is masked where all bands are."""
    v = F.col("v")
    bands = F.array(F.when(v > -0.1, v), F.when(v < 0.05, v), F.when((v > 0.3) | (v < -0.3), v))
    return V.raster(spark, sf).select(L("i"), L("j"), F.explode(bands).alias("v")).groupBy("i", "j").agg(F.bool_and(F.col("v").isNull()).alias("masked"))


@query("mask_dilate", V.sql("select a.i::bigint as i, a.j::bigint as j, max(b.m)::integer as m from m a join (select i + di as i, j + dj as j, m from m, (select unnest(range(-1, 2)) as di), (select unnest(range(-1, 2)) as dj)) b on a.i = b.i and a.j = b.j group by 1, 2", "v_raster", m="select i, j, case when v < -0.2 then 1 else 0 end as m from v_raster"))
def mask_dilate(spark: SparkSession, sf: str) -> DataFrame:
    return R.dilated(V.raster(spark, sf).select(L("i"), L("j"), F.when(F.col("v") < -0.2, 1).otherwise(0).alias("m")), 1)


@query("mask_crop", V.sql("select min(i)::bigint as i0, max(i)::bigint as i1, min(j)::bigint as j0, max(j)::bigint as j1 from v_raster where v > 0.35", "v_raster"))
def mask_crop(spark: SparkSession, sf: str) -> DataFrame:
    return V.raster(spark, sf).where("v > 0.35").agg(*(f(c).cast("long").alias(f"{c}{n}") for c in "ij" for n, f in ((0, F.min), (1, F.max))))


@query("mask_and", V.sql("select i::bigint as i, j::bigint as j from v_raster where v > 0 and v < 0.1", "v_raster"))
def mask_and(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels valid in both masks."""
    r = V.raster(spark, sf)
    return r.where("v > 0").select(L("i"), L("j")).join(r.where("v < 0.1").select(L("i"), L("j")), ["i", "j"])


@query("overviews", V.sql(" union all ".join(f"select {k}::integer as level, (i // {1 << k})::bigint as i, (j // {1 << k})::bigint as j, round(avg(v), 9) + 0.0 as v from v_raster group by 2, 3" for k in (1, 2, 3)), "v_raster"))
def overviews(spark: SparkSession, sf: str) -> DataFrame:
    return R.overviews(V.raster(spark, sf), 3).select("level", L("i"), L("j"), shown(F.col("v"), 9).alias("v"))


WARP = "select r::bigint as r, c::bigint as c, round(sum(v * w) / sum(w), 9) + 0.0 as v from (select v, r, c, greatest(0, least(i + 1, (r + 1) * 2.5::double) - greatest(i, r * 2.5::double)) * greatest(0, least(j + 1, (c + 1) * 2.5::double) - greatest(j, c * 2.5::double)) as w from v_raster, (select unnest(range(0, 2)) as dr), (select unnest(range(0, 2)) as dc), lateral (select floor(i / 2.5::double)::bigint + dr as r, floor(j / 2.5::double)::bigint + dc as c)) where w > 1e-12 group by r, c"


@query("warp_avg", V.sql(WARP, "v_raster"))
def warp_avg(spark: SparkSession, sf: str) -> DataFrame:
    return R.averaged(V.raster(spark, sf), 2.5, 2.5).select(L("r"), L("c"), shown(F.col("v"), 9).alias("v"))


@query("scan_bands", V.sql("select band::integer as band, i::bigint as i, j::bigint as j, round_even(v * 1000, 0)::integer as v from (select 1 + (i % 3) as band, i // 3 as i, j, v from v_raster) where band in (1, 3)", "v_raster"))
def scan_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen bands, read as another type."""
    bands = V.raster(spark, sf).select((F.col("i") % 3 + 1).cast("int").alias("band"), F.expr("i div 3").alias("i"), L("j"), "v")
    return bands.where(F.col("band").isin(1, 3)).select("band", "i", "j", F.rint(F.col("v") * 1000).cast("int").alias("v"))


@query("convert_dtype", V.sql("select i::bigint as i, j::bigint as j, least(255, greatest(0, round_even(v * 600 + 100.5::double, 0)))::smallint as u8, least(32767, greatest(-32768, round_even(v * 1e5::double, 0)))::smallint as i16 from v_raster", "v_raster"))
def convert_dtype(spark: SparkSession, sf: str) -> DataFrame:
    return V.raster(spark, sf).select(L("i"), L("j"), to_dtype(F.col("v") * 600 + 100.5, "uint8").alias("u8"), to_dtype(F.col("v") * 1e5, "int16").alias("i16"))


@query("dem_minmax", V.sql("select min(z) as z_min, max(z) as z_max from v_dem", "v_dem"))
def dem_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return V.dem(spark, sf).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("dem_median", V.sql("select round(median(z), 9) + 0.0 as z from v_dem", "v_dem"))
def dem_median(spark: SparkSession, sf: str) -> DataFrame:
    return R.median(V.dem(spark, sf)).select(shown(F.col("z"), 9).alias("z"))


@query("dem_argminmax", V.sql("select a.z as z_min, a.i::bigint as i_min, a.j::bigint as j_min, b.z as z_max, b.i::bigint as i_max, b.j::bigint as j_max from (select * from v_dem order by z, i, j limit 1) a, (select * from v_dem order by z desc, i, j limit 1) b", "v_dem"))
def dem_argminmax(spark: SparkSession, sf: str) -> DataFrame:
    return R.extremes(V.dem(spark, sf)).select("z_min", L("i_min"), L("j_min"), "z_max", L("i_max"), L("j_max"))


@query("dem_coverage", V.sql("select count(*)::bigint as n, sum(case when z > 826 then 1 else 0 end)::bigint as valid, round(sum(case when z > 826 then 1 else 0 end) / count(*), 9) + 0.0 as share from v_dem", "v_dem"))
def dem_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return V.dem(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("z") > 826).alias("valid"), shown(F.count_if(F.col("z") > 826) / F.count("*"), 9).alias("share"))


@query("dem_window", V.sql("select i::bigint as i, j::bigint as j, z from v_dem, w where i between i0 and i1 and j between j0 and j1", "v_dem", "v_world", w="select min(i)::bigint as i0, max(i)::bigint as i1, min(j)::bigint as j0, max(j)::bigint as j1 from (select floor((30120 - y) / 4)::bigint as i, floor((x - 19880) / 4)::bigint as j from v_world where z > 100)"))
def dem_window(spark: SparkSession, sf: str) -> DataFrame:
    """Only the cells within what can matter: the bounds are numbers by the time the raster is read, so that the scan prunes."""
    bounds = V.world(spark, sf).where("z > 100").agg(*(f(F.floor(e)).alias(n) for n, f, e in (("i0", F.min, (30120 - F.col("y")) / 4), ("i1", F.max, (30120 - F.col("y")) / 4), ("j0", F.min, (F.col("x") - 19880) / 4), ("j1", F.max, (F.col("x") - 19880) / 4)))).first()
    if bounds["i0"] is None:
        return V.dem(spark, sf).limit(0)
    return V.dem(spark, sf).where(F.col("i").between(bounds["i0"], bounds["i1"]) & F.col("j").between(bounds["j0"], bounds["j1"])).select(L("i"), L("j"), "z")


@query("block_windows", "select col_off::bigint as col_off, row_off::bigint as row_off, least(300, 1000 - col_off)::bigint as width, least(256, 700 - row_off)::bigint as height from (select unnest(range(0, 1000, 300)) as col_off), (select unnest(range(0, 700, 256)) as row_off)")
def block_windows(spark: SparkSession, sf: str) -> DataFrame:
    return R.block_windows(spark, 700, 1000, 256, 300)


@query("window_expand", V.sql("select id::bigint as id, floor(x / 7 - 2)::bigint as off, ceil(z / 3 + 4 + (x / 7 - 2 - floor(x / 7 - 2)))::bigint as size from v_world", "v_world"))
def window_expand(spark: SparkSession, sf: str) -> DataFrame:
    off, size = R.expanded(F.col("x") / 7, F.col("z") / 3, 2)
    return V.world(spark, sf).select(L("id"), off.alias("off"), size.alias("size"))


@query("window_intersect", V.sql("select id::bigint as id, greatest(x - 50, 19900) as x0, least(x + 50, 20100) as x1, greatest(y - 20, 29950) as y0, least(y + 20, 30050) as y1 from v_world where greatest(x - 50, 19900) < least(x + 50, 20100) and greatest(y - 20, 29950) < least(y + 20, 30050)", "v_world"))
def window_intersect(spark: SparkSession, sf: str) -> DataFrame:
    w = V.world(spark, sf).select(L("id"), F.greatest(F.col("x") - 50, F.lit(19900.0)).alias("x0"), F.least(F.col("x") + 50, F.lit(20100.0)).alias("x1"), F.greatest(F.col("y") - 20, F.lit(29950.0)).alias("y0"), F.least(F.col("y") + 20, F.lit(30050.0)).alias("y1"))
    return w.where("x0 < x1 and y0 < y1")


RING = "select o_custkey as k, o_orderkey as ord, 100.0::double + (o_orderkey * 13) % 97 as x, 50.0::double + (o_orderkey * 29) % 89 as y from orders"


@query("poly_area", V.sql("select k::bigint as k, round(abs(sum(x * ny - nx * y)) / 2, 6) + 0.0 as area from (select k, x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from ring window w as (partition by k order by ord)) group by k", ring=RING))
def poly_area(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    ring = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), o.alias("ord"), (100.0 + (o * 13) % 97).alias("x"), (50.0 + (o * 29) % 89).alias("y"))
    return R.ring_area(ring, ["k"], "ord").select(L("k"), shown(F.col("area")).alias("area"))


BOUNDS = "select * from (values (0, 0.0::double, 0.0::double), (1, 99.5, 0.0), (2, 199.0, 0.0), (3, 199.0, 74.5), (4, 199.0, 149.0), (5, 99.5, 149.0), (6, 0.0, 149.0), (7, 0.0, 74.5)) as t(ord, j, i)"
WORLD_RING = "select ord, tx+(r00*u+r01*v+r02)*({z}-tz)/(r20*u+r21*v+r22) as x, ty+(r10*u+r11*v+r12)*({z}-tz)/(r20*u+r21*v+r22) as y from (select ord, (j-cx)/fx as u, (i-cy)/fy as v, cam.* from b, cam)"
GSD_PARTS = {"rot": ROT, "cam": CAM, "b": BOUNDS, "mid": "select median(z) as z from v_dem", "wr": WORLD_RING.format(z="(select z from mid)")}


def world_ring(spark: SparkSession, z) -> DataFrame:
    x, y = C.Frame(K, POSE).pixel_to_world(F.col("j"), F.col("i"), z)
    return B.pixel_boundary(spark, *V.SIZE).select("ord", x.alias("x"), y.alias("y"))


@query("gsd", V.sql("select round(sqrt(abs(sum(x * ny - nx * y)) / 2 / (199.0::double * 149)), 9) + 0.0 as gsd from (select x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from wr window w as (order by ord))", "v_dem", **GSD_PARTS))
def gsd(spark: SparkSession, sf: str) -> DataFrame:
    """Ground size of a pixel: the root of the boundary's area in the world, at the median height, over that in pixels."""
    mid = R.median(V.dem(spark, sf)).first()["z"]
    world, px = (R.ring_area(r.withColumn("k", F.lit(0)), ["k"], "ord", *c) for r, c in ((world_ring(spark, mid), "xy"), (B.pixel_boundary(spark, *V.SIZE), "ji")))
    return world.join(px.withColumnRenamed("area", "px"), "k").select(shown(F.sqrt(F.col("area") / F.col("px")), 9).alias("gsd"))


@query("world_bounds", V.sql("select round(min(x), 6) + 0.0 as x0, round(max(x), 6) + 0.0 as x1, round(min(y), 6) + 0.0 as y0, round(max(y), 6) + 0.0 as y1 from wr", "v_dem", **GSD_PARTS))
def world_bounds(spark: SparkSession, sf: str) -> DataFrame:
    mid = R.median(V.dem(spark, sf)).first()["z"]
    return world_ring(spark, mid).agg(*(shown(f(c)).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))))


CROSS = "select r::bigint as r, c::bigint as c from cells where (select count(*) from e where (y0 > y) <> (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1"


@query("mask_dem", V.sql(CROSS, rot=ROT, cam=CAM, b=BOUNDS, wr=WORLD_RING.format(z="825.0::double"), e="select x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from wr window w as (order by ord)", cells=CELLS))
def mask_dem(spark: SparkSession, sf: str) -> DataFrame:
    """Cells inside the camera's boundary on the ground."""
    cells = R.placed(R.grid(spark, GRID["rows"], GRID["cols"]), GRID["x0"], GRID["y0"], GRID["dx"], GRID["dy"])
    return R.inside_ring(cells, world_ring(spark, 825.0)).select(L("r"), L("c"))


@query("tile_dem", V.sql("select (r // 16)::bigint as tile_r, (c // 16)::bigint as tile_c, image::bigint as image, round(avg(z), 9) + 0.0 as z from cz group by 1, 2, 3", "v_dem", cells=CELLS, cz=Z))
def tile_dem(spark: SparkSession, sf: str) -> DataFrame:
    cells = R.placed(R.grid(spark, GRID["rows"], GRID["cols"]), GRID["x0"], GRID["y0"], GRID["dx"], GRID["dy"])
    heights = V.dem(spark, sf).select(F.expr("i div 150").alias("image"), (F.col("i") % 150).alias("i"), "j", "z")
    return O.with_heights(cells, heights, ["image"]).groupBy(L("image"), F.expr("r div 16").alias("tile_r"), F.expr("c div 16").alias("tile_c")).agg(shown(F.avg("z"), 9).alias("z"))


RAY = """select id::bigint as id, coalesce(first, 80)::bigint as step, round(19990.0::double + dx * coalesce(first, 80), 6) + 0.0 as x, round(30010.0::double + dy * coalesce(first, 80), 6) + 0.0 as y, first is not null as hit from (
 select id, dx, dy, min(case when rz <= d.z then step end) as first from (select id, dx, dy, step, 860.0::double - step * 0.9::double as rz, floor((30120 - (30010.0::double + dy * step)) / 4)::bigint as i, floor((19990.0::double + dx * step - 19880) / 4)::bigint as j
  from (select id, (id % 41 - 20) * 0.05::double as dx, (id % 37 - 18) * 0.05::double as dy from v_world), (select unnest(range(0, 81)) as step)) s
 left join v_dem d on d.i = s.i and d.j = s.j group by id, dx, dy)"""


@query("ray_dem", V.sql(RAY, "v_world", "v_dem"))
def ray_dem(spark: SparkSession, sf: str) -> DataFrame:
    """Where rays that go down in steps first meet the surface; those that don't give their lowest point."""
    e = F.col("id")
    rays = V.world(spark, sf).select(L("id"), F.lit(19990.0).alias("x"), F.lit(30010.0).alias("y"), F.lit(860.0).alias("z"), ((e % 41 - 20) * 0.05).alias("dx"), ((e % 37 - 18) * 0.05).alias("dy"), F.lit(-0.9).alias("dz"))
    hits = O.ray_hits(rays, V.dem(spark, sf), steps=80, row=lambda x, y: F.floor((30120 - y) / 4), column=lambda x, y: F.floor((x - 19880) / 4))
    return hits.select("id", "step", shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y"), "hit")


@query("reproject_dem", V.sql("select r::bigint as r, c::bigint as c, round(sum(z * w) / sum(w) * 0.3048::double, 6) + 0.0 as z from (select r, c, z, greatest(0, 1 - abs(fj - d.j)) * greatest(0, 1 - abs(fi - d.i)) as w from (select r, c, r * 1.7::double + 0.3::double as fi, c * 1.3::double + 0.2::double as fj from (select unnest(range(0, 80)) as r), (select unnest(range(0, 48)) as c)) t, (select unnest(range(0, 2)) as di), (select unnest(range(0, 2)) as dj), v_dem d where d.i = floor(fi)::bigint + di and d.j = floor(fj)::bigint + dj) group by r, c having count(*) = 4", "v_dem"))
def reproject_dem(spark: SparkSession, sf: str) -> DataFrame:
    """Heights on another grid, in another unit."""
    cells = R.grid(spark, 80, 48)
    out = R.interpolated(cells, V.dem(spark, sf).select("i", "j", F.col("z").alias("v")), F.col("c") * 1.3 + 0.2, F.col("r") * 1.7 + 0.3, "bilinear")
    return out.select(L("r"), L("c"), shown(F.col("v") * 0.3048).alias("z"))


@query("undistort_im", V.sql(f"select image::bigint as image, band::integer as band, r::bigint as r, c::bigint as c, v from (select r, c, fx*du+cx as j, fy*dv+cy as i from (select *, {BROWN_SQL} from (select r, c, fx, fy, cx, cy, (c-cx)/fx as u, (r-cy)/fy as v, ((c-cx)/fx)*((c-cx)/fx)+((r-cy)/fy)*((r-cy)/fy) as q from (select unnest(range(0, 150)) as r), (select unnest(range(0, 200)) as c), cam))) px join image on image.i = round_even(px.i, 0)::bigint and image.j = round_even(px.j, 0)::bigint", "v_raster", rot=ROT, cam=CAM, image=IMAGE))
def undistort_im(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel of the undistorted image from the nearest of the distorted one."""
    j, i = C.pixel(K, *C.Frame(K, POSE, "brown", V.BROWN).distorted((F.col("c") - K.cx) / K.fx, (F.col("r") - K.cy) / K.fy))
    return R.nearest(R.grid(spark, 150, 200).select("r", "c", j.alias("j"), i.alias("i")), image(spark, sf), F.col("j"), F.col("i")).select(L("image"), "band", L("r"), L("c"), "v")


#: Where pixels of the undistorted image (alpha 1) lie in the distorted one, and the images seen through that.
STRAIGHT_PX = f"select r, c, fx*du+cx as j, fy*dv+cy as i from (select *, {BROWN_SQL} from (select *, u*u+v*v as q from (select r, c, fx, fy, cx, cy, (c-uj)/ux as u, (r-ui)/uy as v from (select unnest(range(0, 150)) as r), (select unnest(range(0, 200)) as c), cam, straight where alpha = 1)))"
SEEN = "select p.image, p.band, t.r, t.c, v, greatest(0, 1 - abs(t.j - p.j)) * greatest(0, 1 - abs(t.i - p.i)) as w from (select t.*, floor(t.i)::bigint + di as pi, floor(t.j)::bigint + dj as pj from spx t, (select unnest(range(0, 2)) as di), (select unnest(range(0, 2)) as dj)) t join image p on p.i = t.pi and p.j = t.pj"


@query("read_undistort", iterated_sql("select image::bigint as image, band::integer as band, r::bigint as i, c::bigint as j, round(sum(v * w) / sum(w), 5) + 0.0 as v from seen group by 1, 2, 3, 4 having count(*) = 4", GRID81, BROWN_STEP, "v_raster", before=PAIRS | {"image": IMAGE}, after=RECT_PARTS | {"spx": STRAIGHT_PX, "seen": SEEN}))
def read_undistort(spark: SparkSession, sf: str) -> DataFrame:
    """All bands of images as a camera without distortion takes them."""
    out = U.undistort_image(image(spark, sf), lens(), 1.0, "bilinear")
    return out.select(L("image"), "band", L("i"), L("j"), shown(F.col("v"), 5).alias("v"))


@query("distort_im", iterated_sql("select image::bigint as image, band::integer as band, t.a::bigint as i, t.b::bigint as j, v from (select a, b, ux*x+uj as j, uy*y+ui as i from fixed, straight where alpha = 1 and a >= 0) t join image p on p.i = round_even(t.i, 0)::bigint and p.j = round_even(t.j, 0)::bigint", "select a, b, (b-cx)/fx as u0, (a-cy)/fy as v0 from (select unnest(range(0, 150)) as a), (select unnest(range(0, 200)) as b), cam union all select -1 - g.a, -1 - g.b, u0, v0 from g81 g", BROWN_STEP, "v_raster", before=PAIRS | {"image": IMAGE, "g81": GRID81}, after={"rect": RECT.replace("b = ", "-1 - b = ").replace("a = ", "-1 - a = ") + " where a < 0", "straight": STRAIGHT}))
def distort_im(spark: SparkSession, sf: str) -> DataFrame:
    """The image that a camera with distortion takes of what an undistorted one shows."""
    out = U.distort_image(image(spark, sf), lens(), 1.0)
    return out.select(L("image"), "band", L("i"), L("j"), "v")


@query("remap_dilate", _kernel_sql(BI, 1, "image, r, c", "px", "v_dem", **GRID_PARTS).replace("having count(*) = 4", "having count(*) = 4").join(["with all_ as (", ") select a.image, a.r, a.c, a.band, a.v from all_ a where (select count(*) from all_ b where b.image = a.image and b.band = 1 and abs(b.r - a.r) <= 1 and abs(b.c - a.c) <= 1) = (1 + least(a.r, 1) + least(59 - a.r, 1) ) * (1 + least(a.c, 1) + least(63 - a.c, 1))"]))
def remap_dilate(spark: SparkSession, sf: str) -> DataFrame:
    """Orthorectified cells of all bands without those beside a cell that the image doesn't show."""
    cells = R.grid(spark, GRID["rows"], GRID["cols"]).crossJoin(F.broadcast(image(spark, sf).select("image").distinct()))
    out = U.without_blur(cells, ortho_bilinear(spark, sf), 1, ["image"])
    return out.select("image", "r", "c", "band", "v")


#: A camera an image of the pile, each above its own part of the elevation raster, whose cells are 4 m.
def pile_cameras(spark: SparkSession, sf: str) -> DataFrame:
    lens = {c: F.lit(None).cast("double") for c in ORTHO.LENS} | {k: F.lit(v) for k, v in V.BROWN.items()}
    at = {"x": F.lit(20000.0), "y": 30000.0 - 600.0 * F.col("image"), "z": F.lit(1000.0)} | {n: F.lit(math.radians(a)) for n, a in zip(("omega", "phi", "kappa"), V.ANGLES, strict=True)}
    k = {"width": 200.0, "height": 150.0, "fx": 500 / 3, "fy": 500 / 3, "cx": 97.5, "cy": 78.5}
    images = V.raster(spark, sf).select(F.expr("i div 150").alias("image")).distinct()
    return images.select("image", F.lit("brown").alias("kind"), *(F.lit(v).alias(n) for n, v in k.items()), *(v.alias(n) for n, v in (at | lens).items()))


PILE_CELLS = "select 19880.0::double + 4.0::double * (j + 0.5::double) as x, 30120.0::double - 4.0::double * (i + 0.5::double) as y, z from v_dem"
PILE_RAYS = "select image, x as wx, y as wy, (r00*(x-tx)+r10*(y-ty+600*image)+r20*(z-tz)) as a, (r01*(x-tx)+r11*(y-ty+600*image)+r21*(z-tz)) as b, (r02*(x-tx)+r12*(y-ty+600*image)+r22*(z-tz)) as w, fx, fy, cx, cy from cells4, (select distinct i // 150 as image from v_raster), cam where abs(30000 - 600 * image - y) < 2000"
PILE_PX = f"select image, wx, wy, fx*du+cx as j, fy*dv+cy as i from (select *, {BROWN_SQL} from (select *, a/w as u, b/w as v, (a/w)*(a/w)+(b/w)*(b/w) as q from rays4)) where abs(u) < 0.8 and abs(v) < 0.8"
PILE = {"rot": ROT, "cam": CAM, "image": IMAGE, "cells4": PILE_CELLS, "rays4": PILE_RAYS, "px4": PILE_PX}
PILE_VALUES = "select t.image::bigint as image, band::integer as band, round(wx, 3) as x, round(wy, 3) as y, round(sum(v * greatest(0, 1 - abs(t.j - p.j)) * greatest(0, 1 - abs(t.i - p.i))), 5) + 0.0 as v from (select t.*, floor(t.i)::bigint + di as pi, floor(t.j)::bigint + dj as pj from px4 t, (select unnest(range(0, 2)) as di), (select unnest(range(0, 2)) as dj)) t join image p on p.image = t.image and p.i = t.pi and p.j = t.pj group by t.image, band, wx, wy having count(*) = 4"


def pile_ortho(spark: SparkSession, sf: str) -> ORTHO.Ortho:
    return ORTHO.orthorectify(image(spark, sf), pile_cameras(spark, sf), V.dem(spark, sf), ORTHO.Grid(19880.0, 30120.0, 4.0, -4.0), resolution=4.0, kernel="bilinear", dem_kernel="nearest", tile=64)


@query("orthorectify", V.sql(PILE_VALUES, "v_raster", "v_dem", **PILE))
def orthorectify(spark: SparkSession, sf: str) -> DataFrame:
    """Images of a pile of cameras from end to end: windows of the elevation raster, grids, heights, projection with distortion, all bands."""
    out = pile_ortho(spark, sf)
    x, y = F.col("x0") + F.col("res") * (F.col("c") + 0.5), F.col("y0") - F.col("res") * (F.col("r") + 0.5)
    return out.pixels.join(out.grids, "image").select(L("image"), "band", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), shown(F.col("v"), 5).alias("v"))


@query("write_tiles", V.sql(f"select band::integer as band, count(*)::bigint as n, round(sum(v), 2) + 0.0 as total from ({PILE_VALUES}) group by band", "v_raster", "v_dem", **PILE))
def write_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Orthorectified images written as georeferenced tiles, and read again."""
    folder, out = store.scratch(spark), pile_ortho(spark, sf)
    done = sinks.write_tiles(out.pixels, out.grids, folder, "float64", 32735, 64)
    done.select(F.sum("n")).first()  # the writing
    back = files.pixels_of(files.read_rasters(spark, f"{folder}/*/*.tif"))
    return back.groupBy("band").agg(F.count("*").alias("n"), shown(F.sum(F.round("v", 5)), 2).alias("total"))


@query("ortho_grids", "select image::bigint as image, case when image >= 0 then 4.0::double end as res, case when image < 0 then case when image = -1 then '-1 sees the horizon' else '-2 lies outside the elevation raster' end end as reason from (select distinct vec_id // 150 as image from embeddings union all select -1 union all select -2)")
def ortho_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Which images have a grid: a camera that looks level and one far away have none."""
    c = pile_cameras(spark, sf)
    one = c.where("image = 0")
    level = one.withColumns({"image": F.lit(-1).cast("long"), "omega": F.lit(math.pi / 2)})
    away = one.withColumns({"image": F.lit(-2).cast("long"), "x": F.lit(900_000.0)})
    g = ORTHO.grids(c.unionByName(level).unionByName(away), V.dem(spark, sf), ORTHO.Grid(19880.0, 30120.0, 4.0, -4.0), resolution=4.0)
    return g.select(L("image"), "res", "reason")


SURFACE = "select ord, tx+(r00*u+r01*v+r02)*(h-tz)/(r20*u+r21*v+r22) as x, ty+(r10*u+r11*v+r12)*(h-tz)/(r20*u+r21*v+r22) as y, h, step from (select ord, (j-cx)/fx as u, (i-cy)/fy as v, cam.* from bound8, cam), (select step, 850 - step::double as h from (select unnest(range(0, 61)) as step))"


@query(
    "world_boundary_dem",
    V.sql("select ord::integer as ord, round(x, 5) + 0.0 as x, round(y, 5) + 0.0 as y, hit from (select s.ord, s.x, s.y, f.first is not null as hit from on_ray s join (select ord, min(case when h <= z then step end) as first from (select r.*, d.z from on_ray r left join v_dem d on d.i = round_even((30120 - r.y) / 4 - 0.5::double, 0)::bigint and d.j = round_even((r.x - 19880) / 4 - 0.5::double, 0)::bigint) group by ord) f on f.ord = s.ord and s.step = coalesce(f.first, 60)) q", "v_dem", rot=ROT, cam=CAM, bound8="select * from (values (0, 0.0::double, 0.0::double), (1, 99.5, 0.0), (2, 199.0, 0.0), (3, 199.0, 74.5), (4, 199.0, 149.0), (5, 99.5, 149.0), (6, 0.0, 149.0), (7, 0.0, 74.5)) as t(ord, j, i)", on_ray=SURFACE),
)
def world_boundary_dem(spark: SparkSession, sf: str) -> DataFrame:
    """The boundary of an image on the elevation raster, by following its rays down."""
    camera = pile_cameras(spark, sf).where("image = 0").withColumn("kind", F.lit("pinhole"))
    out = ORTHO.on_surface(ORTHO.with_rays(camera), V.dem(spark, sf), ORTHO.Grid(19880.0, 30120.0, 4.0, -4.0), 850.0, 790.0, 60)
    return out.select(F.col("ord").cast("int").alias("ord"), shown(F.col("x"), 5).alias("x"), shown(F.col("y"), 5).alias("y"), "hit")

"""Queries on tables of cameras, images and control points: joins, refinement and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import checks as K
from terralith.functions.num import shown
from terralith.operators import catalog as J
from terralith.operators import refine as R
from terralith.operators.raster import overview_levels
from terralith.plans import views as V
from terralith.plans.catalog import query


def images(spark: SparkSession, sf: str) -> DataFrame:
    """An image an order; those of every fifth order are called other than their shots."""
    o = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(F.concat(F.lit("in/img_"), (o + F.when(o % 5 == 0, 10_000_000).otherwise(0)).cast("string"), F.lit(".tif")).alias("path"))


IMAGES = "select 'in/img_' || n || '.tif' as path, 'img_' || n || '.tif' as name from (select o_orderkey + case when o_orderkey % 5 = 0 then 10000000 else 0 end as n from orders)"


@query("join_ext", V.sql("select p.path, s.filename, s.x, s.y, s.z, case when s.filename is null then 'No exterior parameters for ' || p.name end as reason from p left join (select *, case when o % 2 = 0 then filename else filename || '.tif' end as name from (select *, regexp_extract(filename, '[0-9]+')::bigint as o from v_shot)) s on s.name = p.name", "v_shot", p=IMAGES))
def join_ext(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their exterior parameters, by file name or else by its stem; every fifth image has none."""
    return J.by_name(images(spark, sf), V.shots(spark, sf)).select("path", "filename", "x", "y", "z", "reason")


@query("join_int", V.sql("select s.filename, s.cam_id::bigint as cam_id, c.focal, c.k1, case when c.cam_id is null then 'No interior parameters for ' || s.cam_id end as reason from v_shot s left join v_cam c on s.cam_id = c.cam_id", "v_shot", "v_cam"))
def join_int(spark: SparkSession, sf: str) -> DataFrame:
    """Shots with the interior parameters of their cameras; one in seven cameras has none."""
    return J.with_interior(V.shots(spark, sf), V.cams(spark, sf)).select("filename", F.col("cam_id").cast("long").alias("cam_id"), "focal", "k1", "reason")


@query("join_int_one", V.sql("select filename, 5::bigint as cam_id from v_shot", "v_shot"))
def join_int_one(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that name no camera take the only one."""
    one = V.cams(spark, sf).where("cam_id = 5")
    return J.with_interior(V.shots(spark, sf).withColumn("cam_id", F.lit(None).cast("long")), one).select("filename", F.col("cam_id").cast("long").alias("cam_id"))


@query("filenames", V.sql("select distinct filename from v_gcp", "v_gcp"))
def filenames(spark: SparkSession, sf: str) -> DataFrame:
    return V.gcps(spark, sf).select("filename").distinct()


@query("gcp_missing", V.sql("select distinct filename from v_gcp where filename not in (select name from p)", "v_gcp", p=IMAGES))
def gcp_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Control points of no image."""
    return J.unmatched(V.gcps(spark, sf), images(spark, sf))


@query("join_gcp", V.sql("select p.path, count(g.filename)::bigint as n from p left join v_gcp g on g.filename = p.name group by 1", "v_gcp", p=IMAGES))
def join_gcp(spark: SparkSession, sf: str) -> DataFrame:
    """How many control points each image has."""
    g = V.gcps(spark, sf).groupBy("filename").agg(F.count("*").alias("n"))
    return J.by_name(images(spark, sf), g, what="control point").select("path", F.coalesce("n", F.lit(0)).alias("n"))


#: The model's pixel of a control point, normalised like the marked one.
POINTS = "select filename, (j - 450) / 400.0::double as j, (i - 330) / 300.0::double as i, ((j - 450) * 1.01::double + (ord % 5) - 3) / 400.0::double as j_model, ((i - 330) * 0.99::double + (ord % 3) * 0.5::double + 2) / 300.0::double as i_model from v_gcp"


def points(spark: SparkSession, sf: str) -> DataFrame:
    j, i, o = F.col("j") - 450, F.col("i") - 330, F.col("ord")
    return V.gcps(spark, sf).select("filename", (j / 400.0).alias("j"), (i / 300.0).alias("i"), ((j * 1.01 + o % 5 - 3) / 400.0).alias("j_model"), ((i * 0.99 + (o % 3) * 0.5 + 2) / 300.0).alias("i_model"))


@query("rpc_shift", V.sql("select filename, count(*)::bigint as n, round(avg(j - j_model), 9) + 0.0 as c_j, round(avg(i - i_model), 9) + 0.0 as c_i from p group by filename", "v_gcp", p=POINTS))
def rpc_shift(spark: SparkSession, sf: str) -> DataFrame:
    return R.shift(points(spark, sf)).select("filename", "n", *(shown(F.col(f"c_{a}"), 9).alias(f"c_{a}") for a in "ji"))


DRIFT = "select filename, count(*)::bigint as n, regr_slope(j, j_model) as m_j, regr_intercept(j, j_model) as c_j, regr_slope(i, i_model) as m_i, regr_intercept(i, i_model) as c_i from p group by filename having count(*) >= 2"


@query("rpc_shift_drift", V.sql("select filename, n, " + ", ".join(f"round({c}, 7) + 0.0 as {c}" for c in ("m_j", "c_j", "m_i", "c_i")) + " from d", "v_gcp", p=POINTS, d=DRIFT))
def rpc_shift_drift(spark: SparkSession, sf: str) -> DataFrame:
    return R.shift(points(spark, sf), "shift-drift").select("filename", "n", *(shown(F.col(c), 7).alias(c) for c in ("m_j", "c_j", "m_i", "c_i")))


@query("rpc_refined", V.sql("select filename, round(m_j * 0.5::double + c_j * 1, 7) + 0.0 as first, round(m_j * -0.25::double + c_j * 0.125::double, 7) + 0.0 as second from d", "v_gcp", p=POINTS, d=DRIFT))
def rpc_refined(spark: SparkSession, sf: str) -> DataFrame:
    """Refined coefficients of each image's column numerator."""
    num, den = (F.array(*map(F.lit, v)) for v in ((0.5, -0.25), (1.0, 0.125)))
    out = R.shift(points(spark, sf), "shift-drift").withColumn("k", R.refined(num, den, F.col("m_j"), F.col("c_j")))
    return out.select("filename", shown(F.col("k")[0], 7).alias("first"), shown(F.col("k")[1], 7).alias("second"))


@query("rpc_rmse", V.sql("select filename, round(sqrt(avg(d2)), 6) + 0.0 as rmse, round(sqrt(min(d2)), 6) + 0.0 as least, round(sqrt(max(d2)), 6) + 0.0 as most from (select filename, ((j-j_model)*400)*((j-j_model)*400)+((i-i_model)*300)*((i-i_model)*300) as d2 from p) group by filename", "v_gcp", p=POINTS))
def rpc_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return R.errors(points(spark, sf), 400.0, 300.0).select("filename", *(shown(F.col(c)).alias(c) for c in ("rmse", "least", "most")))


@query("gcp_center", V.sql("select round(avg(lon), 8) + 0.0 as lon, round(avg(lat), 8) + 0.0 as lat, round(avg(h), 6) + 0.0 as h from v_gcp", "v_gcp"))
def gcp_center(spark: SparkSession, sf: str) -> DataFrame:
    """The reference point of a fit: the mean of all control points."""
    return V.gcps(spark, sf).agg(shown(F.avg("lon"), 8).alias("lon"), shown(F.avg("lat"), 8).alias("lat"), shown(F.avg("h")).alias("h"))


@query("gcp_count", V.sql("select min(n)::bigint as fewest, sum(n)::bigint as total, min(n) >= 3 and sum(n) >= 8 as enough from (select count(*) as n from v_gcp group by filename)", "v_gcp"))
def gcp_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.enough(V.gcps(spark, sf), 3, 8)


@query("gcp_coplanar", V.sql("select filename, not (avg(h) > 1e-5 or stddev_pop(h) > 1e-5) as coplanar from (select filename, h - case when ord % 2 = 0 then h else 500 end as h from v_gcp) group by filename", "v_gcp"))
def gcp_coplanar(spark: SparkSession, sf: str) -> DataFrame:
    g = V.gcps(spark, sf).withColumn("h", F.col("h") - F.when(F.col("ord") % 2 == 0, F.col("h")).otherwise(500.0))
    return R.coplanar(g)


@query("ms_indexes", "select event_id::bigint as id, case when event_id % 2 = 0 then '1,2,3' else '2,3,4' end as bands from events")
def ms_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Bands that aren't alpha, by number."""
    e = F.col("event_id")
    alpha = F.when(e % 2 == 0, F.array(*map(F.lit, (False, False, False, True)))).otherwise(F.array(*map(F.lit, (True, False, False, False))))
    bands = K.colour_bands(alpha)
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), F.concat_ws(",", bands.cast("array<string>")).alias("bands"))


@query("validate_image", "select event_id::bigint as id, event_id % 40000 <= 32767 and event_id % 3 < 2 as valid from events")
def validate_image(spark: SparkSession, sf: str) -> DataFrame:
    """Images of a supported type whose sides aren't too long."""
    e = F.col("event_id")
    dtype = F.element_at(F.array(*map(F.lit, ("uint8", "float32", "int64"))), (e % 3 + 1).cast("int"))
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), K.image_fits(e % 40000, e % 100, dtype).alias("valid"))


@query("res_check", "select event_id::bigint as id, (event_id % 50 + 1) > (event_id % 30) as too_coarse from events")
def res_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a resolution exceeds the extent."""
    e = F.col("event_id")
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), K.too_coarse(e % 50 + 1, e % 30).alias("too_coarse"))


@query("overview_count", "select 1024::integer as rows, 2::integer as levels union all select 300, 0 union all select 200000, 8")
def overview_count(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, overview_levels(n, n)) for n in (1024, 300, 200_000)], "rows int, levels int")

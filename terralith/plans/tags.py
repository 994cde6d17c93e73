"""Queries on image tags: what they say of cameras, interior and exterior parameters of them, and models refined by control points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import tags as T
from terralith.functions import text as X
from terralith.functions.num import shown
from terralith.operators import catalog as J
from terralith.operators import refine as R
from terralith.plans import geometry as G
from terralith.plans import params as P
from terralith.plans import views as V
from terralith.plans.catalog import query
from terralith.sources import exterior as E_

ID = "event_id::bigint as id"
E = lambda: F.col("event_id")


def _s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def _map(items) -> Column:
    """A map of names to texts; those whose text is NULL are left out."""
    pairs = F.array(*(F.struct(F.lit(k), v) for k, v in items))
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"].isNotNull()))


def _bracketed(*numbers: Column) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit("("), _s(n), F.lit(")")) for n in numbers))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """An image an event (id, filename, width, height, exif, xmp): what its tags hold goes by the event's number."""
    e = E()
    lens = F.concat_ws(",", *(_s(v) for v in (3600 + e % 50, 3650 + e % 50, e % 7 - 3, e % 9 - 4, 0.1, -0.2, 0.01, 0.02, -0.3)))
    exif = _map(
        [
            ("EXIF_Make", F.lit("ACME")), ("EXIF_Model", F.when(e % 4 != 1, F.concat(F.lit("M"), _s(e % 9)))), ("EXIF_BodySerialNumber", F.when(e % 6 == 0, _s(e % 3))),
            ("EXIF_PixelXDimension", F.when(e % 5 != 0, _s(4000))), ("EXIF_PixelYDimension", F.when(e % 5 != 0, _s(3000))),
            ("EXIF_FocalPlaneResolutionUnit", F.when(e % 3 == 0, _s(e % 6))), ("EXIF_FocalPlaneXResolution", F.when(e % 3 == 0, _bracketed(1000 + e % 11))), ("EXIF_FocalPlaneYResolution", F.when(e % 3 == 0, _bracketed(1000 + e % 11))),
            ("EXIF_FocalLength", F.when(e % 2 == 0, _bracketed(8 + e % 4))), ("EXIF_FocalLengthIn35mmFilm", F.when(e % 7 != 0, _s(24 + e % 5))), ("EXIF_Orientation", _s(e % 8 + 1)),
            ("EXIF_GPSLatitude", F.when(e % 10 != 0, _bracketed(e % 80, e % 60, e % 50))), ("EXIF_GPSLatitudeRef", F.when(e % 3 == 0, "N").otherwise("S")), ("EXIF_GPSLongitude", _bracketed(e % 170, e % 40, e % 30)), ("EXIF_GPSLongitudeRef", F.lit("W")),
            ("EXIF_GPSAltitude", _bracketed(e % 500)), ("EXIF_GPSAltitudeRef", F.when(e % 2 == 0, "0x01").otherwise("0x00")),
        ]
    )
    space, place, turn, data, _ = X.VENDORS[0]
    xmp = _map(
        [
            *((space + k, F.when(e % 20 == 0, _s(v))) for k, v in zip(place, (e % 60, e % 150, 7), strict=True)),
            *((space + k, F.when(e % 4 != 3, _s(v))) for k, v in zip(turn, (e % 20, e % 30 - 90, e % 360), strict=True)),
            (space + data, F.when(e % 8 == 1, F.concat(F.lit("2021-01-01;"), lens))),
        ]
    )
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), F.concat(F.lit("im"), _s(e)).alias("filename"), F.lit(4000).alias("width"), F.lit(3000).alias("height"), exif.alias("exif"), xmp.alias("xmp"))


#: The same images as the tags' decoder sees them.
TAGS = """select event_id as e, event_id::bigint as id, 'acme' as make, case when event_id % 4 <> 1 then 'm' || event_id % 9 end as model, case when event_id % 6 = 0 then (event_id % 3)::varchar end as serial,
event_id % 5 <> 0 as tagged, case when event_id % 3 = 0 then case event_id % 6 when 3 then 10::double end * 4000 / (1000 + event_id % 11) end as sensor_w, case when event_id % 3 = 0 then case event_id % 6 when 3 then 10::double end * 3000 / (1000 + event_id % 11) end as sensor_h,
case when event_id % 2 = 0 then (8 + event_id % 4)::double end as focal, case when event_id % 7 <> 0 then (24 + event_id % 5)::double end as film, (event_id % 8 + 1)::integer as orientation,
case when event_id % 20 = 0 then (event_id % 60)::double when event_id % 10 <> 0 then (event_id % 80 + (event_id % 60) / 60.0::double + (event_id % 50) / 3600.0::double) * case when event_id % 3 = 0 then 1 else -1 end end as lat,
case when event_id % 20 = 0 then (event_id % 150)::double when event_id % 10 <> 0 then -(event_id % 170 + (event_id % 40) / 60.0::double + (event_id % 30) / 3600.0::double) end as lon,
case when event_id % 20 = 0 then 7::double when event_id % 10 <> 0 then case when event_id % 2 = 0 then -(event_id % 500)::double else (event_id % 500)::double end end as alt,
case when event_id % 4 <> 3 then (event_id % 20)::double end as roll, case when event_id % 4 <> 3 then (event_id % 30)::double end as pitch, case when event_id % 4 <> 3 then (event_id % 360)::double end as yaw, event_id % 8 = 1 as lens from events"""


@query("exif_decode", V.sql("select id, make, model, serial, case when tagged then 4000 else 0 end::integer as tag_width, round(coalesce(sensor_w, -1), 9) as sensor, coalesce(focal, -1) as focal, coalesce(film, -1) as film, orientation, round(coalesce(lat, 999), 9) + 0.0 as lat, round(coalesce(lon, 999), 9) + 0.0 as lon, coalesce(alt, 9999) + 0.0 as alt, coalesce(pitch, 999) as pitch, case when lens then 9 else 0 end::integer as lens from t", t=TAGS))
def exif_decode(spark: SparkSession, sf: str) -> DataFrame:
    """What tags say of a camera; what they don't say is given as a value out of range."""
    d = T.decoded(F.col("exif"), F.col("xmp"), F.col("width"), F.col("height"))
    at = lambda c, k, none: F.coalesce(d[c][k], F.lit(none))
    return images(spark, sf).select(
        "id", *(d[c].alias(c) for c in ("make", "model", "serial")), at("tag_im_size", 0, 0).alias("tag_width"), F.round(at("sensor_size", 0, -1.0), 9).alias("sensor"), F.coalesce(d["focal_len"], F.lit(-1.0)).alias("focal"),
        F.coalesce(d["focal_len_35"], F.lit(-1.0)).alias("film"), d["orientation"].alias("orientation"), shown(at("lla", 0, 999.0), 9).alias("lat"), shown(at("lla", 1, 999.0), 9).alias("lon"), (at("lla", 2, 9999.0) + F.lit(0.0)).alias("alt"),
        at("rpy", 1, 999.0).alias("pitch"), F.coalesce(F.size(d["dewarp"]), F.lit(0)).alias("lens"),
    )


HAS = "lens and tagged"
INTERIOR = f"""select id, rtrim('acme ' || coalesce(model || ' ', '') || coalesce(serial, '')) as camera, case when {HAS} then 'brown' when (focal is not null and sensor_w is not null) or film is not null then 'pinhole' end as kind,
round(coalesce(case when {HAS} then 3600 + e % 50 when focal is not null and sensor_w is not null then focal when film is not null then coalesce(sensor_w * film, film) / 36 end, -1), 9) as fx, round(coalesce(case when {HAS} then 4000 else sensor_w end, -1), 9) as sensor,
round(case when {HAS} then (e % 7 - 3) / 4000.0::double else 0 end, 9) + 0.0 as cx, case when {HAS} then -0.3::double else 0 end as k3, not ({HAS}) and film is null and (focal is null or sensor_w is null) as missing from t"""


@query("exif_int_param", V.sql(INTERIOR, t=TAGS))
def exif_int_param(spark: SparkSession, sf: str) -> DataFrame:
    """Interior parameters by what is there: lens data, focal length and sensor, or the 35 mm focal length."""
    i = E_.interior_of(E_.decode(images(spark, sf).withColumn("filename", F.col("id").cast("string"))))
    none = lambda c, v: F.coalesce(c, F.lit(v))
    return i.select(F.col("filename").cast("long").alias("id"), "camera", "kind", F.round(none(F.get("focal_len", F.lit(0)), -1.0), 9).alias("fx"), F.round(none(F.get("sensor_size", F.lit(0)), -1.0), 9).alias("sensor"), shown(none(F.col("cx"), 0.0), 9).alias("cx"), none(F.col("k3"), 0.0).alias("k3"), F.col("error").isNotNull().alias("missing"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    """Images with places of one zone and angles, in decoded form."""
    rows = P._local(spark, sf)
    return rows.select(F.substring_index("filename", "/", -1).alias("filename"), F.array("latitude", "longitude", "altitude").alias("lla"), F.array("roll", "pitch", "yaw").alias("rpy"), F.lit("acme").alias("make"), F.lit("m").alias("model"), F.when(F.col("camera") != "", F.lit("7")).alias("serial"))


@query("exif_ext", P._world_sql(", case when id % 2 = 0 then 'acme m 7' else 'acme m' end as camera"))
def exif_ext(spark: SparkSession, sf: str) -> DataFrame:
    """Exterior parameters of tagged images, in the UTM zone of their mean place."""
    return P._located(E_.read_tagged(_near(spark, sf)).rows)


@query("exif_make", f"select {ID}, case when event_id % 3 <> 0 then 'acme' end as make, case when event_id % 2 = 0 then 'ixus 9' end as model from events")
def exif_make(spark: SparkSession, sf: str) -> DataFrame:
    exif = _map([("EXIF_Make", F.when(E() % 3 != 0, "AcmE")), ("EXIF_Model", F.when(E() % 2 == 0, "IXUS 9"))])
    d = T.decoded(exif, _map([("a", F.lit("b"))]), F.lit(1), F.lit(1))
    return V.table(spark, sf, "events").select(E().cast("long").alias("id"), d["make"].alias("make"), d["model"].alias("model"))


@query("exif_json", V.sql("select id, 'Camera: acme' || coalesce(' ' || model, '') as camera, 'Orientation: ' || orientation as orientation, make from t", t=TAGS))
def exif_json(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded tags as a text for people and as JSON."""
    d = T.decoded(F.col("exif"), F.col("xmp"), F.col("width"), F.col("height"))
    rows = images(spark, sf).select("id", F.split(T.described(F.col("filename"), d), "\n").alias("lines"), F.to_json(F.struct(*(v.alias(k) for k, v in d.items()))).alias("json"))
    return rows.select("id", F.col("lines")[1].alias("camera"), F.col("lines")[4].alias("orientation"), F.get_json_object("json", "$.make").alias("make"))


#: A reconstruction a customer: one shot each, turned and shifted by numbers of the customer.
OSFM = "select c_custkey as k, (c_custkey % 40) * 0.02 - 0.4::double as a, (c_custkey % 30) * 0.02 - 0.3::double as b, 2.8::double + (c_custkey % 20) * 0.01::double as c, (c_custkey % 50) - 25::double as t0, (c_custkey % 60) - 30::double as t1, 100::double + c_custkey % 10 as t2 from customer"
OSFM_Q = "select *, sqrt(a*a+b*b+c*c) as t from g0"
OSFM_W = "select *, cos(t) as ct, sin(t)/t as s, (1-cos(t))/(t*t) as h from q0"
_REF = ("25.0", "-33.5", "50.0")


@query(
    "osfm_ext",
    V.sql(
        "select 'shot ' || k as filename, round(-((ct+h*a*a)*t0 + (h*a*b+s*c)*t1 + (h*a*c-s*b)*t2), 4) + 0.0 as dx, round(-((h*a*b-s*c)*t0 + (ct+h*b*b)*t1 + (h*b*c+s*a)*t2), 4) + 0.0 as dy, round(-((h*a*c+s*b)*t0 + (h*b*c-s*a)*t1 + (ct+h*c*c)*t2) + 50, 6) + 0.0 as z, "
        "round(atan2(h*c*b+s*a, -(ct+h*c*c)), 9) + 0.0 as omega, round(asin(greatest(-1, least(1, -(h*a*c-s*b)))), 9) + 0.0 as phi, round(atan2(h*a*b+s*c, ct+h*a*a), 9) + 0.0 as kappa, 'cam ' || k % 3 as camera from w0",
        g0=OSFM, q0=OSFM_Q, w0=OSFM_W,
    ),
)
def osfm_ext(spark: SparkSession, sf: str) -> DataFrame:
    """Shots of a reconstruction: places as they lie from its reference, and camera angles."""
    k = F.col("c_custkey")
    turn = F.array((k % 40) * 0.02 - 0.4, (k % 30) * 0.02 - 0.3, 2.8 + (k % 20) * 0.01)
    shift = F.array(*(x.cast("double") for x in ((k % 50) - 25, (k % 60) - 30, 100 + k % 10)))
    shot = F.struct(turn.alias("rotation"), shift.alias("translation"), F.concat(F.lit("v2 cam "), _s(k % 3)).alias("camera"))
    ref = F.struct(F.lit(float(_REF[1])).alias("latitude"), F.lit(float(_REF[0])).alias("longitude"), F.lit(float(_REF[2])).alias("altitude"))
    docs = V.table(spark, sf, "customer").select(F.to_json(F.array(F.struct(F.create_map(F.concat(F.lit("shot "), _s(k)), shot).alias("shots"), ref.alias("reference_lla")))).alias("value"))
    out = E_.read_reconstruction(docs)
    x, y = (F.lit(v) for v in _projected(out.crs))
    return out.rows.select("filename", shown(F.col("x") - x, 4).alias("dx"), shown(F.col("y") - y, 4).alias("dy"), shown(F.col("z"), 6).alias("z"), *(shown(F.col(c), 9).alias(c) for c in ("omega", "phi", "kappa")), "camera")


def _projected(system) -> tuple[float, float]:
    """The reference place in a system."""
    spark = SparkSession.active()
    from terralith.functions.crs import forward

    x, y = forward(system, F.lit(float(_REF[0])), F.lit(float(_REF[1])))
    return tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first())


#: A model an image of the control points: near affine, with offsets by the image's number.
RPC_SCALE = {"height_off": 600.0, "height_scale": 300.0, "lat_off": -33.5, "lat_scale": 0.6, "line_off": 330.0, "line_scale": 300.0, "long_off": 24.5, "long_scale": 0.6, "samp_off": 450.0, "samp_scale": 400.0}


def rpc_models(spark: SparkSession, sf: str) -> DataFrame:
    """filename, im_size, rpc of every image with control points and some without."""
    k = F.col("c_custkey")
    poly = lambda *head: F.concat(F.array(*(c if isinstance(c, Column) else F.lit(float(c)) for c in head)), F.array_repeat(F.lit(0.0), 20 - len(head)))
    rpc = F.struct(
        *(F.lit(v).alias(n) for n, v in RPC_SCALE.items()),
        poly(0.01 * (k % 7), 0.9, 0.05, 0.02).alias("samp_num_coeff"), poly(1.0, 0.001, 0.002, 0.003).alias("samp_den_coeff"),
        poly(-0.01 * (k % 5), 0.03, -0.95, 0.01).alias("line_num_coeff"), poly(1.0, -0.002, 0.001, 0.002).alias("line_den_coeff"),
    )
    return V.table(spark, sf, "customer").select(F.concat(F.lit("img_"), _s(k), F.lit(".tif")).alias("filename"), F.array(F.lit(900), F.lit(660)).alias("im_size"), rpc.alias("rpc"))


RPC_XYZ = "select c_custkey as k, g.*, (lon - 24.5::double) / 0.6::double as x, (lat + 33.5::double) / 0.6::double as y, (h - 600) / 300.0::double as z from customer join v_gcp g on g.filename = 'img_' || c_custkey || '.tif'"
RPC_PX = "select *, (j - 450) / 400.0::double as jn, (i - 330) / 300.0::double as in_, (0.01::double * (k % 7) + 0.9::double*x + 0.05::double*y + 0.02::double*z) / (1 + 0.001::double*x + 0.002::double*y + 0.003::double*z) as jm, (-0.01::double * (k % 5) + 0.03::double*x - 0.95::double*y + 0.01::double*z) / (1 - 0.002::double*x + 0.001::double*y + 0.002::double*z) as im from xyz"


@query("join_rpc", V.sql("select 'a/img_' || c_custkey || '.tif' as path, round((c_custkey % 7) * 0.01::double, 9) as first, 900::integer as width, null::varchar as reason from customer union all select 'a/none.tif', -1, 0, 'No RPC parameters for none.tif'"))
def join_rpc(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their rational polynomial models; one has none."""
    paths = V.table(spark, sf, "customer").select(F.concat(F.lit("a/img_"), _s(F.col("c_custkey")), F.lit(".tif")).alias("path")).unionByName(spark.createDataFrame([("a/none.tif",)], "path string"))
    # models by stem, as files may be named without the images' extension
    models = rpc_models(spark, sf).withColumn("filename", X.stem(F.col("filename")))
    found = J.by_name(paths, models, what="RPC")
    return found.select("path", F.coalesce(F.round(F.col("rpc.samp_num_coeff")[0], 9), F.lit(-1.0)).alias("first"), F.coalesce(F.col("im_size")[0], F.lit(0)).alias("width"), "reason")


@query("rpc_refine", V.sql("select filename, count(*)::bigint as n, round((max(k) % 7) * 0.01::double + avg(jn - jm), 8) + 0.0 as j0, round(0.05::double + 0.002::double * avg(jn - jm), 8) + 0.0 as j2, round(-(max(k) % 5) * 0.01::double + avg(in_ - im), 8) + 0.0 as i0 from px group by filename union all select 'img_' || c_custkey || '.tif', 0, round((c_custkey % 7) * 0.01::double, 8), 0.05::double, round(-(c_custkey % 5) * 0.01::double, 8) + 0.0 from customer where 'img_' || c_custkey || '.tif' not in (select filename from v_gcp)", "v_gcp", xyz=RPC_XYZ, px=RPC_PX))
def rpc_refine(spark: SparkSession, sf: str) -> DataFrame:
    """Models shifted by their control points, projected by the models themselves; models without points stay."""
    out = R.refine(rpc_models(spark, sf), V.gcps(spark, sf), "shift")
    return out.select("filename", F.col("n").cast("long").alias("n"), shown(F.col("rpc.samp_num_coeff")[0], 8).alias("j0"), shown(F.col("rpc.samp_num_coeff")[2], 8).alias("j2"), shown(F.col("rpc.line_num_coeff")[0], 8).alias("i0"))


DRIFT = "select filename, max(k) as k, count(*)::bigint as n, regr_slope(jn, jm) as mj, regr_intercept(jn, jm) as cj, regr_slope(in_, im) as mi, regr_intercept(in_, im) as ci from px group by filename having count(*) >= 2"


@query("rpc_refine_drift", V.sql("select filename, n, round(mj * 0.9::double + cj * 0.001::double, 6) + 0.0 as j1, round(mi * 0.03::double + ci * -0.002::double, 6) + 0.0 as i1 from d", "v_gcp", xyz=RPC_XYZ, px=RPC_PX, d=DRIFT))
def rpc_refine_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Models with shift and drift; an image with one point has too few, which its reason says."""
    out = R.refine(rpc_models(spark, sf), V.gcps(spark, sf), "shift-drift").where("n > 0 and reason is null")
    return out.select("filename", F.col("n").cast("long").alias("n"), shown(F.col("rpc.samp_num_coeff")[1], 6).alias("j1"), shown(F.col("rpc.line_num_coeff")[1], 6).alias("i1"))

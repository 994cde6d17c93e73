"""Queries on parameters: tags, names, and camera and control-point files as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import crs as C_
from terralith.functions import text as X
from terralith.functions.num import shown
from terralith.plans import geometry as G
from terralith.plans import views as V
from terralith.plans.catalog import query
from terralith.sources import exterior as E_
from terralith.sources import params as S

ID = "event_id::bigint as id"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").withColumn("id", F.col("event_id").cast("long"))


E = lambda: F.col("event_id")


@query("filename", f"select {ID}, 'img_' || event_id || '.tif' as name from events")
def filename(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", X.file_name(F.concat(F.lit("s3://bucket/dir/img_"), E().cast("string"), F.lit(".tif"))).alias("name"))


@query("ortho_name", f"select {ID}, 'img.' || event_id || '_ORTHO.tif' as name from events")
def ortho_name(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", X.ortho_name(F.concat(F.lit("a/b/img."), E().cast("string"), F.lit(".jpg"))).alias("name"))


@query("osfm_id", f"select {ID}, 'cam ' || event_id % 50 as camera from events")
def osfm_id(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", X.plain_id(F.concat(F.when(E() % 2 == 0, "v2 ").otherwise(""), F.lit("cam "), (E() % 50).cast("string"))).alias("camera"))


@query("from_odm", f"select {ID}, case event_id % 4 when 0 then 'brown' when 1 then 'fisheye' when 2 then 'brown' end as kind from events")
def from_odm(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, (" Perspective", "fisheye", "RADIAL", "rpc"))), (E() % 4 + 1).cast("int"))
    return _events(spark, sf).select("id", X.projection_kind(name).alias("kind"))


def _dms() -> tuple:
    d, m, s = E() % 80, E() % 60, (E() % 600) * 0.1
    text = F.concat(F.lit("("), d.cast("string"), F.lit(") ("), m.cast("string"), F.lit(") ("), F.round(s, 1).cast("string"), F.lit(")"))
    return text, F.element_at(F.array(*map(F.lit, ("N", "S", ""))), (E() % 3 + 1).cast("int"))


@query("exif_float", f"select {ID}, (event_id % 80)::double as d, (event_id % 60)::double as m, round((event_id % 600) * 0.1::double, 1) as s from events")
def exif_float(spark: SparkSession, sf: str) -> DataFrame:
    n = X.numbers(_dms()[0])
    return _events(spark, sf).select("id", *(F.get(n, F.lit(k)).alias(c) for k, c in enumerate("dms")))


@query("exif_lla", f"select {ID}, round(case when event_id % 3 = 1 then -1 else 1 end * (event_id % 80 + (event_id % 60) / 60.0::double + round((event_id % 600) * 0.1::double, 1) / 3600), 9) + 0.0 as lat, case when event_id % 4 = 0 then 0.0::double when event_id % 2 = 1 then -(event_id % 500)::double else (event_id % 500)::double end + 0.0 as alt from events")
def exif_lla(spark: SparkSession, sf: str) -> DataFrame:
    text, ref = _dms()
    alt = F.when(E() % 4 != 0, F.concat(F.lit("("), (E() % 500).cast("string"), F.lit(")")))
    return _events(spark, sf).select("id", shown(X.degrees(text, ref, "NE"), 9).alias("lat"), (X.altitude(alt, (E() % 2).cast("string")) + F.lit(0.0)).alias("alt"))


@query("exif_sensor", f"select {ID}, round(case event_id % 6 when 2 then 25.4::double when 3 then 10::double when 4 then 1::double when 5 then 0.001::double end * (4000 + event_id % 7) / (100 + event_id % 11), 9) + 0.0 as width from events")
def exif_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", shown(X.sensor_size((4000 + E() % 7).cast("double"), (100 + E() % 11).cast("double"), E() % 6), 9).alias("width"))


@query("exif_cam_id", f"select {ID}, case when event_id % 5 = 0 then 'unknown' else 'acme' || case when event_id % 2 = 0 then ' m' || event_id % 9 else '' end end as camera from events")
def exif_cam_id(spark: SparkSession, sf: str) -> DataFrame:
    known = E() % 5 != 0
    make, model = F.when(known, F.lower(F.lit("ACME"))), F.when(known & (E() % 2 == 0), F.concat(F.lit("m"), (E() % 9).cast("string")))
    return _events(spark, sf).select("id", X.camera_id(make, model, F.lit(None).cast("string")).alias("camera"))


@query("xmp_rpy", f"select {ID}, (event_id % 20)::double as roll, (event_id % 30)::double as pitch, (event_id % 360)::double as yaw, case when event_id % 6 = 0 then (event_id % 80)::double end as lat from events where event_id % 4 <> 3")
def xmp_rpy(spark: SparkSession, sf: str) -> DataFrame:
    """Angles and places from the first vendor's tags that are all there; one row in four has a third of them only."""
    s = lambda c: c.cast("string")
    (dji, place, angles, _, _), (fly, _, others, _, _), (pix, *_) = X.VENDORS
    made = lambda *kv: F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in kv))
    turn = lambda space, keys, pitch: [x for k, v in zip(keys, (s(E() % 20), pitch, s(E() % 360)), strict=True) for x in (space + k, v)]
    first = made(*turn(dji, angles, s(E() % 30 - 90)), pix + "Roll", "1")
    located = F.when(E() % 3 == 0, made(*[x for k, v in zip(place, (s(E() % 80), s(E() % 9), "5"), strict=True) for x in (dji + k, v)])).otherwise(made(dji + place[0], "3"))
    second = made(*turn(fly, others, s(E() % 30)), dji + angles[2], "5", pix + "Pitch", "9")
    third = made(*turn(pix, others, s(E() % 30)))
    tags = F.when(E() % 4 == 0, first).when(E() % 4 == 1, second).when(E() % 4 == 2, third).otherwise(made(pix + "Roll", "1"))
    tags = F.when(E() % 2 == 0, F.map_concat(tags, located)).otherwise(tags)
    out = _events(spark, sf).withColumn("a", X.body_angles(tags)).withColumn("p", X.body_place(tags)).where("a is not null")
    return out.select("id", *(F.col("a")[k].alias(n) for k, n in enumerate(("roll", "pitch", "yaw"))), F.col("p")[0].alias("lat"))


@query("xmp_dewarp", f"select {ID}, (event_id % 100)::double as first, -0.5::double as second, 2::integer as n from events")
def xmp_dewarp(spark: SparkSession, sf: str) -> DataFrame:
    d = X.dewarp(F.concat(F.lit("2020-01-01;"), (E() % 100).cast("string"), F.lit(",-0.5")))
    return _events(spark, sf).select("id", d[0].alias("first"), d[1].alias("second"), F.size(d).alias("n"))


@query("creation_opts", f"select {ID}, case when event_id % 2 = 0 then 'tiled' else 'nodata' end as name, case when event_id % 2 = 0 then 'yes=' || event_id % 3 end as value from events")
def creation_opts(spark: SparkSession, sf: str) -> DataFrame:
    name, value = X.option(F.when(E() % 2 == 0, F.concat(F.lit("TILED = yes="), (E() % 3).cast("string"))).otherwise("NoData=None"))
    return _events(spark, sf).select("id", name.alias("name"), value.alias("value"))


@query("csv_format", f"select {ID}, case event_id % 4 when 0 then 'xyz_opk' when 1 then 'lla_rpy' when 2 then 'xyz_rpy' end as format from events")
def csv_format(spark: SparkSession, sf: str) -> DataFrame:
    sets = [("filename", "x", "y", "z", "omega", "phi", "kappa"), ("filename", "latitude", "longitude", "altitude", "roll", "pitch", "yaw", "other"), ("filename", "x", "y", "z", "roll", "pitch", "yaw"), ("filename", "x", "y")]
    fields = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in sets)), (E() % 4 + 1).cast("int"))
    return _events(spark, sf).select("id", X.table_format(fields).alias("format"))


@query("unknown_params", f"select {ID}, case when event_id % 2 = 0 then 1 else 0 end::integer as n from events")
def unknown_params(spark: SparkSession, sf: str) -> DataFrame:
    """How many parameters the kind of camera doesn't have."""
    given = F.map_keys(F.create_map(F.lit("k1"), F.lit(0.1), F.when(E() % 2 == 0, "k9").otherwise("k2"), F.lit(0.2)))
    return _events(spark, sf).select("id", F.size(S.unknown_parameters(given, "brown")).alias("n"))


SHOT_LINES = ("filename", "x", "y", "z", "omega", "phi", "kappa")
RADIANS = "select filename, x, y, z, " + ", ".join(f"round(radians(round({c}, 4)), 9) + 0.0 as {c}" for c in ("omega", "phi", "kappa"))


def _lines(rows: DataFrame, columns, sep: str = ",", quote: str = "") -> DataFrame:
    """ord, value: rows as lines of a table; file names may be quoted and lie in folders."""
    q = F.lit(quote)
    texts = [F.concat(q, F.col(c), q) if c in ("filename", "camera") else F.col(c).cast("string") for c in columns]
    return rows.select("ord", F.concat_ws(sep, *texts).alias("value"))


def _read(lines: DataFrame, sample: str, crs=None, **more) -> DataFrame:
    layout = E_.layout_of(sample, **more)
    return E_.to_world(E_.parsed(lines, layout), layout, crs)


def _shots(spark: SparkSession, sf: str) -> DataFrame:
    s = V.shots(spark, sf).withColumn("ord", F.xxhash64("filename"))
    return s.withColumns({c: F.round(c, 4) for c in ("omega", "phi", "kappa")})


def _shown(rows: DataFrame, digits: int = 9) -> DataFrame:
    return rows.select("filename", "x", "y", "z", *(shown(F.col(c), digits).alias(c) for c in ("omega", "phi", "kappa")))


@query("csv_xyz_opk", V.sql(f"{RADIANS} from v_shot", "v_shot"))
def csv_xyz_opk(spark: SparkSession, sf: str) -> DataFrame:
    """A table of positions with a header in two cases and a field that nobody knows, in degrees."""
    lines = _lines(_shots(spark, sf).withColumn("other", F.lit("x")), ("filename", "other", *SHOT_LINES[1:]), ";")
    return _shown(_read(lines, "filename; Other;X;y;z;Omega;phi;kappa\nimg_1;x;1;2;3;0.1;0.2;0.3\nimg_2;x;1;2;3;0.1;0.2;0.3"))


@query("csv_legacy", V.sql(f"{RADIANS} from v_shot", "v_shot"))
def csv_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """A table without a header: its fields are known by their order."""
    return _shown(_read(_lines(_shots(spark, sf), SHOT_LINES, " "), "img_1.tif 20001.0 30002.0 1003.0 0.1 0.2 0.3\nimg_2.tif 20001.5 30002.5 1003.5 0.15 0.25 0.35"))


#: Places of one UTM zone with body angles, and a camera that may be empty.
LOCAL = "select id, 24.0::double + (id % 997) * 0.002::double as lon, -34.0::double + (id % 991) * 0.002::double as lat, 100.0::double + id % 50 as alt, round(-5.0::double + id % 11, 1) as roll, round(-4.0::double + id % 9, 1) as pitch, round((id % 350)::double, 1) as yaw from (select event_id as id from events)"
ZONE = 27.0


def _local(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    body = [(-5.0 + e % 11).alias("roll"), (-4.0 + e % 9).alias("pitch"), (e % 350).cast("double").alias("yaw")]
    place = [(-34.0 + (e % 991) * 0.002).alias("latitude"), (24.0 + (e % 997) * 0.002).alias("longitude"), (100.0 + e % 50).alias("altitude")]
    return V.table(spark, sf, "events").select(e.alias("ord"), F.concat(F.lit("a/b/img "), e.cast("string")).alias("filename"), *place, *body, F.when(e % 2 == 0, F.lit("cam 1")).otherwise("").alias("camera"))


def _world_sql(more: str = "", body: str = "bodies") -> str:
    parts = {"p": f"select *, {ZONE}::double as lon0, 10000000::double as y0 from places", "t1": G.T1, "t2": G.T2, "n1": G.NORTH1.replace("from t2", "from t3"), "n2": G.NORTH2}
    parts["t3"] = f"select *, 500000 + 0.9996::double*{G.RA}::double*(eta + {G._series('', G.X.FORWARD, 'xi', 'eta', 'cos', 'sinh')}) as x, y0 + 0.9996::double*{G.RA}::double*(xi + {G._series('', G.X.FORWARD, 'xi', 'eta', 'sin', 'cosh')}) as y from t2"
    order = ("p", "t1", "t2", "t3", "n1", "n2")
    parts["bodies"] = "select *, radians(roll) as a, radians(pitch) as b, radians(yaw) as c from n2"
    return V.sql(f"select 'img ' || id as filename, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, alt as z, {G.OPK_OF_RPY}{more} from {body}", places=LOCAL, **{k: parts[k] for k in order}, bodies=parts["bodies"])


def _located(rows: DataFrame) -> DataFrame:
    return rows.select("filename", shown(F.col("x"), 4).alias("x"), shown(F.col("y"), 4).alias("y"), "z", *(shown(F.col(c), 8).alias(c) for c in ("omega", "phi", "kappa")), *([] if "camera" not in rows.columns else ["camera"]))


LLA_FIELDS = ("filename", "latitude", "longitude", "altitude", "roll", "pitch", "yaw", "camera")


@query("csv_lla_rpy", _world_sql(", case when id % 2 = 0 then 'cam 1' end as camera"))
def csv_lla_rpy(spark: SparkSession, sf: str) -> DataFrame:
    """Latitudes and body angles with quoted names: the mean place gives the UTM zone of world coordinates and camera angles."""
    rows = _local(spark, sf)
    sample = "filename latitude longitude altitude roll pitch yaw camera\n\"a/b/img 1\" -33.5 24.5 100.0 1.0 2.0 3.0 \"cam 1\"\n\"a/b/img 2\" -33.4 24.6 101.0 1.5 2.5 3.5 \"cam 1\""
    return _located(_read(_lines(rows, LLA_FIELDS, " ", '"'), sample, E_.mean_zone(rows, "latitude", "longitude")))


@query("csv_xyz_rpy", _world_sql())
def csv_xyz_rpy(spark: SparkSession, sf: str) -> DataFrame:
    """World coordinates and body angles: north is found where the coordinates lie."""
    rows = _local(spark, sf)
    system = C_.utm(35, False)
    x, y = C_.forward(system, F.col("longitude"), F.col("latitude"))
    lines = _lines(rows.withColumns({"x": x, "y": y, "z": F.col("altitude")}), ("filename", "x", "y", "z", "roll", "pitch", "yaw"), "\t")
    return _located(_read(lines, "filename\tx\ty\tz\troll\tpitch\tyaw\na\t1.0\t2.0\t3.0\t1.0\t2.0\t3.0\nb\t1.5\t2.5\t3.5\t1.0\t2.0\t3.0", system)).drop("camera")


@query("csv_lla_opk", _world_sql().replace(G.OPK_OF_RPY, "round(radians(roll), 8) + 0.0 as omega, round(radians(pitch), 8) + 0.0 as phi, round(radians(yaw), 8) + 0.0 as kappa"))
def csv_lla_opk(spark: SparkSession, sf: str) -> DataFrame:
    """Latitudes and camera angles: both come to a system that is given."""
    rows = _local(spark, sf).withColumnsRenamed({"roll": "omega", "pitch": "phi", "yaw": "kappa"})
    lines = _lines(rows, ("filename", "latitude", "longitude", "altitude", "omega", "phi", "kappa"), ",")
    return _located(_read(lines, "filename,latitude,longitude,altitude,omega,phi,kappa\na,1.0,2.0,3.0,1.0,2.0,3.0\nb,1.5,2.5,3.5,1.0,2.0,3.0", C_.utm(35, False))).drop("camera")


@query("dedup_last", V.sql("select cam_id::bigint as cam_id, filename from (select cam_id, filename, row_number() over (partition by cam_id order by ord desc) as n from (select o_custkey as cam_id, o_orderkey as ord, 'img_' || o_orderkey as filename from orders)) where n = 1"))
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of rows with one key, the last."""
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("cam_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("filename"))
    return S.last_of(o, ["cam_id"], "ord").select("cam_id", "filename")


@query("int_param_osfm", V.sql("select 'cam ' || cam_id as camera, 'brown' as kind, 200::integer as width, 150::integer as height, focal, k1 from v_cam", "v_cam"))
def int_param_osfm(spark: SparkSession, sf: str) -> DataFrame:
    """Interior parameters from JSON, one object a camera by its id."""
    c = V.cams(spark, sf)
    body = F.struct(F.lit("brown").alias("projection_type"), F.lit(200).alias("width"), F.lit(150).alias("height"), F.col("focal").alias("focal_x"), F.col("focal").alias("focal_y"), F.col("cx").alias("c_x"), F.col("cy").alias("c_y"), F.col("k1"))
    docs = c.select(F.to_json(F.create_map(F.concat(F.lit("v2 cam "), F.col("cam_id").cast("string")), body)).alias("value"))
    return S.read_interior_json(docs).select("camera", "kind", "width", "height", F.col("focal_x").alias("focal"), "k1")


@query("gcp_geojson", V.sql("select filename, count(*)::bigint as n, round(avg(j), 6) + 0.0 as j, round(avg(lon), 9) + 0.0 as lon from v_gcp group by filename", "v_gcp"))
def gcp_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Control points written as GeoJSON, one collection an image, and read again."""
    back = S.read_gcps(S.write_gcps(V.gcps(spark, sf)))
    return back.groupBy("filename").agg(F.count("*").alias("n"), shown(F.avg("j")).alias("j"), shown(F.avg("lon"), 9).alias("lon"))


@query("ext_geojson", V.sql("select filename, cam_id::varchar as camera, x, y, z, omega, phi, kappa from v_shot", "v_shot"))
def ext_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Exterior parameters written as GeoJSON features and read again."""
    one = S.exterior_features(V.shots(spark, sf).withColumn("camera", F.col("cam_id").cast("string")), C_.utm(35, False))
    return S.read_exterior_features(one).select("filename", "camera", "x", "y", "z", "omega", "phi", "kappa")


@query("write_ext", V.sql("select 'img ' || id as filename, round(lon, 7) + 0.0 as lon, round(lat, 7) + 0.0 as lat, alt as h from places", places=LOCAL))
def write_ext(spark: SparkSession, sf: str) -> DataFrame:
    """The places of GeoJSON features of shots in a projected system: longitude, latitude and height."""
    rows, system = _local(spark, sf), C_.utm(35, False)
    x, y = C_.forward(system, F.col("longitude"), F.col("latitude"))
    shots = rows.select(F.substring_index("filename", "/", -1).alias("filename"), x.alias("x"), y.alias("y"), F.col("altitude").alias("z"), *(F.lit(0.0).alias(c) for c in ("omega", "phi", "kappa")), "camera")
    g = F.from_json("value", "geometry struct<type:string,coordinates:array<double>>")["geometry"]["coordinates"]
    return S.exterior_features(shots, system).select("filename", shown(g[0], 7).alias("lon"), shown(g[1], 7).alias("lat"), g[2].alias("h"))


@query("validate_json", f"select {ID}, event_id % 3 <> 0 as valid from events")
def validate_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text has the fields and types of a schema."""
    doc = F.when(E() % 3 == 0, F.lit('{"im_size": "x", "focal_len": 5}')).otherwise(F.lit('{"im_size": [200, 150], "focal_len": 5.0}'))
    return _events(spark, sf).select("id", S.fits_schema(doc, "im_size array<int>, focal_len double").alias("valid"))


@query("out_profile", f"select {ID}, case when event_id % 2 = 0 then 'jpeg' else 'deflate' end as compress, event_id % 2 = 0 as write_mask, case when event_id % 2 = 0 and event_id % 3 = 0 then 'ycbcr' end as photometric from events")
def out_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults of an output image by its type and bands."""
    dtype, bands = F.when(E() % 2 == 0, "uint8").otherwise("float32"), F.when(E() % 3 == 0, 3).otherwise(4)
    p = S.output_profile(dtype, bands)
    return _events(spark, sf).select("id", *(v.alias(k) for k, v in p.items()))

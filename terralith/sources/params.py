"""Readers and writers of camera and control-point parameters: text, JSON and GeoJSON as DataFrames."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.errors import CrsError, ParamError
from terralith.functions import crs as C
from terralith.functions.cameras import COEFFICIENTS
from terralith.functions.text import plain_id, projection_kind
from terralith.sources import store
from terralith.sources.files import LARGE, large, lines, texts

#: Parameters that all kinds of camera have: fixed names.
COMMON = ("im_size", "focal_len", "sensor_size", "cx", "cy")

def unknown_parameters(names: Column, kind: str) -> Column:
    return F.array_except(names, F.array(*map(F.lit, (*COMMON, *COEFFICIENTS[kind]))))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last by order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def cameras_of(docs: DataFrame) -> DataFrame:
    """Objects of cameras (value) by id, from such objects or from reconstructions that hold one."""
    whole = F.get_json_object("value", "$[0].cameras")
    return docs.select(F.coalesce(whole, F.col("value")).alias("value"))


def read_interior_json(docs: DataFrame) -> DataFrame:
    """A row for each camera of JSON objects (value) keyed by camera id; unknown projections are left out."""
    fields = "struct<projection_type:string,width:int,height:int,focal:double,focal_x:double,focal_y:double,c_x:double,c_y:double,k1:double,k2:double,k3:double,k4:double,p1:double,p2:double>"
    c = docs.select(F.explode(F.from_json("value", f"map<string,{fields}>")).alias("id", "c"))
    out = c.select(plain_id(F.col("id")).alias("camera"), projection_kind(F.col("c.projection_type")).alias("kind"), "c.width", "c.height", F.coalesce("c.focal_x", "c.focal").alias("focal_x"), F.coalesce("c.focal_y", "c.focal").alias("focal_y"), F.col("c.c_x").alias("cx"), F.col("c.c_y").alias("cy"), *(f"c.{k}" for k in ("k1", "k2", "k3", "k4", "p1", "p2")))
    return out.where("kind is not null")


def gcp_feature() -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("filename"), F.array("j", "i").alias("ji"), F.col("ord").alias("id")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", "h").alias("coordinates")).alias("geometry"),
    )


def write_gcps(gcps: DataFrame) -> DataFrame:
    """filename, value: a GeoJSON feature collection an image, points in order."""
    feature = gcp_feature()
    grouped = gcps.groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("ord", feature.alias("f")))).alias("f"))
    return grouped.select("filename", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("f", lambda x: x["f"]).alias("features"))).alias("value"))


FEATURE = "struct<type:string,properties:struct<filename:string,ji:array<double>,id:string>,geometry:struct<coordinates:array<double>>>"


def _points(f: DataFrame) -> DataFrame:
    return f.select("f.properties.filename", "ord", F.col("f.properties.ji")[0].alias("j"), F.col("f.properties.ji")[1].alias("i"), *(F.col("f.geometry.coordinates")[k].alias(c) for k, c in enumerate(("lon", "lat", "h"))), F.col("f.properties.id").alias("id"))


def read_gcps(docs: DataFrame) -> DataFrame:
    schema = "type string, features array<struct<properties:struct<filename:string,ji:array<double>,id:string>,geometry:struct<coordinates:array<double>>>>"
    return _points(docs.select(F.posexplode(F.from_json("value", schema)["features"]).alias("ord", "f")))


def _line_features(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file with the features that they hold (f), and whether each begins or ends a collection."""
    text = F.regexp_replace("value", r",?\s*$", "")
    f = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{FEATURE}>")
    return lines(spark, path).select("start", "at", f.alias("f"), F.col("value").rlike(r'^\s*\{[^\[]*"features"\s*:\s*\[\s*$').alias("head"), F.col("value").rlike(r"^\s*\]\s*\}\s*$").alias("tail"))


def _in_blocks(spark: SparkSession, path: str) -> bool:
    """Whether a file is a collection with a feature a line, whole and alone, as write_gcp_file() writes it."""
    first = F.get("f", F.lit(0))
    one = F.coalesce((F.size("f") == 1) & (first["type"] == "Feature") & first["properties"].isNotNull() & first["geometry"].isNotNull(), F.lit(False))
    n = _line_features(spark, path).agg(F.count_if(one & ~F.col("head")).alias("features"), F.count_if("head").alias("heads"), F.count_if("tail").alias("tails"), F.count("*").alias("all")).first()
    return n["heads"] == n["tails"] == 1 and n["all"] == n["features"] + 2


def read_gcp_file(spark: SparkSession, glob: str, least: int = LARGE) -> DataFrame:
    """Control points of GeoJSON files. A large file with a feature a line is read in blocks, others a file a row.

    Points are numbered within their file by their block's place and their line in it.
    """
    big, others = large(spark, glob, least)
    blocks = [p for p in big if _in_blocks(spark, p)]
    if not blocks:
        return read_gcps(texts(spark, glob))
    others += [p for p in big if p not in blocks]
    parts = [read_gcps(texts(spark, others))] if others else []
    for path in blocks:
        rows = _line_features(spark, path).where("not head and not tail")
        counts = rows.groupBy("start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = counts.select("start", "first", (F.sum("n").over(Window.orderBy("start")) - F.col("n")).alias("before"))  # a row a block
        parts.append(_points(rows.join(F.broadcast(before), "start").select((F.col("at") - F.col("first") + F.col("before")).cast("int").alias("ord"), F.col("f")[0].alias("f"))))
    return reduce(DataFrame.unionByName, parts)


def exterior_features(shots: DataFrame, crs: C.Crs | None = None) -> DataFrame:
    """value: a GeoJSON feature a shot, with the place in longitude, latitude and height where the system is known."""
    camera = next((F.col(c).cast("string") for c in ("camera", "cam_id") if c in shots.columns), F.lit(None).cast("string"))
    props = F.struct("filename", camera.alias("camera"), F.array("x", "y", "z").alias("xyz"), F.array("omega", "phi", "kappa").alias("opk"))
    parts = [F.lit("Feature").alias("type"), props.alias("properties")]
    if crs is not None:
        lon, lat = C.back(crs, F.col("x"), F.col("y"))
        parts.append(F.struct(F.lit("Point").alias("type"), F.array(lon, lat, F.col("z") * crs.z_scale).alias("coordinates")).alias("geometry"))
    return shots.select("filename", F.to_json(F.struct(*parts)).alias("value"))


def _write_collection(features: DataFrame, head: str, path: str, overwrite: bool) -> None:
    """A GeoJSON collection with a feature a line, in the order of rows (value)."""
    store.write_rows(features, path, head + "\n", ",\n", "\n]}\n", overwrite)


def write_exterior(shots: DataFrame, crs: C.Crs, path: str, overwrite: bool = False) -> None:
    """A GeoJSON file of shots in a projected system."""
    if not crs.projected:
        raise CrsError("Exterior parameters are written in a projected system")
    head = f'{{"type": "FeatureCollection", "world_crs": {json.dumps(crs.text())}, "features": ['
    _write_collection(exterior_features(shots, crs).orderBy("filename"), head, path, overwrite)


#: What a camera's JSON object may hold besides its projection, size, focal lengths and centre, by kind of camera.
JSON_KEYS = ("projection_type", "width", "height", "focal", "focal_x", "focal_y", "c_x", "c_y")


def check_interior_json(docs: DataFrame) -> DataFrame:
    """The documents, if all cameras are of known projections, whole, and without unknown parameters; else ParamError."""
    keys = F.map_keys("c")
    kind = projection_kind(F.try_element_at("c", F.lit("projection_type")))
    known = F.lit(None).cast("array<string>")
    for k in ("brown", "fisheye"):
        known = F.when(kind == k, F.array(*map(F.lit, (*JSON_KEYS, *COEFFICIENTS[k])))).otherwise(known)
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0
    unknown = F.array_except(keys, known)
    problem = (
        F.when(~has("projection_type", "width", "height"), "lacks projection_type, width or height")
        .when(kind.isNull(), "has an unknown projection")
        .when(~(has("focal") | has("focal_x", "focal_y")), "lacks focal, or focal_x and focal_y")
        .when(F.size(unknown) > 0, F.concat(F.lit("has unknown parameters: "), F.array_join(unknown, ", ")))
    )
    cams = docs.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("id", "c"))
    bad = cams.select("id", problem.alias("problem")).where("problem is not null").first()
    if bad:
        raise ParamError(f"Camera {bad['id']} {bad['problem']}")
    return docs


def write_gcp_file(gcps: DataFrame, path: str, overwrite: bool = False) -> None:
    """One GeoJSON file of all images' control points."""
    rows = gcps.orderBy("filename", "ord") if "ord" in gcps.columns else gcps.orderBy("filename")
    _write_collection(rows.select(F.to_json(gcp_feature()).alias("value")), '{"type": "FeatureCollection", "features": [', path, overwrite)


def rpc_of_heads(heads: DataFrame) -> DataFrame:
    """filename, im_size and rpc of image heads; an image without a model is an error."""
    bad = heads.where("rpc is null").select("filename").first()
    if bad:
        raise ParamError(f"{bad['filename']} has no rational polynomial model")
    return heads.select("filename", F.array("width", "height").alias("im_size"), "rpc")


def gcps_of_heads(heads: DataFrame) -> DataFrame:
    """Control points (filename, ord, j, i, lon, lat, h) of image heads, in longitude, latitude and height."""
    bad = heads.where("gcps is null or size(gcps) = 0").select("filename").first()
    if bad:
        raise ParamError(f"{bad['filename']} has no control points")
    g = heads.select("filename", "epsg", F.posexplode("gcps").alias("ord", "g"))
    codes = [r["epsg"] for r in g.select("epsg").distinct().collect()]
    x, y = F.col("g")[3], F.col("g")[4]
    lon, lat = x, y
    for code in codes:
        system = C.parse_crs(f"EPSG:{code}") if code is not None else C.Crs("lonlat")
        a, b = C.back(system, x, y)
        here = F.col("epsg").eqNullSafe(F.lit(code))
        lon, lat = F.when(here, a).otherwise(lon), F.when(here, b).otherwise(lat)
    return g.select("filename", "ord", F.col("g")[0].alias("j"), F.col("g")[1].alias("i"), lon.alias("lon"), lat.alias("lat"), F.col("g")[5].alias("h"))


def read_exterior_features(docs: DataFrame) -> DataFrame:
    p = docs.select(F.from_json("value", "type string, properties struct<filename:string,camera:string,xyz:array<double>,opk:array<double>>")["properties"].alias("p"))
    return p.select("p.filename", "p.camera", *(F.col("p.xyz")[k].alias(c) for k, c in enumerate("xyz")), *(F.col("p.opk")[k].alias(c) for k, c in enumerate(("omega", "phi", "kappa"))))


def fits_schema(text: Column, ddl: str) -> Column:
    """Whether all fields of a JSON text are there with their types."""
    parsed = F.from_json(text, f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return parsed["_bad"].isNull()


def output_profile(dtype: Column, bands: Column) -> dict[str, Column]:
    jpeg = dtype == "uint8"
    return {"compress": F.when(jpeg, "jpeg").otherwise("deflate"), "write_mask": jpeg, "photometric": F.when(jpeg & (bands == 3), "ycbcr")}

"""Exterior camera parameters: tables of positions in four formats, reconstructions, GeoJSON and image tags.

All readers give filename, x, y, z (world), omega, phi, kappa (radians) and camera, with the system of x, y and z.
"""

from __future__ import annotations

import csv
import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.errors import CrsError, CrsMissingError, ParamError
from terralith.functions import angles as A
from terralith.functions import crs as C
from terralith.functions import tags as T
from terralith.functions import text as X
from terralith.functions.num import applied, transposed

#: What is read of a table to find its dialect and fields, in characters; and what separates its fields: fixed values.
SAMPLE, DELIMITERS = 10_000, ",;: \t"
#: Fields of a table without a header.
LEGACY = ("filename", "x", "y", "z", "omega", "phi", "kappa")
WORDS = ("filename", "camera")
ANGLES = {"opk": ("omega", "phi", "kappa"), "rpy": ("roll", "pitch", "yaw")}
PLACES = {"xyz": ("x", "y", "z"), "lla": ("latitude", "longitude", "altitude")}
LLA = "EPSG:4979"


class Exterior(NamedTuple):
    rows: DataFrame
    crs: C.Crs | None


class Layout(NamedTuple):
    """How a table of positions is written: place is xyz or lla, turn opk or rpy."""

    delimiter: str
    quote: str
    header: bool
    fields: tuple[str, ...]
    place: str
    turn: str


def format_of(fields) -> tuple[str, str]:
    """Kinds of place and of angles that a table has by its fields."""
    have = set(fields)
    if "filename" not in have:
        raise ParamError("A table of positions needs the field filename")
    out = []
    for kinds in (PLACES, ANGLES):
        fitting = [k for k, names in kinds.items() if have.issuperset(names)]
        if not fitting:
            raise ParamError("A table of positions needs one of " + " or ".join(", ".join(n) for n in kinds.values()))
        out.append(fitting[0])
    return out[0], out[1]


def layout_of(sample: str, fields: tuple[str, ...] | None = None, delimiter: str | None = None) -> Layout:
    """The layout of a table from its first characters; given fields go before those of a header."""
    sniffer = csv.Sniffer()
    try:
        dialect = sniffer.sniff(sample[:SAMPLE], delimiters=delimiter or DELIMITERS)
        header = sniffer.has_header(sample[:SAMPLE])
    except csv.Error as e:
        raise ParamError(f"A table's layout isn't clear: {e}") from e
    dialect.skipinitialspace = True
    if fields is None:
        fields = tuple(next(csv.reader(sample.splitlines()[:1], dialect=dialect))) if header else LEGACY
    names = tuple(n.strip().lower() for n in fields)
    return Layout(dialect.delimiter, dialect.quotechar or '"', header, names, *format_of(names))


def parsed(lines: DataFrame, layout: Layout) -> DataFrame:
    """ord and the known fields of lines (ord, value); a number that is malformed is NULL."""
    known = {*LEGACY, *WORDS, *ANGLES["rpy"], *PLACES["lla"]}
    names = [n if n in known and n not in layout.fields[:k] else f"_{k}" for k, n in enumerate(layout.fields)]
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": layout.delimiter, "quote": layout.quote, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
    row = lines.where(F.trim("value") != "").select("ord", F.from_csv("value", schema, options).alias("r"))
    out = [F.col(f"r.{n}").alias(n) if n in WORDS else F.col(f"r.{n}").try_cast("double").alias(n) for n in names if n in known]
    return row.select("ord", *out)


def to_world(rows: DataFrame, layout: Layout, crs: C.Crs | None, radians: bool = False) -> DataFrame:
    """Parsed rows with places and angles of the world; of rows with one file name, the last."""
    turn = [F.col(c) if radians else F.radians(c) for c in ANGLES[layout.turn]]
    camera = F.nullif(F.trim("camera"), F.lit("")) if "camera" in rows.columns else F.lit(None).cast("string")
    name = X.file_name(F.regexp_replace("filename", r"\\", "/"))
    if layout.place == "xyz":
        place = [F.col(c) for c in "xyz"]
        lon, lat = C.back(crs, place[0], place[1]) if layout.turn == "rpy" else (None, None)
    else:
        lat, lon, alt = (F.col(c) for c in PLACES["lla"])
        place = C.world_of(crs, lon, lat, alt)
    more = {"camera": camera, "filename": name} | dict(zip("xyz", place, strict=True))
    if layout.turn == "opk":
        return last_named(rows.withColumns(more | dict(zip(ANGLES["opk"], turn, strict=True))))
    return last_named(with_turn(rows.withColumns(more | {"lon_": lon, "lat_": lat}), crs, F.col("lon_"), F.col("lat_"), turn))


def with_turn(rows: DataFrame, crs: C.Crs, lon: Column, lat: Column, turn: list[Column]) -> DataFrame:
    """Adds omega, phi and kappa of body angles (radians) at a place. North is a column of its own: angles name it many times."""
    x, y, _ = C.north(crs, lon, lat)
    rows = rows.withColumns({"north_x": x, "north_y": y})
    opk = A.rpy_to_opk(tuple(turn), [F.col("north_x"), F.col("north_y"), F.lit(0.0)])
    return rows.withColumns(dict(zip(ANGLES["opk"], opk, strict=True))).drop("north_x", "north_y")


def last_named(rows: DataFrame) -> DataFrame:
    """Of rows with one file name, the last by ord."""
    names = [*LEGACY[1:], "camera"]
    return rows.groupBy("filename").agg(F.max_by(F.struct(*names), "ord").alias("r")).select("filename", "r.*")


def sidecar(spark: SparkSession, path: str) -> C.Crs | None:
    """The projected system that a text file of the same name but .prj holds, if there is one."""
    prj = re.sub(r"\.[^./]*$", "", path) + ".prj"
    try:
        found = spark.read.text(prj, wholetext=True).first()
    except AnalysisException:
        return None
    if found is None:
        return None
    try:
        return C.projected(found["value"].strip())
    except CrsError as e:
        raise ParamError(f"{prj}: {e}") from e


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, value: the lines of a text file in order."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, crs: str | None = None, lla_crs: str = LLA, fields: tuple[str, ...] | None = None, delimiter: str | None = None, radians: bool = False) -> Exterior:
    """A table of positions: filename, x y z or latitude longitude altitude, angles in degrees, and perhaps camera.

    Without crs, a .prj file beside a table of x, y and z gives it, and the mean place of a table of latitudes and body
    angles gives a UTM zone; where neither helps and it is needed, CrsMissingError is raised.
    """
    C.geographic(lla_crs)
    system = C.projected(crs) if crs else None
    lines = numbered_lines(spark, path)
    head = "\n".join(r["value"] for r in lines.orderBy("ord").limit(200).select("value").collect())
    try:
        layout = layout_of(head, fields, delimiter)
    except ParamError as e:
        raise ParamError(f"{path}: {e}") from e
    first = lines.agg(F.min("ord")).first()[0]
    rows = parsed(lines.where(F.col("ord") > first) if layout.header else lines, layout)
    if system is None and layout.place == "xyz":
        system = sidecar(spark, path)
        if system is None and layout.turn == "rpy":
            raise CrsMissingError(f"{path}: body angles at projected places need a coordinate system")
    elif system is None:
        if layout.turn == "opk":
            raise CrsMissingError(f"{path}: angles need a coordinate system")
        system = mean_zone(rows, "latitude", "longitude")
    return Exterior(to_world(rows, layout, system, radians), system)


def mean_zone(rows: DataFrame, lat: str | Column, lon: str | Column) -> C.Crs:
    """The UTM zone of the mean place: one row comes to the driver."""
    mean = rows.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon")).first()
    if mean["lat"] is None:
        raise ParamError("No latitudes and longitudes")
    return C.utm_of(mean["lat"], mean["lon"])


SHOT = "struct<rotation:array<double>,translation:array<double>,camera:string>"
RECONSTRUCTION = f"array<struct<shots:map<string,{SHOT}>,reference_lla:struct<latitude:double,longitude:double,altitude:double>>>"


def camera_place(turn: list[Column], shift: list[Column]) -> list[Column]:
    """Where a camera is whose world-to-camera motion is a rotation vector and a translation."""
    return [-v for v in applied(transposed(A.angle_axis_rotation(*turn)), shift)]


def read_reconstruction(docs: DataFrame, crs: str | None = None) -> Exterior:
    """Shots of a reconstruction in JSON (value), moved to the world by its reference place."""
    one = docs.select(F.from_json("value", RECONSTRUCTION)[0].alias("d"))
    ref = one.select("d.reference_lla.*").first()
    if ref is None or None in tuple(ref):
        raise ParamError("A reconstruction needs reference_lla with latitude, longitude and altitude")
    system = C.projected(crs) if crs else C.utm_of(ref["latitude"], ref["longitude"])
    shots = one.select(F.explode("d.shots").alias("filename", "s"))
    bad = shots.where("s.camera is null or size(s.rotation) <> 3 or size(s.translation) <> 3 or s.rotation is null or s.translation is null").select("filename").first()
    if bad:
        raise ParamError(f"Shot {bad['filename']} needs rotation, translation and camera")
    turn, shift = ([F.col(f"s.{c}")[k] for k in range(3)] for c in ("rotation", "translation"))
    base = C.world_of(system, *(F.lit(float(ref[c])) for c in ("longitude", "latitude", "altitude")))
    xyz = [a + b for a, b in zip(camera_place(turn, shift), base, strict=True)]
    opk = A.angle_axis_opk(*turn)
    return Exterior(shots.select("filename", *(v.alias(n) for v, n in zip([*xyz, *opk], LEGACY[1:], strict=True)), X.plain_id(F.col("s.camera")).alias("camera")), system)


FEATURES = "type string, world_crs string, features array<struct<type:string,properties:struct<filename:string,camera:string,xyz:array<double>,opk:array<double>>>>"


def read_features(docs: DataFrame) -> Exterior:
    """Exterior parameters of a GeoJSON feature collection (value) whose world_crs names the system."""
    one = docs.select(F.from_json("value", FEATURES).alias("d"))
    head = one.select("d.type", "d.world_crs").first()
    if head is None or head["type"] != "FeatureCollection" or not head["world_crs"]:
        raise ParamError("A feature collection with world_crs is needed")
    f = one.select(F.posexplode("d.features").alias("ord", "f")).select("ord", "f.properties.*")
    bad = f.where("filename is null or xyz is null or opk is null or size(xyz) <> 3 or size(opk) <> 3").first()
    if bad:
        raise ParamError(f"Feature {bad['ord']} needs filename, xyz and opk")
    rows = f.select("ord", "filename", *(F.col("xyz")[k].alias(c) for k, c in enumerate("xyz")), *(F.col("opk")[k].alias(c) for k, c in enumerate(ANGLES["opk"])), "camera")
    return Exterior(last_named(rows), C.parse_crs(head["world_crs"]))


def read_tagged(images: DataFrame, crs: str | None = None) -> Exterior:
    """Exterior parameters of images with decoded tags (filename, lla, rpy and make, model, serial)."""
    missing = images.where("lla is null or rpy is null").select("filename").first()
    if missing:
        raise ParamError(f"{missing['filename']} has no tags of place, or of roll, pitch and yaw")
    lat, lon, alt = (F.col("lla")[k] for k in range(3))
    system = C.projected(crs) if crs else mean_zone(images, lat, lon)
    xyz = C.world_of(system, lon, lat, alt)
    camera = X.camera_id(F.col("make"), F.col("model"), F.col("serial"))
    rows = images.select("filename", "rpy", lon.alias("lon_"), lat.alias("lat_"), *(v.alias(n) for v, n in zip(xyz, "xyz", strict=True)), camera.alias("camera"))
    rows = with_turn(rows, system, F.col("lon_"), F.col("lat_"), [F.radians(F.col("rpy")[k]) for k in range(3)])
    return Exterior(rows.select("filename", *LEGACY[1:], "camera"), system)


def decode(images: DataFrame) -> DataFrame:
    """Images (filename, width, height, exif, xmp) with what their tags say of the camera."""
    d = T.decoded(F.col("exif"), F.col("xmp"), F.col("width"), F.col("height"))
    return images.select("filename", *(v.alias(n) for n, v in d.items()))


def interior_of(decoded: DataFrame) -> DataFrame:
    """filename, a camera's interior parameters and error, of decoded tags."""
    d = {c: F.col(c) for c in decoded.columns if c != "filename"}
    return decoded.select("filename", T.interior(d).alias("i")).select("filename", "i.*")

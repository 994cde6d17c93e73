"""Decoding of names, tags and options as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Millimetres of each unit of resolution in image tags: fixed values.
UNIT_MM = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}
#: Kinds of camera by the names that other software gives its projections: fixed names.
PROJECTIONS = {"perspective": "brown", "simple_radial": "brown", "radial": "brown", "brown": "brown", "fisheye": "fisheye", "fisheye_opencv": "fisheye"}
#: Namespaces of vendors' XMP keys, in order of preference, with the keys of place and body angles (a key that is misspelled
#: is so in files), of lens data, and what is added to the angles: fixed values.
VENDORS = (
    (
        "{http://www.dji.com/drone-dji/1.0/}",
        ("GpsLatitude", "GpsLongtitude", "AbsoluteAltitude"),
        ("GimbalRollDegree", "GimbalPitchDegree", "GimbalYawDegree"),
        "DewarpData",
        (0.0, 90.0, 0.0),
    ),
    ("{http://ns.sensefly.com/Camera/1.0/}", None, ("Roll", "Pitch", "Yaw"), None, (0.0, 0.0, 0.0)),
    ("{http://pix4d.com/camera/1.0/}", None, ("Roll", "Pitch", "Yaw"), None, (0.0, 0.0, 0.0)),
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def ortho_name(path: Column) -> Column:
    return F.concat(stem(file_name(path)), F.lit("_ORTHO.tif"))


def plain_id(camera: Column) -> Column:
    """A camera's id without the prefix of its format's second version."""
    return F.regexp_replace(camera, "^v2 ", "")


def projection_kind(name: Column) -> Column:
    """NULL for names that aren't known."""
    out = F.lit(None).cast("string")
    for k, v in PROJECTIONS.items():
        out = F.when(F.lower(F.trim(name)) == k, F.lit(v)).otherwise(out)
    return out


def numbers(text: Column) -> Column:
    """The numbers of "(24) (40) (49.0)" as an array."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(text, r"^\s*\(|\)\s*$", ""), r"\)\s*\(", "|"), r"\|"), lambda x: x.try_cast("double"))


def degrees(text: Column, ref: Column, positive: str) -> Column:
    """Decimal degrees of degrees, minutes and seconds; references outside positive are negative, an empty one isn't."""
    n = numbers(text)
    value = F.get(n, F.lit(0)) + F.get(n, F.lit(1)) / 60 + F.get(n, F.lit(2)) / 3600
    return F.when(F.lit(positive).contains(ref), value).otherwise(-value)


def altitude(text: Column, ref: Column) -> Column:
    """0 where there is none; below the sea where the reference is 1."""
    value = F.coalesce(F.get(numbers(text), F.lit(0)), F.lit(0.0))
    return F.when(F.coalesce(ref, F.lit("0")) == "1", -value).otherwise(value)


def sensor_size(pixels: Column, resolution: Column, unit: Column) -> Column:
    """Millimetres; NULL for unknown units."""
    mm = F.lit(None).cast("double")
    for k, v in UNIT_MM.items():
        mm = F.when(unit == k, F.lit(v)).otherwise(mm)
    return F.try_divide(mm * pixels, resolution)


def camera_id(make: Column, model: Column, serial: Column) -> Column:
    joined = F.concat_ws(" ", make, model, serial)
    return F.when(F.length(joined) > 0, joined).otherwise(F.lit("unknown"))


def _first_whole(tags: Column, sets) -> Column:
    """Of sets of three keys with offsets, the numbers of the first that is all there; else NULL."""
    found = []
    for keys, offsets in sets:
        values = [F.try_element_at(tags, F.lit(k)).try_cast("double") for k in keys]
        found.append(F.when(values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull(), F.array(*(v + o for v, o in zip(values, offsets, strict=True)))))
    return F.coalesce(*found)


def body_angles(tags: Column) -> Column:
    """array of roll, pitch and yaw in degrees from a map of XMP tags; of vendors, the first with all three."""
    return _first_whole(tags, [([space + k for k in angles], offsets) for space, _, angles, _, offsets in VENDORS])


def body_place(tags: Column) -> Column:
    """array of latitude, longitude and altitude from a map of XMP tags."""
    return _first_whole(tags, [([space + k for k in place], (0.0, 0.0, 0.0)) for space, place, _, _, _ in VENDORS if place])


def lens_data(tags: Column) -> Column:
    """The numbers of a vendor's lens data in a map of XMP tags."""
    return F.coalesce(*(dewarp(F.try_element_at(tags, F.lit(space + key))) for space, _, _, key, _ in VENDORS if key))


def dewarp(text: Column) -> Column:
    """The comma-separated numbers after the last semicolon."""
    return F.transform(F.split(F.element_at(F.split(text, ";"), -1), ","), lambda x: x.try_cast("double"))


def option(text: Column) -> tuple[Column, Column]:
    """Lower-case name and value of K=V; none, null and nil are NULL."""
    parts = F.split(text, "=", 2)
    value = F.trim(F.get(parts, F.lit(1)))
    return F.lower(F.trim(F.get(parts, F.lit(0)))), F.when(~F.lower(value).isin("none", "null", "nil"), value)


def table_format(fields: Column) -> Column:
    """Kind of a table of positions by its fields: where (xyz or lla), and which angles (opk or rpy)."""
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), fields)) == 0
    place = F.when(has("x", "y", "z"), "xyz").when(has("latitude", "longitude", "altitude"), "lla")
    turn = F.when(has("omega", "phi", "kappa"), "opk").when(has("roll", "pitch", "yaw"), "rpy")
    return F.when(F.array_contains(fields, "filename"), F.concat(place, F.lit("_"), turn))

"""Camera parameters of image tags as Columns.

Tags come as two maps of strings: of EXIF names to values, numbers in brackets, and of XMP names with their
namespace. A tag that is missing or malformed is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions import text as X
from terralith.functions.num import over

#: Width of the film that focal lengths in "35 mm" refer to: a fixed value.
FILM_MM = 36.0
LENS = ("k1", "k2", "p1", "p2", "k3")


def tag(exif: Column, name: str) -> Column:
    return F.try_element_at(exif, F.lit(f"EXIF_{name}"))


def number(exif: Column, name: str) -> Column:
    return F.get(X.numbers(tag(exif, name)), F.lit(0))


def whole(text: Column) -> Column:
    """An integer, decimal or 0x hexadecimal."""
    return F.when(F.lower(text).startswith("0x"), F.conv(F.substring(text, 3, 16), 16, 10)).otherwise(F.trim(text)).try_cast("int")


def pair(a: Column, b: Column) -> Column:
    """An array of two values, NULL if either is missing or 0."""
    return F.when((a != 0) & (b != 0), F.array(a, b))


def place(exif: Column) -> Column:
    """array of latitude, longitude (degrees) and altitude (metres) of EXIF tags."""
    names = [(f"GPS{c}", f"GPS{c}Ref", positive) for c, positive in (("Latitude", "NE"), ("Longitude", "NE"))]
    lat, lon = (X.degrees(tag(exif, a), tag(exif, ref), positive) for a, ref, positive in names)
    known = lat.isNotNull() & lon.isNotNull() & tag(exif, "GPSLatitudeRef").isNotNull() & tag(exif, "GPSLongitudeRef").isNotNull()
    return F.when(known, F.array(lat, lon, X.altitude(tag(exif, "GPSAltitude"), whole(tag(exif, "GPSAltitudeRef")).cast("string"))))


def decoded(exif: Column, xmp: Column, width: Column, height: Column) -> dict[str, Column]:
    """What an image's tags say of its camera, by name; XMP places go before EXIF ones."""
    tagged = pair(number(exif, "PixelXDimension"), number(exif, "PixelYDimension"))
    unit = whole(tag(exif, "FocalPlaneResolutionUnit"))
    sensor = [X.sensor_size(side.cast("double"), number(exif, f"FocalPlane{axis}Resolution"), unit) for side, axis in ((width, "X"), (height, "Y"))]
    return {
        "make": F.lower(tag(exif, "Make")),
        "model": F.lower(tag(exif, "Model")),
        "serial": tag(exif, "BodySerialNumber"),
        "im_size": F.array(width.cast("int"), height.cast("int")),
        "tag_im_size": tagged.cast("array<int>"),
        "sensor_size": F.when(sensor[0].isNotNull() & sensor[1].isNotNull(), F.array(*sensor)),
        "focal_len": number(exif, "FocalLength"),
        "focal_len_35": number(exif, "FocalLengthIn35mmFilm"),
        "orientation": whole(tag(exif, "Orientation")),
        "lla": F.coalesce(X.body_place(xmp), place(exif)),
        "rpy": X.body_angles(xmp),
        "dewarp": X.lens_data(xmp),
    }


def interior(d: dict[str, Column]) -> Column:
    """struct of a camera's interior parameters from decoded tags.

    Lens data of nine numbers and a tagged size give a brown camera; else focal length and sensor size, or the 35 mm
    focal length, a pinhole. error says what is missing where neither is there.
    """
    lens, tagged = d["dewarp"], d["tag_im_size"].cast("array<double>")
    has_lens = (F.size(lens) == 9) & F.exists(lens, lambda x: x != 0) & tagged.isNotNull()
    widest, longest = F.array_max(d["sensor_size"]), F.array_max(tagged)
    direct = (d["focal_len"] != 0) & d["sensor_size"].isNotNull()
    film = d["focal_len_35"] != 0
    focal = F.when(has_lens, F.slice(lens, 1, 2)).when(direct, F.array(d["focal_len"])).when(film, F.array(F.coalesce(widest * d["focal_len_35"], d["focal_len_35"]) / FILM_MM))
    fields = [
        X.camera_id(d["make"], d["model"], d["serial"]).alias("camera"),
        F.when(has_lens, "brown").when(direct | film, "pinhole").alias("kind"),
        d["im_size"].alias("im_size"),
        focal.alias("focal_len"),
        F.when(has_lens, tagged).otherwise(d["sensor_size"]).alias("sensor_size"),
        *(F.when(has_lens, over(F.get(lens, F.lit(2 + k)), longest)).alias(c) for k, c in enumerate(("cx", "cy"))),
        *(F.when(has_lens, F.get(lens, F.lit(4 + k))).alias(c) for k, c in enumerate(LENS)),
        F.when(focal.isNull(), "No focal length and sensor size, or 35 mm focal length").alias("error"),
    ]
    return F.struct(*fields)


def described(filename: Column, d: dict[str, Column]) -> Column:
    """A text of several lines for people."""
    numbers = lambda c: F.coalesce(F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), ", "), F.lit(")")), F.lit("None"))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    lines = [("Image", filename), ("Camera", F.concat_ws(" ", d["make"], d["model"])), ("Focal length", plain(d["focal_len"])), ("35 mm focal length", plain(d["focal_len_35"])), ("Orientation", plain(d["orientation"]))]
    lines += [("Latitude, longitude, altitude", numbers(d["lla"])), ("Roll, pitch, yaw", numbers(d["rpy"])), ("Lens data", numbers(d["dewarp"]))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in lines))

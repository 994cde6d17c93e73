"""Checks of images, rasters and points, and affine transforms, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.errors import ParamError

#: The longest side of an image, and the types of pixels: fixed values.
LONGEST = 32767
DTYPES = ("uint8", "uint16", "int16", "float32", "float64")


def image_fits(width: Column, height: Column, dtype: Column) -> Column:
    """Whether an image is of a supported type, with sides that aren't too long."""
    return (F.greatest(width, height) <= LONGEST) & dtype.isin(*DTYPES)


def too_coarse(resolution: Column, extent: Column) -> Column:
    """Whether cells are larger than what they should cover."""
    return resolution > extent


def colour_bands(alpha: Column) -> Column:
    """array of the numbers of bands that aren't alpha."""
    return F.filter(F.transform(alpha, lambda a, k: F.when(~a, k + 1)), lambda k: k.isNotNull())


def need_columns(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of points, whose coordinates are numbers in columns of these names; else ParamError."""
    types = dict(rows.dtypes)
    bad = [n for n in names if types.get(n) not in ("double", "float", "bigint", "int")]
    if bad:
        raise ParamError(f"Points need numbers in {', '.join(bad)}")
    return rows


def world_points(rows: DataFrame) -> DataFrame:
    return need_columns(rows, "x", "y", "z")


def pixel_points(rows: DataFrame) -> DataFrame:
    return need_columns(rows, "j", "i")


Affine = tuple[float, float, float, float, float, float]


def affine(t: Affine, j: Column, i: Column) -> tuple[Column, Column]:
    """Where the centre of a pixel lies: transforms (x = a j + b i + c, y = d j + e i + f) address corners."""
    a, b, c, d, e, f = t
    return c + a * (j + 0.5) + b * (i + 0.5), f + d * (j + 0.5) + e * (i + 0.5)


def affine_inverse(t: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    """The pixel whose centre lies at a place."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    if not det:
        raise ParamError("A transform that maps all pixels to a line has no inverse")
    u, v = x - c, y - f
    return (e * u - b * v) / det - 0.5, (a * v - d * u) / det - 0.5

"""Cameras from control points alone: polynomials between the world and pixels, fitted for each image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.num import total
from terralith.operators.groups import in_batches

#: Control points that polynomials of each order need at least: fixed values.
LEAST = {1: 3, 2: 6, 3: 10}


def powers(order: int) -> list[tuple[int, int]]:
    """Exponents of x and y in a polynomial's terms."""
    return [(a, n - a) for n in range(order + 1) for a in range(n, -1, -1)]


def order_for(points: int, most: int = 3) -> int:
    """The highest order that so many points allow; 0 if there are too few."""
    return max((k for k, n in LEAST.items() if k <= most and points >= n), default=0)


def _solve(design: np.ndarray, outs: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Least squares of the least norm, a stack of images at once: rows of zeros after an image's own change nothing."""
    inverse = np.linalg.pinv(design, rcond=np.finfo(float).eps * np.maximum(counts, design.shape[2]))
    return [np.einsum("ntp,np->nt", inverse, out) for out in outs]


def fit(gcps: DataFrame, most: int = 3) -> DataFrame:
    """filename, points, order, and polynomials of normalised coordinates, of images with at least three points.

    gcps: filename, j, i, lon, lat. to_j and to_i go from the world to pixels, to_lon and to_lat back; centre and scale
    (lon, lat, j, i) normalise. An image's control points are few; images are fitted many at a time, in stacks of like
    numbers of points.
    """
    lists = ("centre", "scale", "to_j", "to_i", "to_lon", "to_lat")
    ddl = "filename string, points int, order int, " + ", ".join(f"{c} array<double>" for c in lists)
    schema = pa.schema([("filename", pa.string()), ("points", pa.int32()), ("order", pa.int32()), *((c, pa.list_(pa.float64())) for c in lists)])

    def stack(t: pa.Table, starts: np.ndarray, counts: np.ndarray, order: int) -> pa.Table:
        place = np.arange(counts.max())
        own = place < counts[:, None]
        at = np.where(own, starts[:, None] + place, 0)
        xy = {c: np.where(own, t.column(c).to_numpy().astype(float)[at], 0.0) for c in ("lon", "lat", "j", "i")}
        centre = {c: v.sum(1) / counts for c, v in xy.items()}
        n = {c: np.where(own, v - centre[c][:, None], 0.0) for c, v in xy.items()}
        scale = {c: np.maximum(np.abs(v).max(1), 1e-12) for c, v in n.items()}
        n = {c: v / scale[c][:, None] for c, v in n.items()}
        design = lambda x, y: np.stack([np.where(own, x**a * y**b, 0.0) for a, b in powers(order)], 2)
        to = [*_solve(design(n["lon"], n["lat"]), [n["j"], n["i"]], counts), *_solve(design(n["j"], n["i"]), [n["lon"], n["lat"]], counts)]
        values = [np.stack(list(centre.values()), 1), np.stack(list(scale.values()), 1), *to]
        arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in values]
        return pa.table([t.column("filename").take(pa.array(starts)).cast(pa.string()), pa.array(counts.astype(np.int32)), pa.array(np.full(len(counts), order, np.int32)), *arrays], schema=schema)

    def all_(t: pa.Table, starts: np.ndarray) -> pa.Table:
        counts = np.diff(np.r_[starts, t.num_rows])
        order = np.array([order_for(c, most) for c in counts])
        # images of a stack have at most twice as many points as one another, and take about as much room as the table
        like = order * 64 + np.ceil(np.log2(counts)).astype(int)
        parts = [stack(t, starts[mine], counts[mine], int(order[mine][0])) for mine in (like == k for k in np.unique(like[order > 0]))]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return in_batches(gcps.select("filename", "j", "i", "lon", "lat"), "filename", all_, ddl)


def _value(c: Column, x: Column, y: Column, most: int = 3) -> Column:
    """A polynomial of up to so high an order; terms beyond the coefficients count as 0."""
    power = lambda v, n: F.lit(1.0) if n == 0 else v if n == 1 else v * v if n == 2 else v * v * v
    return total(F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) * power(x, a) * power(y, b) for k, (a, b) in enumerate(powers(most)))


def _normalised(v: Column, k: int) -> Column:
    return (v - F.col("centre")[k]) / F.col("scale")[k]


def _back(v: Column, k: int) -> Column:
    return v * F.col("scale")[k] + F.col("centre")[k]


def to_pixel(lon: Column, lat: Column) -> tuple[Column, Column]:
    """j and i of a place by the polynomials of the same row."""
    x, y = _normalised(lon, 0), _normalised(lat, 1)
    return _back(_value(F.col("to_j"), x, y), 2), _back(_value(F.col("to_i"), x, y), 3)


def to_world(j: Column, i: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel by the polynomials of the same row."""
    x, y = _normalised(j, 2), _normalised(i, 3)
    return _back(_value(F.col("to_lon"), x, y), 0), _back(_value(F.col("to_lat"), x, y), 1)

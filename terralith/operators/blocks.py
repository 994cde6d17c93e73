"""Resampling and neighbourhoods on blocks of rasters: dense arrays of bounded size, in Arrow groups.

A raster is cut into square blocks. Pixels near an edge go to the block beside it too, so that a block holds all that
the cells that begin in it need. Images and bands are keys of the blocks: any number of rasters goes in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

#: Pixels along a block's side. A dense block of doubles then takes half a megabyte.
SIDE = 256
#: Rasters (images and bands) that a task takes at once where cells are the same for all.
TOGETHER = 16


def cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Weight of the cubic convolution kernel at a distance."""
    d = np.abs(t)
    near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def linear(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(t))


def lanczos(t: np.ndarray, lobes: int = 4) -> np.ndarray:
    return np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)


KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {"bilinear": (1, linear), "cubic": (2, cubic), "lanczos": (4, lanczos)}


def _codes(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different row of some columns, and where each first occurs."""
    code = np.zeros(table.num_rows, np.int64)
    for n in names:
        part = table.column(n).combine_chunks().dictionary_encode()
        code = code * (len(part.dictionary) + 1) + part.indices.fill_null(len(part.dictionary)).to_numpy(zero_copy_only=False)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, first


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def interpolated(cells: DataFrame, source: DataFrame, kernel: str, by: list[str] | None = None) -> DataFrame:
    """Cells (j, i in the source's pixels, and others) with v: a weighted mean of the source's pixels around each.

    by: columns that cells and source share, such as the image; other columns of the source, such as the band, multiply
    the cells. A cell with a tap outside the source or on a masked pixel is left out. Without such columns, cells are sent
    once for some rasters each, so that a task holds these rasters' block and no more, however many there are.
    """
    by = by or []
    reach, weight = KERNELS[kernel]
    taps = 2 * reach
    per = [c for c in source.columns if c not in (*by, "i", "j", "v")]
    kept = [f for f in cells.schema.fields if f.name not in ("i", "j")]
    asked = cells.where("i is not null and j is not null")
    asked = asked.select(*cells.columns, F.expr(f"floor((floor(i) - {reach - 1}) / {SIDE})").cast("long").alias("block_i"), F.expr(f"floor((floor(j) - {reach - 1}) / {SIDE})").cast("long").alias("block_j"))
    at = source.where("v is not null").select(*by, *per, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    for c in "ij":
        own = F.expr(f"floor({c} / {SIDE})").cast("long")
        near = F.when(F.pmod(F.col(c), F.lit(SIDE)) < taps - 1, F.array(own, own - 1)).otherwise(F.array(own))
        at = at.withColumn(f"block_{c}", F.explode(near))
    schema = st.StructType([*kept, *(source.schema[c] for c in per), st.StructField("v", st.DoubleType())])
    names = [f.name for f in kept]
    keys = [*by, "block_i", "block_j"]
    deals = -(-source.select(*per).distinct().count() // TOGETHER) if per and not by else 1
    if deals > 1:
        at = at.withColumn("block_deal", F.pmod(F.xxhash64(*per), F.lit(deals)).cast("long"))
        asked = asked.withColumn("block_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<long>")))
        keys.append("block_deal")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            top, edge = (int(right.column(f"block_{c}")[0].as_py()) * SIDE for c in "ij")
            y, x = _numbers(left, "i").astype(float), _numbers(left, "j").astype(float)
            i0, j0 = np.floor(y).astype(np.int64) - (reach - 1), np.floor(x).astype(np.int64) - (reach - 1)
            wy = [weight(y - (i0 + k)) for k in range(taps)]
            wx = [weight(x - (j0 + k)) for k in range(taps)]
            code, first = _codes(right, per)
            side = SIDE + taps
            rows, ends = np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))
            for k in range(len(first)):
                mine = rows[ends[k - 1] if k else 0 : ends[k]]
                dense = np.full((side, side), np.nan)
                dense[_numbers(right, "i")[mine] - top, _numbers(right, "j")[mine] - edge] = _numbers(right, "v")[mine]
                total, size = np.zeros(len(y)), np.zeros(len(y))
                for a in range(taps):
                    for b in range(taps):
                        w = wy[a] * wx[b]
                        total += dense[i0 - top + a, j0 - edge + b] * w
                        size += w
                ok = np.flatnonzero(~np.isnan(total))
                cols = [left.column(n).take(pa.array(ok)).combine_chunks() for n in names]
                cols += [right.column(c).take(pa.array(np.full(len(ok), first[k]))).combine_chunks() for c in per]
                parts.append(pa.table([*cols, pa.array(total[ok] / size[ok])], names=[*names, *per, "v"]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table([*(left.column(n).slice(0, 0) for n in names), *(right.column(c).slice(0, 0) for c in per), pa.array([], pa.float64())], names=[*names, *per, "v"])

    return asked.groupBy(*keys).cogroup(at.groupBy(*keys)).applyInArrow(run, schema)


def around(source: DataFrame, reach: int, change: Callable[[np.ndarray], np.ndarray], by: list[str] | None = None, value: str = "v") -> DataFrame:
    """by, i, j and value of each pixel after a change of dense blocks that looks at most reach pixels far.

    change gets a block with a margin, not-a-number where there is no pixel, and returns one of the same shape.
    """
    by = by or []
    if reach >= SIDE:
        raise ValueError(f"A neighbourhood reaches less than {SIDE} pixels")
    at = source.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias("v"))
    for c in "ij":
        own, place = F.expr(f"floor({c} / {SIDE})").cast("long"), F.pmod(F.col(c), F.lit(SIDE))
        near = F.filter(F.array(own, F.when(place < reach, own - 1), F.when(place >= SIDE - reach, own + 1)), lambda b: b.isNotNull())
        at = at.withColumn(f"block_{c}", F.explode(near))
    schema = st.StructType([*(source.schema[c] for c in by), st.StructField("i", st.LongType()), st.StructField("j", st.LongType()), st.StructField(value, st.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        top, edge = (int(t.column(f"block_{c}")[0].as_py()) * SIDE for c in "ij")
        i, j = _numbers(t, "i"), _numbers(t, "j")
        dense = np.full((SIDE + 2 * reach,) * 2, np.nan)
        dense[i - top + reach, j - edge + reach] = _numbers(t, "v")
        out = change(dense)
        own = np.flatnonzero((i >= top) & (i < top + SIDE) & (j >= edge) & (j < edge + SIDE))
        values = out[i[own] - top + reach, j[own] - edge + reach]
        rows = t.take(pa.array(own))
        return pa.table([*(rows.column(c) for c in by), rows.column("i"), rows.column("j"), pa.array(values, from_pandas=True)], names=[*by, "i", "j", value])

    return at.groupBy(*by, "block_i", "block_j").applyInArrow(run, schema)


def widest(reach: int) -> Callable[[np.ndarray], np.ndarray]:
    """The maximum in a square of 2*reach+1 pixels, a side at a time."""

    def change(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.nan)
            out = a
            for k in range(2 * reach + 1):
                out = np.fmax(out, np.take(padded, np.arange(k, k + a.shape[axis]), axis))
            a = out
        return a

    return change

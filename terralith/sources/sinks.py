"""Rasters as files: profiles of outputs, and tiles that executors write each on its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.errors import ParamError
from terralith.operators.orthorectify import TILE
from terralith.sources import store, tiff

#: What masked pixels hold by type of sample: fixed values.
NODATA = {"uint8": 0, "uint16": 0, "int16": -32768, "float32": float("nan"), "float64": float("nan")}


def profile(dtype: str, bands: int, compress: str | None = None, mask: bool | None = None, options: dict | None = None) -> dict:
    """Settings of an output: jpeg for bytes, else deflate; a mask goes with jpeg, else a value that marks masked pixels.

    Given options replace all but the type, the bands and the mask.
    """
    if dtype not in NODATA:
        raise ParamError(f"Images of {dtype} aren't supported")
    way = compress or ("jpeg" if dtype == "uint8" else "deflate")
    if way == "jpeg" and dtype not in ("uint8", "uint16"):
        raise ParamError(f"{dtype} can't be compressed by jpeg")
    mask = way == "jpeg" if mask is None else mask
    base = {"dtype": dtype, "bands": bands, "nodata": None if mask else NODATA[dtype], "mask": mask}
    if options is not None:
        return base | options
    more = {"compress": way, "tiled": True, "blocksize": TILE, "bigtiff": "if_safer"}
    if way == "jpeg":
        more |= {"photometric": "ycbcr" if bands == 3 else None, "nbits": 12 if dtype == "uint16" else None}
    return base | {k: v for k, v in more.items() if v is not None}


def converted(a: np.ndarray, dtype: str) -> np.ndarray:
    """Floats as another type: rounded half to even and cut to its range; not-a-number is the mark of masked pixels."""
    if dtype.startswith("float"):
        return a.astype(dtype)
    low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
    return np.where(np.isnan(a), NODATA[dtype], np.clip(np.rint(np.nan_to_num(a)), low, high)).astype(dtype)


def write_tiles(pixels: DataFrame, grids: DataFrame, folder: str, dtype: str = "float32", epsg: int | None = None, tile: int = TILE, overwrite: bool = False) -> DataFrame:
    """Pixels (image, band, r, c, v) as GeoTIFF files of at most tile x tile cells, and a table of them.

    image, path, tile_r, tile_c, rows, cols, n (cells with a value). A tile is written under another name and then
    moved, so that a task that is run again leaves whole files. Files are deflated; masked cells hold the type's mark.
    The writing is done when the table is made.
    """
    spark = pixels.sparkSession
    if store.exists(spark, folder) and not overwrite:
        raise FileExistsError(folder)
    if dtype not in NODATA:
        raise ParamError(f"Images of {dtype} aren't supported")
    bands = F.broadcast(pixels.agg(F.max("band").alias("bands")))
    rows = pixels.join(grids.where("reason is null").select("image", "x0", "y0", "res", "rows", "cols"), "image").join(bands)
    rows = rows.select("image", "band", "r", "c", "v", "x0", "y0", "res", "rows", "cols", "bands", F.expr(f"r div {tile}").alias("tile_r"), F.expr(f"c div {tile}").alias("tile_c"))
    kind = pixels.schema["image"].dataType.simpleString()
    nodata = NODATA[dtype]

    def run(t: pa.Table) -> pa.Table:
        one = {c: t.column(c)[0].as_py() for c in ("image", "x0", "y0", "res", "rows", "cols", "bands", "tile_r", "tile_c")}
        top, left = one["tile_r"] * tile, one["tile_c"] * tile
        high, wide = min(tile, one["rows"] - top), min(tile, one["cols"] - left)
        a = np.full((one["bands"], high, wide), np.nan)
        band, r, c = (t.column(n).to_numpy() for n in ("band", "r", "c"))
        a[band - 1, r - top, c - left] = t.column("v").to_numpy()
        data = tiff.write(converted(a, dtype), [one["res"], 0.0, one["x0"] + left * one["res"], 0.0, -one["res"], one["y0"] - top * one["res"]], epsg, nodata, photometric=2 if one["bands"] == 3 and dtype == "uint8" else 1)
        stem = str(one["image"]).rsplit("/", 1)[-1]
        stem = stem[: stem.rfind(".")] if "." in stem else stem
        path = f"{folder.rstrip('/')}/{stem}_ORTHO/{one['tile_r']}_{one['tile_c']}.tif"
        write_file(path, data)
        n = int((~np.isnan(a)).any(0).sum())
        return pa.table({"image": [one["image"]], "path": [path], "tile_r": [one["tile_r"]], "tile_c": [one["tile_c"]], "rows": [high], "cols": [wide], "n": [n]})

    return rows.groupBy("image", "tile_r", "tile_c").applyInArrow(run, f"image {kind}, path string, tile_r long, tile_c long, rows long, cols long, n long")


def write_file(path: str, data: bytes) -> None:
    """Writes a file from a task: all of it or nothing."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    import uuid

    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)

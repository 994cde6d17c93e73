"""Files as DataFrames: whole texts, and the heads and pixels of image files, on executors, by glob."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.errors import ParamError
from terralith.functions.text import file_name
from terralith.sources import tiff

RPC_STRUCT = "struct<" + ", ".join([*(f"{n}: double" for n in tiff.RPC_ORDER), *(f"{n}: array<double>" for n in tiff.RPC_LISTS)]) + ">"
HEAD_DDL = f"path string, width int, height int, bands int, dtype string, exif map<string,string>, xmp map<string,string>, rpc {RPC_STRUCT}, gcps array<array<double>>, epsg int, transform array<double>, nodata double"


def texts(spark: SparkSession, glob: str) -> DataFrame:
    """path, value: a row a file."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


#: Bytes from which on a text is read in blocks, if its lines allow it: a smaller one is a row.
LARGE = 8 << 20


def large(spark: SparkSession, glob: str, least: int = LARGE) -> tuple[list[str], list[str]]:
    """The files of a path or wildcard with so many bytes at least, and the others, as paths without wildcards."""
    found = spark.read.format("binaryFile").load(glob).select("path", "length").collect()
    escaped = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", p)
    return tuple([escaped(r["path"]) for r in found if (r["length"] >= least) == big] for big in (True, False))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, start, at, value: the lines of a file in blocks, where each block starts, and the lines' order in a block."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def paths(spark: SparkSession, globs: str | Iterable[str]) -> DataFrame:
    """ord, path: the files that paths and wildcards name, in the order given; one that names none is an error."""
    found = []
    for k, g in enumerate([globs] if isinstance(globs, str) else globs):
        p = spark._jvm.org.apache.hadoop.fs.Path(g)
        got = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        names = sorted(s.getPath().toString() for s in got or ())
        if not names:
            raise FileNotFoundError(g)
        found += [(k, n) for n in names]
    return spark.createDataFrame([(i, n) for i, (_, n) in enumerate(found)], "ord int, path string")


def binaries(spark: SparkSession, globs: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(globs).select("path", "content")


def odm_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length: the images of a dataset folder, by their extensions."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/images").select("path", "length")
    return names.where(F.lower("path").rlike(r"\.(jpe?g|tiff?)$"))


def read_heads(spark: SparkSession, globs: str | list[str]) -> DataFrame:
    """filename and what the heads of image files say: size, tags, models, control points and georeferencing."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = tiff.head_of(bytes(content))
                except ParamError as e:
                    raise ParamError(f"{path}: {e}") from e
                gcps = [list(map(float, g)) for g in h.gcps]
                rows.append((path, h.width, h.height, h.bands, h.dtype, h.exif, h.xmp, h.rpc, gcps, h.epsg, h.transform, h.nodata))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bands", "dtype", "exif", "xmp", "rpc", "gcps", "epsg", "transform", "nodata"])

    return binaries(spark, globs).mapInPandas(run, HEAD_DDL).select(file_name(F.col("path")).alias("filename"), "*")


def read_rasters(spark: SparkSession, globs: str | list[str], bands: list[int] | None = None) -> DataFrame:
    """path, band, i, v: a row a line of a band (1 first), for all TIFF files; explode v for pixels. Masked values are NULL."""

    schema = pa.schema([("path", pa.string()), ("band", pa.int32()), ("i", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                image, nodata = tiff.read_pixels(data), tiff.head_of(data).nodata
                if bands and not set(bands) <= set(range(1, len(image) + 1)):
                    raise ParamError(f"{path} has {len(image)} bands, not {bands}")
                for k in bands or range(1, len(image) + 1):
                    band = image[k - 1].astype(float)
                    if nodata is not None:
                        band[band == nodata] = np.nan
                    # lines of a band at a time: offsets of lists stay small
                    for at in range(0, len(band), 256):
                        part = band[at : at + 256]
                        n, cols = part.shape
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * cols, pa.int32()), pa.array(part.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.full(n, k), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), lists], schema=schema)

    lines = binaries(spark, globs).mapInArrow(run, "path string, band int, i long, v array<double>")
    return lines.withColumn("v", F.transform("v", lambda x: F.when(~F.isnan(x), x)))


def pixels_of(lines: DataFrame, keys: tuple[str, ...] = ("path", "band")) -> DataFrame:
    """A row a pixel that isn't masked, of lines."""
    return lines.select(*keys, "i", F.posexplode("v").alias("j", "v")).select(*keys, "i", F.col("j").cast("long").alias("j"), "v").where("v is not null")

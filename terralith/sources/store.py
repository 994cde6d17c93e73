"""Single files in any store that Spark can reach, through its file systems."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def write_text(spark: SparkSession, path: str, parts: Iterable[str], overwrite: bool = False) -> None:
    """Writes a text, part by part; a file that is there is an error unless it may be overwritten."""
    p, fs = _at(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path, wholetext=True).first()
    return found["value"] if found else ""


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir, or on one machine a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = tempfile.mkdtemp(prefix="terralith-")
    return joined(folder, f"files-{uuid.uuid4().hex}")


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    p, fs = _at(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_rows(rows: DataFrame, path: str, head: str = "", between: str = "\n", tail: str = "\n", overwrite: bool = False) -> None:
    """One text file of rows (value) in their order: executors write parts, whose bytes the driver's JVM then joins.

    A separator stands between rows; no row comes to the driver, and it holds a buffer of the bytes at a time.
    """
    spark = rows.sparkSession
    p, fs = _at(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    parts, _ = _at(spark, joined(p.getParent().toString(), f"_parts-{uuid.uuid4().hex}"))
    try:
        rows.select("value").write.option("lineSep", between).option("compression", "none").text(parts.toString())
        found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen())
        out = fs.create(p, True)
        try:
            out.write(bytearray(head.encode()))
            for k, (name, size) in enumerate(found):
                part = fs.open(spark._jvm.org.apache.hadoop.fs.Path(parts, name))
                try:
                    # no separator follows the last row
                    own = part if k < len(found) - 1 else spark._jvm.org.apache.commons.io.input.BoundedInputStream(part, size - len(between.encode()))
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 20, False)
                finally:
                    part.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
    finally:
        fs.delete(parts, True)

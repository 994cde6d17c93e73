"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine, as in tests, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.terralith.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = tempfile.mkdtemp(prefix="terralith-")
        spark.conf.set("spark.terralith.folder", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder. Lineage ends there, and so does the plan.

    A checkpoint would carry on the constraints that the optimizer has inferred, which loops of joins multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/terralith-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by kept() that nothing refers to any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of rounds that nothing refers to any more, instead of when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable over edges (u long, v long), for nodes that have an edge.

    Each round contracts the graph: every root hooks to the least root next to it, chains of hooks are
    shortened by pointer jumping, and edges inside a tree go. Rounds grow with the logarithm of the
    nodes. Nothing is collected but row counts.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = kept(edges)
    labels = kept(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")))
    while left.limit(1).count():
        hooks = kept(left.groupBy("v").agg(F.min("u").alias("to"), F.lit(True).alias("moved")))
        while hooks.where("moved").limit(1).count():
            up = hooks.select(F.col("v").alias("to"), F.col("to").alias("next"))
            longer = kept(hooks.drop("moved").join(up, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            dropped(hooks)
            hooks = longer
        up = hooks.select(F.col("v").alias("label"), F.col("to"))
        named = kept(labels.join(up, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a, b = (hooks.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to")) for c in "uv")
        rest = left.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))
        rest = kept(rest.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        dropped(labels, left, hooks)
        labels, left = named, rest
    dropped(left)
    return labels

"""Mixing sources to target weights on a low-discrepancy schedule.

Each source's documents are put in a shuffled order end to end and cut into blocks of equally many
words. Slots of the schedule are golden-ratio points mapped through the sources' cumulative weights;
a source's slots are ranked, and the slot of rank r takes the block r modulo the number of blocks,
so that blocks repeat evenly. All sums run in two levels (bucket totals, then rows of a bucket),
so that a source with a third of all rows is spread like others.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm import _graph as G

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, LEAST_BLOCKS = 2048, 1024
#: Golden ratio of 2**31, made odd; slots are taken modulo 2**30 so that products stay below 2**63.
STEP, RING = 1327217885, 1 << 31
CHUNK = 1 << 16


def fill_targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of a total by weight, none above most times its size; the excess is reshared by weight."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


class Mix(NamedTuple):
    #: Every row with size, sid (its source's number), source_size, target, at (the words before it in its source) and
    #: row (a struct of the columns passed)
    rows: DataFrame
    #: slot, sid, epoch, block, at (of the row), start and stop (words of the row that the slot takes)
    schedule: DataFrame


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, passed: tuple[str, ...] = ()) -> Mix:
    """A mix of all sources that has as many words as docs.

    docs: doc_id, text and source; passed names the columns, whatever they are, that rows keep in the struct row. Sources in order of code
    point, null last, weigh as weights says, repeating; no target exceeds most times its source's words.
    A null or empty text has no words: it is in rows and never taken. Repeated rows are separate. Ties in
    the shuffled order are broken by doc_id, size and checksum. There is one row for each source on the
    driver. An empty table gives empty results. The same rows give the same mix.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(
        "doc_id",
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(key, F.lit(seed)).alias("_h"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"),
        F.struct(*(passed or ["doc_id"])).alias("row"),
    )
    rows = G.kept(rows)
    sources = sorted((r["_source"], r["n"]) for r in rows.groupBy("_source").agg(F.sum("size").alias("n")).collect())
    sizes = [s for _, s in sources]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], sum(sizes), most)
    block = [max(1, min(BLOCK_WORDS, s // LEAST_BLOCKS)) for s in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, block, strict=True)]
    quota = [round(t * k / s) if s else 0 for t, k, s in zip(targets, blocks, sizes, strict=True)]
    info = spark.createDataFrame(
        [(name, i, s, t, b, k, q) for i, ((name, s), t, b, k, q) in enumerate(zip(sources, targets, block, blocks, quota, strict=True))],
        "_source string, sid int, source_size long, target double, _block long, _blocks long, _quota long",
    )

    buckets = max(64, 4 * n)
    placed = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    bucket = placed.groupBy("_source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("_source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_b").orderBy("_h", "doc_id", "size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bucket, ["_source", "_b"])
    placed = placed.join(info, "_source").withColumn("at", F.col("_before") + F.col("_in")).drop("_b", "_before", "_in", "_h", "_source")

    slots = _slots(spark, quota, n).join(info.select("sid", "_blocks", "_quota"), "sid").where("rank < _quota")
    slots = slots.select("slot", "sid", (F.expr("rank div _blocks")).alias("epoch"), F.pmod("rank", "_blocks").alias("block"))
    parts = placed.where("size > 0").select("sid", "at", "size", "_block", F.explode(F.sequence(F.expr("at div _block"), F.expr("(at + size - 1) div _block"))).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * F.col("_block") - F.col("at"))
    stop = F.least(F.col("size"), (F.col("block") + 1) * F.col("_block") - F.col("at"))
    schedule = slots.join(parts, ["sid", "block"]).select("slot", "sid", "epoch", "block", "at", start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    return Mix(placed.drop("_block", "_blocks", "_quota", "_crc"), schedule)


def _slots(spark: SparkSession, quota: list[int], n: int) -> DataFrame:
    """slot, sid and rank among the source's slots, for every slot; a source short of its quota gets slots at the end."""
    total = sum(quota)
    bounds = np.cumsum(quota)

    @F.pandas_udf("int")
    def source_of(point: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds, point.to_numpy() * (total / RING), "right"), len(bounds) - 1))

    slots = spark.range(0, total, 1, max(1, min(n, -(-total // CHUNK)))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("sid", source_of(F.pmod(F.pmod("slot", F.lit(RING // 2)) * STEP, F.lit(RING)))).withColumn("_c", F.expr(f"slot div {CHUNK}"))
    counts = slots.groupBy("sid", "_c").count()
    before = Window.partitionBy("sid").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("sid", "_c", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = slots.withColumn("_in", F.row_number().over(Window.partitionBy("sid", "_c").orderBy("slot"))).join(base, ["sid", "_c"])
    ranked = ranked.select("slot", "sid", (F.col("_base") + F.col("_in") - 1).alias("rank"))
    have = {r["sid"]: r["n"] for r in counts.groupBy("sid").agg(F.sum("count").alias("n")).collect()}
    more, at = [], total
    for sid, q in enumerate(quota):
        if have.get(sid, 0) < q:
            more.append((sid, have.get(sid, 0), q - 1, at))
            at += q - have.get(sid, 0)
    tail = spark.createDataFrame(more, "sid int, lo long, hi long, at long").select("sid", "at", "lo", F.explode(F.sequence("lo", "hi")).alias("rank"))
    return ranked.unionByName(tail.select((F.col("at") + F.col("rank") - F.col("lo")).alias("slot"), "sid", "rank"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mix.schedule.groupBy("sid", "at").agg(F.sum(F.col("stop") - F.col("start")).alias("taken")).withColumn("_full", F.lit(True))
    out = mix.rows.withColumn("_full", F.col("size") > 0).join(taken, ["sid", "at", "_full"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

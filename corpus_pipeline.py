"""A corpus pipeline: language ID, near duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents. Text alone decides in the filters, whatever the ids: rows with null or shared
ids and further columns pass through them, and of repeated rows one stays. Stage results are Parquet tables in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import _graph, language_id, ngram_join, ring_shards, source_mix, tiling

SHARDS = 40
#: SQL can't express the classifier that the first stage trains; tests hold each stage against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language go on, with all their columns; null, empty and letterless texts don't.

    Text alone decides: neither ids nor lang of the row itself. Repeated rows and equal texts fare alike, a very long
    text is judged whole. Where no row has a lang to learn from, nothing can be rejected and all rows stay.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"), ~language_id.held_out())
    if not model.names:
        return docs
    return language_id.speaking(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least doc_id stays (null is the least); of rows that share it, one.

    Each row is a vertex of its own, by a number that is written before it is used: neither null nor shared ids
    join rows, similar texts alone do. A text without words is similar to none.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("all"), F.monotonically_increasing_id().alias("key"))
    rows = _graph.kept(rows)
    groups = ngram_join.ngram_jaccard_join(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), k=5, percent=75)
    order = rows.select("key", F.struct(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text"), "all", "key").alias("order"))
    named = _graph.kept(order.join(groups.select(F.col("doc_id").alias("key"), "component_id"), "key"))
    least = named.groupBy("component_id").agg(F.min("order").alias("least"))
    gone = _graph.kept(named.select("key").join(least.select("least.key"), "key", "left_anti"))
    return rows.join(ngram_join.small(gone), "key", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold at least half of a benchmark item's words, in whatever order of passages.

    Each row is judged by its whole text alone: null and empty texts, null ids and repeated rows stay or go by that. An
    empty benchmark takes nothing.
    """
    return tiling.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows in the mix's proportions: a row comes once for each slot that takes its first word, so 0 to 3 times.

    Rows without words are never taken. Repeated rows are separate, a null source is a source of its own, null ids are
    ordered by their texts. An empty table stays empty.
    """
    rows = _graph.kept(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")))
    mixed = source_mix.mix_sources(rows.select("row.doc_id", "row.text", "row.source", "key"), passed=("key",))
    firsts = mixed.schedule.where("start = 0").groupBy("sid", "at").agg(F.count("*").cast("int").alias("times"))
    times = _graph.kept(mixed.rows.where("size > 0").join(firsts, ["sid", "at"]).select("row.key", "times"))
    taken = rows.join(ngram_join.small(times), "key")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard (0 to 39, counts at most one apart) and slot (gapless from 0), which replace columns of these names.

    Nulls in any column, empty and long texts and repeated rows are rows like others. An empty table stays empty.
    """
    return ring_shards.ring_shards(docs, shards=SHARDS)


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("source mix", mix), ("shards", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{_graph.shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

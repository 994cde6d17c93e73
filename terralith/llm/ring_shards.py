"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns virtual nodes on a ring of 64-bit places. A key belongs to the first node at or
after its place; when that shard is full the key continues clockwise to the next node whose shard
has room. Capacities bound the loads: with slack 0 they add up to the number of rows, and counts
differ by one at most. Keys of one arc differ only in their rank, so that the walk around the
ring needs the arcs' counts alone: a table bounded by the ring, whatever the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = 256


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in order, and the shard of each; a shard's places don't depend on how many there are."""
    place = [int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True) for s in range(shards) for v in range(nodes)]
    order = np.argsort(np.array(place, np.int64), kind="stable")
    return np.array(place, np.int64)[order], np.repeat(np.arange(shards), nodes)[order]


def walk(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, rank from, rank to, shard) after all keys have found room: arcs move in step, nearest first."""
    room, out = capacity.astype(np.int64).copy(), []
    left, done = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    for step in range(len(counts)):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting.tolist():
            shard = owner[(arc + step) % len(owner)]
            take = min(left[arc], room[shard])
            if take:
                out.append((arc, int(done[arc]), int(done[arc] + take), int(shard)))
                done[arc] += take
                left[arc] -= take
                room[shard] -= take
    return out


def place_of(*extra: str) -> Column:
    """A key's place: doc_id decides; where it is null, the text does, so that such rows don't meet in one arc."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")), *[F.lit(x) for x in extra])


def with_arc(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """Rows (place) with arc: the number of the first node at or after the place, 0 beyond the last.

    The first bits of a place name a sector of the ring; a table of the sectors, bounded by the ring, has the nodes of each.
    """
    bits = max(1, len(places).bit_length())
    sector = places >> (64 - bits)
    edges = np.searchsorted(sector, np.arange(-(1 << bits - 1), (1 << bits - 1) + 1))
    table = [(k - (1 << bits - 1), int(a), places[a:b].tolist()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    sectors = rows.sparkSession.createDataFrame(table, "sector long, first long, nodes array<long>")
    before = F.size(F.filter("nodes", lambda p: p < F.col("place")))
    joined = rows.withColumn("sector", F.shiftright("place", 64 - bits)).join(F.broadcast(sectors), "sector")
    return joined.withColumn("arc", (F.col("first") + before) % len(places)).drop("sector", "first", "nodes")


def ring_shards(docs: DataFrame, shards: int, nodes: int = NODES, slack: float = 0.0, order: list[Column] | None = None) -> DataFrame:
    """All rows of docs with shard (0 to shards-1) and slot (gapless from 0 in each shard).

    docs: doc_id and text, and any other columns but shard and slot, which are replaced if they exist. No
    shard holds more than ceil((1 + slack) * rows / shards) rows, and with slack 0 counts are at most one
    apart. Null doc_ids are placed by their text; repeated rows are separate keys, whose ties are broken by
    size and checksum of the text. Empty tables give empty results. Rerun, rows get the same shards.
    """
    places, owner = ring(shards, nodes)

    # all columns travel in one struct, so that no name of theirs can clash
    size, crc = F.octet_length("text"), F.crc32(F.col("text").cast("binary"))
    ties = [c.alias(f"tie{i}") for i, c in enumerate((F.col("doc_id"), size, crc, *(order or [])))]
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    named = with_arc(docs.select(F.struct(*columns).alias("row"), place_of().alias("place"), *ties), places)
    counts = np.zeros(len(places), np.int64)
    for r in with_arc(docs.select(place_of().alias("place")), places).groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    total = int(counts.sum())
    if slack:
        capacity = np.full(shards, math.ceil((1 + slack) * total / shards))
    else:
        capacity = total // shards + (np.arange(shards) < total % shards)
    parts, filled = [], np.zeros(shards, np.int64)
    for arc, a, b, shard in walk(counts, owner, capacity):
        parts.append((arc, a, b, shard, int(filled[shard]) - a))
        filled[shard] += b - a
    table = docs.sparkSession.createDataFrame(parts, "at long, from long, to long, shard int, base long")
    by = Window.partitionBy("arc").orderBy("place", *(f"tie{i}" for i in range(len(ties))))
    ranked = named.withColumn("rank", (F.row_number().over(by) - 1).cast("long"))
    inside = (F.col("arc") == F.col("at")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    # the table has a row for each arc and each time keys of it overflow: bounded by the ring
    return ranked.join(F.broadcast(table), inside).select("row.*", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the digest columns are all that the ring needs of a text besides: they go in its place through the shuffle
    slim = docs.select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = ring_shards(slim, shards=40, order=[F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next content words after it. A text's fingerprint is the set of its
signatures of 48 bits, written as sorted codes of eight characters. Likeness is the Jaccard similarity of two sets.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import _text as T
from terralith.llm import ngram_join as N

#: Common words of English, German, French and Spanish: fixed values.
ANCHORS = (
    "the of and to a in is was that for on with by be this or an are at from he it as not which were but they have "
    "der die das und ist nicht den dem ein eine mit von zu auf für im des sich auch es an werden aus er "
    "le la les et un une est en que du pour dans avec il par au sur ne se pas plus "
    "el los las y del por con para no lo su como más al sus pero"
).split()
CHAIN = 2
NO_ID = -(2**63)
CODE = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)


def _anchor_hashes() -> np.ndarray:
    column = pa.array([" ".join(ANCHORS)], pa.large_string())
    return np.unique(T.word_hashes(*T.utf8(column), True, T.MARKS)[0])


def spot_sets(column: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 48-bit signatures of each text.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. A chain goes over anchors to the next
    content words. Where no anchor is followed by a whole chain, every word with those next to it is a
    signature; where there is no word, the whole text is one; an empty or null text has none.
    """
    anchors = _anchor_hashes()
    data, offsets = T.utf8(column)
    out: list[np.ndarray] = []
    for i, j in T.slices(offsets):
        lo = offsets[i]
        body, at = data[lo : offsets[j]], offsets[i : j + 1] - lo
        h, _, _, first = T.word_hashes(body, at, True, T.MARKS)
        is_anchor = np.isin(h, anchors)
        content = np.flatnonzero(~is_anchor)
        # the first content word after each word
        after = np.cumsum(~is_anchor)
        for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            spots = a + np.flatnonzero(is_anchor[a:b])
            last = int(after[b - 1]) if b > a else 0
            spots = spots[after[spots] + chain <= last]
            if len(spots):
                sig = h[spots]
                for k in range(chain):
                    sig = T.mix(sig) + h[content[after[spots] + k]]
            elif b > a:
                sig = h[a:b].copy()
                for k in range(1, min(chain + 1, b - a)):
                    sig = T.mix(sig[:-1]) + h[a + k : b]
            elif at[r + 1] > at[r]:
                sig = np.frombuffer(hashlib.blake2b(body[at[r] : at[r + 1]].tobytes(), digest_size=8).digest(), np.uint64).copy()
            else:
                sig = np.zeros(0, np.uint64)
            out.append(np.unique(T.mix(sig) >> T.U(16)))
    return out


def written(s: np.ndarray) -> str:
    return CODE[np.stack([s >> T.U(k) & T.U(63) for k in range(42, -1, -6)], 1).astype(np.int64)].tobytes().decode() if len(s) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar_documents(docs: DataFrame, percent: int = 75, chain: int = CHAIN, chunk: int = N.CHUNK) -> DataFrame:
    """Groups all documents whose signature sets have a Jaccard similarity of percent/100 or more.

    Lists of signatures are partitioned by bands of set length, so that a set meets only those whose length allows the
    similarity; within a band the lists of each set's rarest signatures alone are compared, and a pair goes no further
    once lengths, places or sketches rule the overlap out. docs: doc_id and text; other columns are ignored. Returns
    doc_id, n_signatures and component_id, the least doc_id reachable over links, a row a row of docs. Null and empty
    texts have no signatures and link with nothing; rows are linked by their texts alone, whatever their ids; an empty
    table gives an empty result. Copies are one set, and a family of near copies is linked over a few of its members.
    """
    return N.components_of(N.Join(docs, partial(spot_sets, chain=chain), percent, chunk, banded=True), "n_signatures")


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Of each document its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all) of the next
    document's. The next document is that of the next smaller doc_id; after the last comes the first. docs: doc_id
    long and text; other columns are ignored. A null text is empty; a null doc_id comes after all others; rows of
    equal doc_id are in order of a hash of the text. An empty table gives an empty result. Documents are dealt by
    ranges of doc_id, and of the text's hash where many rows have one doc_id or none; each range also gets the first
    document of the next one, so that texts move once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rank, tie = F.bitwise_not(F.coalesce("doc_id", F.lit(NO_ID))), F.xxhash64("text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", rank).withColumn("h", tie)
    cuts = docs.agg(F.percentile_approx("k", F.lit([i / (4 * n) for i in range(1, 4 * n)]), F.lit(100 * n)).alias("c")).first()["c"]
    cuts = np.sort(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        # a value that is cut m times holds the rows of m ranges: those are cut by the hash
        low, high = np.searchsorted(cuts, k.to_numpy(), "left"), np.searchsorted(cuts, k.to_numpy(), "right")
        return pd.Series(low + np.minimum(high - low, np.floor((h.to_numpy() / 2.0**64 + 0.5) * (high - low) + 1).astype(np.int64)))

    ranged = docs.withColumn("b", range_of("k", "h"))
    # a row for each range: as many as the cuts, four times the shuffle's partitions at most
    heads = sorted((r["b"], r["m"]["k"], r["m"]["h"]) for r in ranged.groupBy("b").agg(F.min(F.struct("k", "h")).alias("m")).collect())
    ends = [(k, h, heads[i - 1][0]) for i, (_, k, h) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(ends, "k long, h long, before int"))
    own, tail = F.struct(F.col("b"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("b"), F.lit(True).alias("tail"))
    dealt = ranged.join(table, ["k", "h"], "left").select("doc_id", "text", "k", "h", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, tail))).alias("to"))
    dealt = dealt.select("doc_id", "text", "k", "h", "to.b", "to.tail").repartition(n, "b").sortWithinPartitions("b", "tail", "k", "h")

    def run(batches):
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256).select(["doc_id", "text", "b", "tail"])
                table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
                held = table.slice(table.num_rows - 1).to_batches()[0]
                if table.num_rows > 1:
                    yield _compared(table, chain)

    return dealt.mapInArrow(T.lean(run), schema)


def _compared(t: pa.Table, chain: int) -> pa.RecordBatch:
    """Each row of a range with the one after it."""
    tail, b = (t[c].to_numpy() for c in ("tail", "b"))
    rows = np.flatnonzero(~tail[:-1].astype(bool) & (b[:-1] == b[1:])).tolist()
    texts = t["text"].to_pylist()
    edited = []
    for i in rows:
        third = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - third] + texts[i + 1][:third])
    own, new = spot_sets(t["text"].combine_chunks(), chain), spot_sets(pa.array(edited, pa.large_string()), chain)
    return pa.RecordBatch.from_arrays(
        [
            t["doc_id"].take(pa.array(rows, pa.int64())).combine_chunks(),
            pa.array([len(texts[i]) for i in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([written(own[i]) for i in rows], pa.string()),
            pa.array([written(s) for s in new], pa.string()),
            pa.array([likeness(own[i], s) for i, s in zip(rows, new, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

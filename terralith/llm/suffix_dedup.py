"""Removal of repeated byte strings with a distributed sparse suffix array.

Method: sampled splitters range-partition suffixes by their leading tokens; each bucket sorts its suffixes with a
multikey quicksort, compares neighbours, and hands what lies at its ends to the buckets beside it. Two sorted levels
keep the number of suffixes low without losing a repeat:

1. one suffix for each run of windows with a common winnowed seed (about one in fifty bytes). Its tokens are its
   first eight bytes, the fingerprint of its seed, and that of the whole run. Neighbours that agree on the first two
   have a common prefix of the seed's length at least: a window can only repeat if its seed does. Those that agree on
   all three repeat as a whole, and so do all their windows.
2. one suffix for each window start of the runs that share a seed but not the run, that is at the edges of repeats.
   Its tokens are its first eight bytes and the fingerprint of the window.

Documents are dealt into groups of bounded size. Before a suffix leaves its group, equal ones merge into one that is
marked as repeated, so that a passage which a third of all rows hold gives a row a group, not a row a copy. The group is
the last token: splitters may divide the suffixes of one hot passage, and a bucket's first and last suffixes are settled
by comparison across the boundary: each bucket tells what its two ends hold, a table bounded by the buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import _graph as G
from terralith.llm import _seeds as S
from terralith.llm import _text as T

GROUP_BYTES = 4 << 20
DUPLICATE, EXPAND = 1, 2
SUFFIX = pa.schema([("g", pa.int32()), ("lead", pa.int64()), ("seed", pa.int64()), ("name", pa.int64()), ("twice", pa.bool_())])
SUFFIX_DDL = "g int, lead long, seed long, name long, twice boolean"
#: What a bucket says. Kind 0: a suffix within it; 1: one at its ends; 2: what an end holds, whose names are the least and greatest.
SAID = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("g", pa.int32()), ("seed", pa.int64()), ("name", pa.int64()), ("last", pa.int64()), ("repeated", pa.bool_()), ("head", pa.bool_()), ("several", pa.bool_())])
SAID_DDL = "kind byte, bucket int, g int, seed long, name long, last long, repeated boolean, head boolean, several boolean"
FOUND = pa.schema([("g", pa.int32()), ("key", pa.int64()), ("flag", pa.int8())])
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", SPAN), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def multikey_order(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Multikey quicksort: splits rows three ways at a pivot of one token; only equals look at the next token."""
    out, todo = [], [(np.arange(len(keys[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == len(keys) or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])])
        else:
            v = keys[depth][rows]
            pivot = np.sort(v[:: max(1, len(v) // 101)])[len(v[:: max(1, len(v) // 101)]) // 2]
            todo += [(rows[v > pivot], depth), (rows[v == pivot], depth + 1), (rows[v < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def starts_of_equal(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return new


def merged(g: int, lead: np.ndarray, seed: np.ndarray, name: np.ndarray) -> pa.Table:
    """Suffixes of one group, equal ones as one."""
    order = np.lexsort((name, seed, lead))
    lead, seed, name = lead[order], seed[order], name[order]
    at = np.flatnonzero(starts_of_equal(lead, seed, name)) if len(lead) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(lead)))
    return pa.Table.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(lead[at]), pa.array(seed[at]), pa.array(name[at]), pa.array(n > 1)], schema=SUFFIX)


def compared(batches):
    """What neighbours in a sorted bucket say about each suffix, and what the bucket's two ends hold."""
    t = T.table_of(batches, SUFFIX)
    if not t.num_rows:
        return
    context = TaskContext.get()
    bucket = context.partitionId() if context else 0
    yield from _compared(t, bucket)


def _compared(t: pa.Table, bucket: int):
    order = multikey_order([T.column(t, c) for c in ("lead", "seed", "name")])
    g, lead, seed, name = (T.column(t, c)[order] for c in ("g", "lead", "seed", "name"))
    twice = T.column(t, "twice")[order].astype(bool)
    new_seed, head = starts_of_equal(lead, seed), starts_of_equal(lead, seed, name)
    of_seed, of_name = np.cumsum(new_seed) - 1, np.cumsum(head) - 1
    several = np.bincount(of_seed[head])[of_seed] > 1
    repeated = (np.bincount(of_name)[of_name] > 1) | (np.bincount(of_name, twice)[of_name] > 0)
    at_end = (of_seed == 0) | (of_seed == of_seed[-1])
    keep = at_end | repeated | several
    n = int(keep.sum())
    yield T.batch(SAID, at_end[keep].astype(np.int8), np.full(n, bucket, np.int32), g[keep], seed[keep], name[keep], name[keep], repeated[keep], head[keep], several[keep])
    ends = [0] if of_seed[-1] == 0 else [0, int(np.flatnonzero(new_seed)[-1])]
    stops = [int(np.searchsorted(of_seed, of_seed[k], "right")) - 1 for k in ends]
    first = np.arange(len(ends)) == 0
    yield T.batch(SAID, np.full(len(ends), 2, np.int8), np.full(len(ends), bucket, np.int32), np.zeros(len(ends), np.int32), seed[ends], name[ends], name[stops], ~first, first, several[ends])


def across(ends: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, bool, list[int]]]:
    """(seed, several, names that lie on both sides of a boundary) for the seeds at buckets' ends.

    ends: (bucket, seed, least name, greatest name, several), a bucket's first end before its last. A seed that fills
    buckets is one seed over all of them.
    """
    out: dict[int, tuple[bool, list[int]]] = {}
    before = None
    for bucket, seed, least, most, several in ends:
        if seed in out:
            had, names = out[seed]
            # the same seed follows on from the bucket before, with names in order
            if before is not None and before[1] == seed:
                if before[3] == least:
                    names.append(least)
                had = had or before[3] != least
            out[seed] = (had or several, names)
        else:
            out[seed] = (several, [])
        before = (bucket, seed, least, most)
    return [(k, several, sorted(set(names))) for k, (several, names) in out.items()]


def settled(suffixes: DataFrame) -> DataFrame:
    """g, seed, name, repeated, head, several: what all suffixes' neighbours say, across the boundaries of buckets too."""
    spark = suffixes.sparkSession
    said = G.kept(suffixes.repartitionByRange(_buckets(spark), "lead", "seed", "name", "g").mapInArrow(T.lean(compared), SAID_DDL))
    # two rows a bucket at most
    ends = sorted((r["bucket"], not r["head"], k, r["seed"], r["name"], r["last"], r["several"]) for k, r in enumerate(said.where("kind = 2").select("bucket", "head", "seed", "name", "last", "several").collect()))
    table = spark.createDataFrame(across([(b, seed, least, most, several) for b, _, _, seed, least, most, several in ends]), "seed long, more boolean, names array<long>")
    columns = ("g", "seed", "name", "repeated", "head", "several")
    inner = said.where("kind = 0").select(*columns)
    edge = said.where("kind = 1").join(F.broadcast(table), "seed").select("g", "seed", "name", (F.col("repeated") | F.array_contains("names", F.col("name"))).alias("repeated"), "head", (F.col("several") | F.col("more")).alias("several"))
    return inner.unionByName(edge.where("repeated or several"))


class _Group:
    """Documents of one group, with the runs of their windows."""

    def __init__(self, docs: pa.Table, window: int, seed: int):
        self.ids = docs.column("doc_id")
        self.data, self.offsets = T.utf8(docs.column("text"))
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        self.window, self.seed = window, seed
        self.runs = S.runs_of(T.BYTE_VALUE[self.data], self.offsets, seed, window)

    def leads(self) -> np.ndarray:
        """The first eight bytes of each run's seed, in the order of bytes."""
        at = self.offsets[self.runs.row] + self.runs.place
        token = np.zeros(len(at), np.uint64)
        for k in range(min(8, self.seed)):
            token = token << T.U(8) | self.data[at + k].astype(np.uint64)
        return T.signed(token ^ T.U(1 << 63))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, leading token and fingerprint of each window of the chosen runs."""
        parts = []
        lead = T.powers(256, 8)[::-1].copy()
        r = self.runs
        rows = np.flatnonzero(chosen)
        for part in np.split(rows, np.flatnonzero(np.diff(r.row[rows])) + 1) if len(rows) else []:
            row = int(r.row[part[0]])
            start, _ = S.windows_of(r.first[part], r.last[part])
            body = self.data[self.offsets[row] : self.offsets[row + 1]]
            low, high = int(start.min()), int(start.max()) + self.window
            h = T.prefix_hash(T.BYTE_VALUE[body[low:high]])
            token = np.zeros(len(start), np.uint64)
            for k in range(min(8, self.window)):
                token += body[start + k].astype(np.uint64) * lead[k]
            parts.append((np.full(len(start), row), start, token ^ T.U(1 << 63), T.span_hash(h, start - low, start - low + self.window)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2

    def flags(self, found: pa.Table) -> np.ndarray:
        """What level 1 says of each run."""
        key, flag = T.column(found, "key"), T.column(found, "flag")
        use = flag > 0
        order = np.argsort(key[use])
        at = S.find(key[use][order], T.signed(self.runs.name))
        return np.where(at >= 0, flag[use][order][at], 0) if use.any() else np.zeros(len(at), np.int8)


def suffix_array_dedup(docs: DataFrame, window: int = 400, seed: int = 300, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Finds every byte covered by a window-byte string that also starts anywhere else, the same document included.

    docs: doc_id long and text; other columns are ignored whatever their names. Returns doc_id, n_bytes,
    spans (maximal removed stretches, as byte offsets) and kept (the other bytes, end to end), a row a
    document. A null or empty text has no bytes and no spans. Rows with equal doc_id are separate
    documents, so that repeated rows repeat each other; a null doc_id is a value like others. Of a very
    long text, pieces are worked on in turn. An empty table gives an empty result. Windows are judged on
    the input; overlapping repeats count.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text")

    def level_1(t: pa.Table) -> pa.Table:
        group = _Group(t, window, seed)
        return merged(t.column("g")[0].as_py(), group.leads(), T.signed(group.runs.seed), T.signed(group.runs.name))

    def level_2(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows or not found.num_rows:
            return SUFFIX.empty_table()
        group = _Group(t, window, seed)
        _, _, lead, name = group.windows((group.flags(found) & EXPAND) > 0)
        return merged(t.column("g")[0].as_py(), T.signed(lead), T.signed(name), T.signed(name))

    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        group = _Group(t, window, seed) if found.num_rows else None
        data, offsets = (group.data, group.offsets) if group else T.utf8(t.column("text"))
        starts: dict[int, list] = {}
        if group:
            flag, r = group.flags(found), group.runs
            sure = np.flatnonzero(flag & DUPLICATE)
            at, run = S.windows_of(r.first[sure], r.last[sure])
            row, start, _, name = group.windows((flag & EXPAND > 0) & (flag & DUPLICATE == 0))
            repeated = np.sort(T.column(found, "key")[T.column(found, "flag") == 0])
            hit = S.find(repeated, T.signed(name)) >= 0
            rows, at = np.concatenate([r.row[sure][run], row[hit]]), np.concatenate([at, start[hit]])
            order = np.argsort(rows, kind="stable")
            rows, at = rows[order], at[order]
            bounds = np.flatnonzero(np.diff(rows, prepend=-1))
            starts = dict(zip(rows[bounds].tolist(), np.split(at, bounds[1:]), strict=True)) if len(rows) else {}
        spans, kept = [], []
        for i in range(t.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            if i in starts:
                gone = S.covered(len(body), starts[i], window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(body[~gone].tobytes())
            else:
                spans.append([])
                kept.append(body.tobytes())
        return pa.Table.from_arrays([t.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.array(spans, SPAN), pa.array(kept, pa.binary())], schema=RESULT)

    # of a run that repeats, one copy a bucket is enough to tell its windows from those of other runs
    said = settled(dealt.groupBy("g").applyInArrow(level_1, SUFFIX_DDL))
    flag = F.when(F.col("repeated"), F.lit(DUPLICATE)).otherwise(F.lit(0)) + F.when(F.col("several") & (~F.col("repeated") | F.col("head")), F.lit(EXPAND)).otherwise(F.lit(0))
    runs = said.select("g", F.col("name").alias("key"), flag.cast("byte").alias("flag")).where("flag > 0")
    edges = dealt.groupBy("g").cogroup(runs.groupBy("g")).applyInArrow(level_2, SUFFIX_DDL)
    windows = settled(edges).where("repeated").select("g", F.col("name").alias("key"), F.lit(0).cast("byte").alias("flag"))
    found = runs.unionByName(windows)
    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut, RESULT_DDL)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=400)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

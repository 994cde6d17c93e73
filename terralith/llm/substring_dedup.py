"""Removal of repeated word sequences by seed and extend.

Method: documents are joined on winnowed anchors (seeds of a few words), matches are extended both
ways, and what reaches the threshold is a maximal repeat whose later copies go.

1. every run of windows with a common anchor meets all others with that anchor. Runs that agree on
   all words extend at once: the earliest one stays, all windows of the later ones repeat it.
2. where runs share the anchor but not all words, the earliest of each kind is extended a word at a
   time: an anchor with i more words before it and the rest after it is one window, and windows that
   agree on all words join to their earliest start.

Windows that follow each other are one repeat, so that repeats grow to their full length. The join
never pairs documents: each anchor, run or window keeps its earliest place, merged inside a group of
documents before it is shuffled, so that a hot passage gives a row a group and not a row a copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import _seeds as S
from terralith.llm import _text as T

GROUP_BYTES = 4 << 20
#: kind: 0 is an anchor's run, 1 a window.
PLACE = pa.schema([("g", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("twice", pa.bool_())])
PLACE_DDL = "g int, anchor long, key long, doc long, start int, twice boolean"
FIRST = pa.schema([("g", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("expand", pa.bool_())])
FIRST_DDL = "g int, kind byte, key long, doc long, start int, expand boolean"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPAN), ("kept", pa.string())])
RESULT_DDL = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept string"
#: A null doc_id comes before all others.
NO_ID = -(2**63)


class _Group:
    """Documents of one group in order of doc_id, with their words and the runs of their windows."""

    def __init__(self, docs: pa.Table, window: int, anchor: int):
        docs = docs.sort_by("doc_id")
        self.docs = docs
        self.ids = T.column(docs.set_column(0, "doc_id", docs.column("doc_id").fill_null(NO_ID)), "doc_id")
        self.g = docs.column("g")[0].as_py()
        self.data, self.offsets = T.utf8(docs.column("text"))
        hashes, starts, ends, counts = [], [], [], [np.zeros(1, np.int64)]
        for i, j in T.slices(self.offsets):
            lo = self.offsets[i]
            h, a, b, first = T.word_hashes(self.data[lo : self.offsets[j]], self.offsets[i : j + 1] - lo, folded=False)
            hashes.append(h)
            starts.append(a + lo)
            ends.append(b + lo)
            counts.append(np.diff(first))
        self.hashes, self.starts, self.ends = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
        self.first = np.cumsum(np.concatenate(counts))
        self.window = window
        self.runs = S.runs_of(self.hashes, self.first, anchor, window)

    def windows(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and fingerprint of each window of the chosen runs."""
        r = self.runs
        start, of = S.windows_of(r.first[run], r.last[run])
        row = r.row[run][of]
        at = self.first[row] + start
        value = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            value = (value + self.hashes[at + k]) * T.U(T.BASE)
        return row, start, T.mix(value)

    def told(self, found: pa.Table):
        """For each run: the earliest place of its like (doc, start), whether any is known, whether to look at its windows."""
        mine = T.column(found, "kind") == 0
        key, doc, start, expand = (T.column(found, c)[mine] for c in ("key", "doc", "start", "expand"))
        order = np.argsort(key)
        at = S.find(key[order], T.signed(self.runs.name))
        if not len(order):
            none = np.zeros(len(at), bool)
            return none, none
        hit, at = at >= 0, order[np.maximum(at, 0)]
        here = self.ids[self.runs.row]
        later = hit & ((here > doc[at]) | ((here == doc[at]) & (self.runs.first > start[at])))
        return later, hit & ~later & expand[at].astype(bool)


def _merged(group: _Group, anchor: np.ndarray, key: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.Table:
    """The earliest place of each key in a group; rows come in order of place."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(key)))
    first = order[at]
    return pa.Table.from_arrays(
        [pa.array(np.full(len(at), group.g, np.int32)), pa.array(T.signed(anchor[first])), pa.array(T.signed(key[first])), pa.array(group.ids[row[first]]), pa.array(start[first].astype(np.int32)), pa.array(n > 1)],
        schema=PLACE,
    )


def join_anchors(batches):
    """Of runs that share an anchor: the earliest of each kind, and whether there are several kinds."""
    t = T.table_of(batches, PLACE)
    if not t.num_rows:
        return
    g, anchor, key, doc, start, twice = (T.column(t, c) for c in PLACE.names)
    order = np.lexsort((start, doc, key, anchor))
    g, anchor, key, doc, start, twice = (x[order] for x in (g, anchor, key, doc, start, twice))
    new_anchor = np.ones(len(g), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_key = new_anchor.copy()
    new_key[1:] |= key[1:] != key[:-1]
    of_anchor, of_key = np.cumsum(new_anchor) - 1, np.cumsum(new_key) - 1
    head = np.flatnonzero(new_key)[of_key]
    expand = (np.bincount(of_anchor[new_key])[of_anchor]) > 1
    keep = expand | (np.bincount(of_key)[of_key] > 1) | (np.bincount(of_key, twice)[of_key] > 0)
    yield T.batch(FIRST, g[keep], np.zeros(keep.sum(), np.int8), key[keep], doc[head][keep], start[head][keep], expand[keep])


def join_windows(batches):
    """Of equal windows: the earliest."""
    t = T.table_of(batches, PLACE)
    if not t.num_rows:
        return
    g, key, doc, start, twice = (T.column(t, c) for c in ("g", "key", "doc", "start", "twice"))
    order = np.lexsort((start, doc, key))
    g, key, doc, start, twice = (x[order] for x in (g, key, doc, start, twice))
    new = np.ones(len(g), bool)
    new[1:] = key[1:] != key[:-1]
    of = np.cumsum(new) - 1
    head = np.flatnonzero(new)[of]
    keep = (np.bincount(of)[of] > 1) | (np.bincount(of, twice)[of] > 0)
    yield T.batch(FIRST, g[keep], np.ones(keep.sum(), np.int8), key[keep], doc[head][keep], start[head][keep], np.zeros(keep.sum(), bool))


def seed_extend_dedup(docs: DataFrame, window: int = 20, anchor: int = 8, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Removes each word covered by a window of so many words whose word sequence also starts earlier.

    docs: doc_id long and text; other columns are ignored whatever their names. Earlier means a smaller
    doc_id, or the same document and an earlier start; a null doc_id comes before all others. Returns
    doc_id, n_words, spans (maximal removed stretches, as word numbers) and kept (the other words joined by
    one space), a row a document. A null or empty text has no words, no spans and an empty kept. Repeated
    rows share doc_id and place, so that neither is earlier and both stay. Windows are judged on the input,
    never on what is left. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors(t: pa.Table) -> pa.Table:
        group = _Group(t, window, anchor)
        return _merged(group, group.runs.seed, group.runs.name, group.runs.row, group.runs.first)

    def extend(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows or not found.num_rows:
            return PLACE.empty_table()
        group = _Group(t, window, anchor)
        _, expand = group.told(found)
        row, start, key = group.windows(np.flatnonzero(expand))
        return _merged(group, key, key, row, start)

    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return RESULT.empty_table()
        group = _Group(t, window, anchor)
        later, expand = group.told(found)
        r = group.runs
        at, of = S.windows_of(r.first[later], r.last[later])
        row, start, key = group.windows(np.flatnonzero(expand))
        mine = T.column(found, "kind") == 1
        keys, doc, place = (T.column(found, c)[mine] for c in ("key", "doc", "start"))
        if len(keys):
            order = np.argsort(keys)
            hit = S.find(keys[order], T.signed(key))
            ok, hit = hit >= 0, order[np.maximum(hit, 0)]
            here = group.ids[row]
            ok &= (here > doc[hit]) | ((here == doc[hit]) & (start > place[hit]))
            row, start = row[ok], start[ok]
        else:
            row, start = row[:0], start[:0]
        gone_at = np.concatenate([group.first[r.row[later][of]] + at, group.first[row] + start])
        gone = S.covered(len(group.hashes), gone_at, window)
        spans, kept = [], []
        for i in range(t.num_rows):
            a, b = group.first[i], group.first[i + 1]
            mask = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if mask.any() else np.zeros(0, np.int64)
            spans.append([{"start": x, "stop": y} for x, y in edge.reshape(-1, 2).tolist()])
            kept.append(_joined(group.data, group.starts[a:b][~mask], group.ends[a:b][~mask]))
        return pa.Table.from_arrays([group.docs.column("doc_id").combine_chunks(), pa.array(np.diff(group.first)), pa.array(spans, SPAN), pa.array(kept, pa.string())], schema=RESULT)

    runs = dealt.groupBy("g").applyInArrow(anchors, PLACE_DDL).repartition(n, "anchor").mapInArrow(T.lean(join_anchors), FIRST_DDL)
    edges = dealt.groupBy("g").cogroup(runs.groupBy("g")).applyInArrow(extend, PLACE_DDL)
    windows = edges.repartition(n, "key").mapInArrow(T.lean(join_windows), FIRST_DDL)
    return dealt.groupBy("g").cogroup(runs.unionByName(windows).groupBy("g")).applyInArrow(cut, RESULT_DDL)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Words joined by one space."""
    n = ends - starts
    size = int(n.sum()) + len(n)
    if not size:
        return ""
    out = np.full(size, 0x20, np.uint8)
    to = np.cumsum(n + 1) - n - 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + step] = data[np.repeat(starts, n) + step]
    return out[:-1].tobytes().decode("utf-8", "replace")


def op2_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seed_extend_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds (runs of as many words as the least tile). Of a pair
whose seeds could cover enough of the item, the longest match of unmarked words is marked, again and
again, until none is as long as a tile. Running Karp-Rabin fingerprints find the matches. The share of
the item's words that tiles cover decides, so that reordered passages count as much as whole ones.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as st

from terralith.llm import _text as T

LEAST_TILE, LEAST_SHARE = 5, 0.5
#: Bytes of benchmark text that go to the executors at a time; more are taken in blocks, each against all documents.
BLOCK_BYTES = 32 << 20


class Items(NamedTuple):
    """Benchmark items with their seeds in order of fingerprint."""

    ids: np.ndarray
    words: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str | None], tile: int) -> Items:
        column = pa.array(texts, pa.large_string())
        seeds, items, at = [], [], []
        data, offsets = T.utf8(column)
        h, _, _, first = T.word_hashes(data, offsets, True, T.MARKS)
        grams = T.gram_hash(T.prefix_hash(h), tile)
        for i in range(len(ids)):
            n = int(first[i + 1] - first[i]) - tile + 1
            if n > 0:
                seeds.append(grams[first[i] : first[i] + n])
                items.append(np.full(n, i))
                at.append(np.arange(n))
        if not seeds:
            return Items(np.array(ids, np.int64), np.diff(first), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        return Items(np.array(ids, np.int64), np.diff(first), seed[order], np.concatenate(items)[order], np.concatenate(at)[order])


def tiles(i: np.ndarray, j: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the pairs of places at which seeds of tile words match: (place, place, length), longest first.

    Equal lengths go by the first text's place, then the second's.
    """
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.append(True, (np.diff(i) != 1) | (np.diff(i - j) != 0))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(i))) + tile - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[start], j[start], strict=True)]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + k not in used_i and b + k not in used_j for k in range(n)]
        if all(free):
            out.append((a, b, n))
            used_i.update(range(a, a + n))
            used_j.update(range(b, b + n))
            continue
        k = 0
        while k < n:  # what is left of a match between marked words is a match again
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= tile:
                    heapq.heappush(heap, (-(e - k), a + k, b + k))
                k = e
            else:
                k += 1
    return out


def overlaps(items: Items, column: pa.Array, tile: int, share: float):
    """(row, item, tiles) of texts that cover at least that share of an item's words."""
    data, offsets = T.utf8(column)
    if not len(items.seed):
        return
    for i, j in T.slices(offsets):
        lo = offsets[i]
        h, _, _, first = T.word_hashes(data[lo : offsets[j]], offsets[i : j + 1] - lo, True, T.MARKS)
        grams = T.gram_hash(T.prefix_hash(h), tile)
        if not len(grams):
            continue
        left = np.searchsorted(items.seed, grams)
        hit = np.flatnonzero(items.seed[np.minimum(left, len(items.seed) - 1)] == grams)
        row = np.searchsorted(first, hit, "right") - 1
        inside = hit + tile <= first[row + 1]
        hit, row = hit[inside], row[inside]
        if not len(hit):
            continue
        right = np.searchsorted(items.seed, grams[hit], "right")
        n = right - left[hit]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[hit], n)
        row, place = np.repeat(row, n), np.repeat(hit, n) - first[np.repeat(row, n)]
        item, at = items.item[entry], items.at[entry]
        order = np.lexsort((place, item, row))
        row, place, item, at = row[order], place[order], item[order], at[order]
        cut = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0)))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist(), strict=True):
            k = int(item[a])
            could = np.zeros(int(items.words[k]), bool)
            for d in range(tile):
                could[at[a:b] + d] = True
            if could.sum() >= share * items.words[k]:
                found = tiles(place[a:b], at[a:b], tile)
                if sum(t[2] for t in found) >= share * items.words[k]:
                    yield i + int(row[a]), k, found


def _blocks(benchmark: DataFrame, tile: int):
    """The benchmark's items, so many bytes at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if r["item_id"] is None or not r["text"]:
            continue
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield Items.of(ids, texts, tile)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, tile)


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = LEAST_TILE, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, covered and item_words (words), coverage and tiles (start in the text, start in the item, words) of pairs where tiles cover at least that share of the item.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. Words are runs of letters,
    digits and bytes beyond ASCII, with A-Z as a-z. Items of fewer words than a tile, null or empty texts and
    null item_ids match nothing. Repeated rows give repeated results; a null doc_id comes back as null. Empty
    tables give empty results.
    """
    ddl = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles array<struct<doc_start:long,item_start:long,words:long>>"
    out = None
    for items in _blocks(benchmark, tile):

        def run(batches, items=items):
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])))])
            for b in batches:
                got = list(overlaps(items, b.column("text"), tile, share))
                covered = [sum(t[2] for t in f) for _, _, f in got]
                words = [int(items.words[k]) for _, k, _ in got]
                yield T.batch(schema, [b.column("doc_id")[r].as_py() for r, _, _ in got], [int(items.ids[k]) for _, k, _ in got], covered, words, [c / w for c, w in zip(covered, words, strict=True)], [[dict(zip(("doc_start", "item_start", "words"), t, strict=True)) for t in f] for _, _, f in got])

        part = docs.select("doc_id", "text").mapInArrow(T.lean(run), ddl)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = LEAST_TILE, share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs, with all columns, whose text covers no item as contaminated() has it. Rows are judged one by one."""
    for items in _blocks(benchmark, tile):

        def run(batches, items=items):
            for b in batches:
                bad = {r for r, _, _ in overlaps(items, b.column("text"), tile, share)}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(T.lean(run), st.StructType(docs.schema.fields))
    return docs


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("tiles")

"""Similarity self-join on word n-grams (Jaccard), by T-occurrence search.

Method: two sets are similar only if they share T of their tokens. Equal sets are one vertex, named by a fingerprint of
the set. Each set's T-1 most frequent tokens are its long lists and are set aside, as DivideSkip does; the lists of the
others, its rarest tokens, are merged for candidates, and the long ones are probed by binary search for those
candidates alone. Who reaches the required overlap is linked.

A family of m near copies would give m * m / 2 candidates. So at first a few members of each list, those most like the
rest, are candidates with all others of it; what they link is one component. Then all pairs of a list that are still of
different components are candidates, if sizes, places and sketches of the two sets allow the overlap. No link between
different components is missed. (The heap merge of short lists is one vectorised counting merge, with the same counts.)
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import _graph as G
from terralith.llm import _text as T

#: Tokens in more than this share of a batch are common: they go to the end of the order of tokens, the most common last.
COMMON_SHARE, MOST_COMMON = 1 / 2000, 100_000
#: Members of a list of a common token that one task takes at a time, by its count.
LIST_ROWS = 1_000_000
#: A list has one hub for so many members, so many hubs at most.
HUB_EVERY, MOST_HUBS = 16, 4
#: Members of a list compared with one another in one task; of longer lists, each two chunks of so many.
CHUNK = 1000
#: Tokens of the texts that are compared in one task at a time.
GROUP_TOKENS = 1_000_000
#: Rows of a side that are sent to all executors (16 bytes each); beyond that both sides are shuffled.
SMALL_ROWS = 500_000
#: Bits of the sketch that goes with each member of a list. Whole sketches have two bits a token at least.
MARK_BITS = 512
#: A member of a list carries its set's size, its token's place in the set's order and, of the short lists of its set, the
#: share that are of common tokens: so many bits each for the last two.
PLACE_BITS, SHARE_BITS = 26, 10
#: Bands of sizes that there may be: sets of up to 10**9 tokens at 75 percent.
BANDS = 80
#: Parts that the lists of one home are dealt in; of a home with more rows, a part for so many.
HOME_PARTS, HOME_ROWS = 4, 500
LISTED = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("place", pa.int64())])
LISTED_DDL = "token long, node long, place long"
#: Kind 0: a member of a list of several, dealt by the list's hub. Kind 1: token and node are a pair.
MEMBER = pa.schema([("kind", pa.int8()), ("home", pa.int64()), *LISTED, ("size", pa.int64())])
MEMBER_DDL = f"kind byte, home long, {LISTED_DDL}, size long"
TILE = pa.schema([*LISTED, ("home", pa.int64()), ("label", pa.int64()), ("mark", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("own", pa.int32())])
PAIR = pa.schema([("hub", pa.int64()), ("other", pa.int64())])
PAIR_DDL = "hub long, other long"


#: Sorted distinct tokens of each text of a column.
Sets = Callable[[pa.Array], list[np.ndarray]]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct fingerprints of each text's k-word shingles, A-Z as a-z; of fewer words, one of the whole."""
    data, offsets = T.utf8(column)
    out: list[np.ndarray] = []
    for i, j in T.slices(offsets):
        lo = offsets[i]
        h, _, _, first = T.word_hashes(data[lo : offsets[j]], offsets[i : j + 1] - lo, folded=True)
        run = T.prefix_hash(h)
        grams = T.gram_hash(run, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                out.append(T.mix(T.span_hash(run, np.array([a]), np.array([b])) + T.U(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A fingerprint of a whole set."""
    if not len(s):
        return 0
    return int(T.mix((T.mix(s ^ T.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + T.U(len(s))).reshape(1)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """A bit for the parity of each bucket of tokens, two buckets a token at least: sketches differ in no more bits than sets in tokens."""
    bits = max(MARK_BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((T.mix(s.copy()) & T.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """The sketches of so many bytes that those rows stand for: parities of buckets that are taken together."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of two tables of sketches differ."""
    return np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(1, dtype=np.int64)


def allowed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that similar sets of these sizes have in one of them alone, at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """T: tokens that similar sets of these sizes share at least."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def signatures(sets_of: Sets, schema: pa.Schema):
    """Of each document the size, key and sketch of its set (kind 0); of each batch its common tokens (kind 1)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets = sets_of(b.column("text"))
            sizes, keys = np.array([len(s) for s in sets]), np.array([set_key(s) for s in sets])
            yield T.batch(schema, np.zeros(len(sets), np.int8), b.column("doc_id"), sizes, keys, b.column("text_hash"), [sketch(s) if len(s) else None for s in sets])
            _, one = np.unique(keys, return_index=True)
            tokens, n = np.unique(np.concatenate([sets[i] for i in one]), return_counts=True)
            often = n >= max(2, len(sets) * COMMON_SHARE)
            m = int(often.sum())
            yield T.batch(schema, np.ones(m, np.int8), pa.nulls(m, schema.field("doc_id").type), n[often], T.signed(tokens[often]), np.zeros(m, np.int64), pa.nulls(m, pa.binary()))

    return run


def size_band(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands of set sizes: similar sets are of one band or of two next to each other."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def in_band(tokens: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Names of the lists of tokens in a band."""
    return T.mix(tokens + np.asarray(band).astype(np.uint64) * T.U(0x9E3779B97F4A7C15))


def rare_tokens(sets_of: Sets, percent: int, common: np.ndarray, rank: np.ndarray, banded: bool = False):
    """Each set's short lists: all but its T-1 most frequent tokens, with their places in its order; equal sets of a batch go once.

    common: sorted common tokens, rank: their place in the order of tokens, after all others. The third column holds packed(). banded: a token has a list for each band of sizes, and a set is in
    those of its own and the next band.
    """

    def run(batches):
        for b in batches:
            least = {}
            for s in sets_of(b.column("text")) if b.num_rows else ():
                if len(s):
                    least.setdefault(set_key(s), s)
            if not least:
                continue
            out, share = [], []
            for s in least.values():
                m = len(s) - (percent * len(s) + 99) // 100 + 1
                share.append(0)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = common[at] == s
                    if often.any():
                        s = np.concatenate([s[~often], s[often][np.argsort(rank[at[often]], kind="stable")]])
                        share[-1] = max(0, m - int((~often).sum())) * ((1 << SHARE_BITS) - 1) // m
                out.append(s[:m])
            n = np.array([len(x) for x in out])
            sizes = np.array([len(s) for s in least.values()])
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            token, node, where = np.concatenate(out), np.repeat(np.array(list(least)), n), packed(np.repeat(sizes, n), place, np.repeat(share, n))
            if banded:
                band = np.repeat(size_band(sizes, percent), n)
                token, node, where = np.concatenate([in_band(token, band), in_band(token, band + 1)]), np.tile(node, 2), np.tile(where, 2)
            yield T.batch(LISTED, T.signed(token), node, where)

    return run


def packed(size: np.ndarray, place: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (size << PLACE_BITS | place) << SHARE_BITS | share


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> PLACE_BITS + SHARE_BITS, x >> SHARE_BITS & (1 << PLACE_BITS) - 1, x & (1 << SHARE_BITS) - 1


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin, and the end."""
    new = np.zeros(len(columns[0]) + 1, bool)
    new[0] = new[-1] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def members(percent: int, many: dict[int, int]):
    """The lists of several members, and the pairs of their hubs with all others.

    Hubs are the members most of whose short lists are of common tokens: the source of a family of near copies shares more
    with them than they with each other. Lists of one family so have the same few hubs. many: the counts of common tokens whose lists come in several parts.
    """

    def run(batches):
        t = T.table_of(batches, LISTED)
        if not t.num_rows:
            return
        token, node, place = (T.column(t, c) for c in LISTED.names)
        order = np.lexsort((node, token))
        token, node, place = token[order], node[order], place[order]
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node, place = token[new], node[new], place[new]
        edge = _edges(token)
        size = np.repeat(np.diff(edge), np.diff(edge))
        split = np.isin(token, np.array(list(many), np.int64)) if many else np.zeros(len(token), bool)
        keep = (size > 1) | split
        token, node, place, size, split = token[keep], node[keep], place[keep], size[keep], split[keep]
        if not len(token):
            return
        order = np.lexsort((node, -unpacked(place)[2], token))
        token, node, place, size, split = token[order], node[order], place[order], size[order], split[order]
        edge = _edges(token)
        within = np.arange(len(token)) - np.repeat(edge[:-1], np.diff(edge))
        home = np.where(split, token, np.repeat(np.minimum.reduceat(node, edge[:-1]), np.diff(edge)))
        size[split] = [many[x] for x in token[split].tolist()]
        yield T.batch(MEMBER, np.zeros(len(token), np.int8), home, token, node, place, size)
        n, first, here = unpacked(place)[0], edge[:-1], np.diff(edge)
        for h in range(MOST_HUBS):
            has = here > max(1, h * HUB_EVERY)
            hub = np.repeat(np.where(has, first + h * has, 0), here)
            ok = np.repeat(has, here) & (within > h) & fits(n, n[hub], percent)
            got = np.unique(np.stack([node[hub[ok]], node[ok]], 1), axis=0)
            zero = np.zeros(len(got), np.int64)
            yield T.batch(MEMBER, np.ones(len(got), np.int8), zero, got[:, 0], got[:, 1], zero, zero)

    return run


def tile_pairs(percent: int, limit: int = 500_000):
    """Pairs of a list's members, of two chunks of it or within one, that are of different components and may be similar.

    The first token that two sets share lies early enough in both to leave room for the overlap, and their sketches differ
    in no more bits than similar sets do in tokens.
    """

    def run(batches):
        t = T.table_of(batches, TILE)
        if not t.num_rows:
            return
        token, node, place, label, a, b, own = (T.column(t, c) for c in ("token", "node", "place", "label", "a", "b", "own"))
        mark = np.frombuffer(b"".join(t.column("mark").to_pylist()), np.uint64).reshape(-1, MARK_BITS // 64)
        order = np.lexsort((node, b, a, token))
        token, node, place, label, a, b, own, mark = token[order], node[order], place[order], label[order], a[order], b[order], own[order], mark[order]
        n, place, _ = unpacked(place)
        edge = _edges(token, a, b)
        mixed = np.maximum.reduceat(label, edge[:-1]) != np.minimum.reduceat(label, edge[:-1])
        size = np.diff(edge)
        found = [np.zeros((0, 2), np.int64)]

        def compare(i: np.ndarray, j: np.ndarray):
            ok = (label[i] != label[j]) & fits(n[i], n[j], percent) & ((a[i] == b[i]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            least = overlap(n[i], n[j], percent)
            ok = (place[i] + least <= n[i]) & (place[j] + least <= n[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(mark[i] ^ mark[j]).sum(1, dtype=np.int64) <= allowed(n[i], n[j], percent)
            pair = np.stack([node[i[ok]], node[j[ok]]], 1)
            found.append(np.unique(np.sort(pair, axis=1), axis=0))

        for m in np.unique(size[mixed]).tolist():
            at = edge[:-1][mixed & (size == m)]
            if m * m <= limit:
                i, j = np.triu_indices(m, 1)
                for part in np.array_split(at, max(1, len(at) * len(i) // limit)):
                    compare((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
            else:
                step = max(1, limit // m)
                for x in at.tolist():
                    for lo in range(0, m, step):
                        i, j = np.meshgrid(np.arange(lo, min(m, lo + step)), np.arange(m), indexing="ij")
                        upper = i < j
                        compare(x + i[upper], x + j[upper])
        got = np.unique(np.concatenate(found), axis=0)
        yield T.batch(PAIR, got[:, 0], got[:, 1])

    return run


def may_be_similar(percent: int):
    """Pairs whose whole sketches allow the overlap."""

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = t.column("hub_sketch"), t.column("other_sketch")
            size = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (x, y)]
            a, b = (T.column(t, c).astype(np.int64) for c in ("hub_n", "other_n"))
            ok = fits(a, b, percent)
            for p, q in np.unique(np.stack(size, 1)[ok], axis=0).tolist():
                rows = np.flatnonzero(ok & (size[0] == p) & (size[1] == q))
                for part in np.array_split(rows, max(1, len(rows) * max(p, q) >> 24)):
                    left, right = (folded(np.frombuffer(b"".join(c.take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), w), min(p, q)) for c, w in ((x, p), (y, q)))
                    ok[part] = differ(left, right) <= allowed(a[part], b[part], percent)
            yield T.batch(PAIR, T.column(t, "hub")[ok], T.column(t, "other")[ok])

    return run


class Index:
    """Inverted lists over a group of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.rows = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray, percent: int, mu: float = 0.01) -> np.ndarray:
        """Rows whose Jaccard similarity with the query is at least so many percent."""
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        lo, hi = lo[hi > lo], hi[hi > lo]
        least = (percent * len(query) + 99) // 100
        if len(lo) < least:
            return np.zeros(0, np.int64)
        n = hi - lo
        order = np.argsort(n, kind="stable")
        lo, hi, n = lo[order], hi[order], n[order]
        aside = min(least - 1, int(least / (mu * np.log2(n[-1] + 1) + 1)))
        short = len(lo) - aside
        flat = np.arange(n[:short].sum()) - np.repeat(np.cumsum(n[:short]) - n[:short], n[:short]) + np.repeat(lo[:short], n[:short])
        count = np.bincount(self.rows[flat], minlength=len(self.sizes))
        need = overlap(len(query), self.sizes, percent)
        found = np.flatnonzero(fits(self.sizes, np.int64(len(query)), percent) & (count >= np.maximum(1, need - aside)))
        for a, b in zip(lo[short:].tolist(), hi[short:].tolist(), strict=True):
            if not len(found):
                break
            rows = self.rows[a:b]
            at = np.minimum(np.searchsorted(rows, found), len(rows) - 1)
            count[found] += rows[at] == found
        both = count[found]
        return found[100 * both >= percent * (self.sizes[found] + len(query) - both)]


def first_texts(batches):
    """Each node's text once a batch."""
    for b in batches:
        if b.num_rows:
            _, at = np.unique(T.column(b, "node"), return_index=True)
            yield b.take(pa.array(at))


def linked(sets_of: Sets, percent: int):
    """Links of a group: each of its hubs is searched for in an index of the others."""

    def run(t: pa.Table) -> pa.Table:
        hub = t.column("hub").to_numpy()
        nodes = T.column(t, "node")
        sets = sets_of(t.column("text").combine_chunks())
        others = np.flatnonzero(~hub)
        index = Index([sets[i] for i in others])
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(hub).tolist():
            rows = index.search(sets[i], percent)
            v.append(nodes[others[rows]])
            u.append(np.full(len(rows), nodes[i]))
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def small(df: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, to be sent to all executors if its rows are few enough."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


class Join:
    """The sets of a table's documents (signature: a row a document) and the links between different sets."""

    def __init__(self, docs: DataFrame, sets_of: Sets, percent: int, chunk: int = CHUNK, list_rows: int = LIST_ROWS, banded: bool = False):
        self.sets_of, self.percent, self.chunk, self.list_rows, self.banded = sets_of, percent, chunk, list_rows, banded
        self.spark = docs.sparkSession
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        arrow = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
        schema = pa.schema([("kind", pa.int8()), ("doc_id", arrow), ("n", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("sketch", pa.binary())])
        made = G.kept(self.docs.mapInArrow(T.lean(signatures(sets_of, schema)), f"kind byte, doc_id {kind}, n long, key long, text_hash long, sketch binary"))
        self.signature = made.where("kind = 0").drop("kind")
        common = made.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect()
        self.common = [(r["key"], r["n"]) for r in common]
        sets = self.signature.where("n > 0").groupBy(F.col("key").alias("node"))
        self.sets = G.kept(sets.agg(F.first("n").alias("n"), F.min("text_hash").alias("text_hash"), F.first("sketch").alias("sketch")))

    def lists(self) -> DataFrame:
        """Members of lists and the pairs of hubs."""
        tokens = np.array([x for x, _ in self.common], np.int64).view(np.uint64)
        order = np.argsort(tokens)
        rank = (len(tokens) - 1 - order).astype(np.int64)
        many = {x: n for x, n in self.common if n > self.list_rows}
        if self.banded:
            many = {int(x): n for t, n in many.items() for x in T.signed(in_band(np.full(BANDS, t, np.int64).view(np.uint64), np.arange(BANDS)))}
        listed = self.docs.mapInArrow(T.lean(rare_tokens(self.sets_of, self.percent, tokens[order], rank, self.banded)), LISTED_DDL)
        by = ["token"]
        if many:
            parts = F.create_map(*(F.lit(y) for x, n in many.items() for y in (x, -(-n // self.list_rows))))
            by.append(F.pmod(F.xxhash64("node"), F.coalesce(F.try_element_at(parts, F.col("token")), F.lit(1))))
        return G.kept(listed.repartition(self.n, *by).mapInArrow(T.lean(members(self.percent, many)), MEMBER_DDL))

    def links(self, pairs: DataFrame) -> DataFrame:
        """u, v: the pairs that are similar."""
        sets = self.sets.select("node", "n", "sketch")
        for c in PAIR.names:
            pairs = pairs.join(sets.withColumnsRenamed({"node": c, "n": f"{c}_n", "sketch": f"{c}_sketch"}), c)
        similar = G.kept(pairs.mapInArrow(T.lean(may_be_similar(self.percent)), PAIR_DDL))
        sizes = self.sets.select(F.col("node").alias("other"), "n")
        pairs = similar.join(sizes, "other")
        load = pairs.groupBy("hub").agg(F.sum("n").alias("load"))
        groups = max(1, -(-(load.agg(F.sum("load")).first()[0] or 0) // GROUP_TOKENS))
        part = F.pmod(F.xxhash64("other"), F.ceil(F.col("load") * 4 / GROUP_TOKENS))
        dealt = pairs.join(load, "hub").select("hub", "other", F.pmod(F.xxhash64("hub", part), F.lit(groups)).alias("g"))
        wanted = G.kept(dealt.select("g", F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "hub").alias("hub")) for c in PAIR.names))).alias("x")).select("g", "x.*").distinct())
        needed = G.kept(wanted.select("node").distinct().join(self.sets.select("node", "text_hash"), "node"))
        texts = self.docs.select("text_hash", "text").join(small(needed), "text_hash").select("node", "text").mapInArrow(T.lean(first_texts), "node long, text string")
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
        found = wanted.join(texts, "node").select("g", "node", "hub", "text").groupBy("g").applyInArrow(T.lean_group(linked(self.sets_of, self.percent)), "u long, v long")
        out = G.kept(found)
        G.dropped(similar, wanted, needed)
        return out

    def labels(self) -> DataFrame:
        """node, label: the component of each set that is similar to another."""
        listed = self.lists()
        pairs = listed.where("kind = 1").select(F.col("token").alias("hub"), F.col("node").alias("other")).distinct()
        found = self.links(pairs)
        near = G.components(found)
        G.release(self.spark)
        marks = self.sets.mapInArrow(T.lean(_marks), "node long, mark binary").join(near, "node", "left").withColumn("label", F.coalesce("label", "node"))
        chunks = F.ceil(F.col("size") / self.chunk).cast("int")
        lists = listed.where("kind = 0")
        # a large family's lists share a home: the more rows it has, the more parts
        large = lists.groupBy("home").agg(F.sum(chunks).alias("rows")).where(F.col("rows") > HOME_PARTS * HOME_ROWS)
        large = G.kept(large.select("home", F.ceil(F.col("rows") / HOME_ROWS).alias("parts")))
        lists = lists.join(small(large), "home", "left").withColumn("part", F.pmod(F.xxhash64("token"), F.coalesce("parts", F.lit(HOME_PARTS))))
        tiles = lists.join(marks, "node").withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int"))
        tiles = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
        tiles = tiles.select(*LISTED.names, "home", "label", "mark", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "own", "part")
        pairs = G.kept(tiles.repartition(self.n, "home", "part", "a", "b").drop("part").mapInArrow(T.lean(tile_pairs(self.percent)), PAIR_DDL).distinct())
        more = self.links(pairs)
        G.dropped(listed, near, large, pairs)
        G.release(self.spark)
        out = G.components(found.unionByName(more))
        G.dropped(found, more)
        return out


def _marks(batches):
    """The short sketch of each node."""
    schema = pa.schema([("node", pa.int64()), ("mark", pa.binary())])
    for b in batches:
        if b.num_rows:
            marks = [folded(np.frombuffer(x, np.uint8)[None], MARK_BITS // 8).tobytes() for x in b.column("sketch").to_pylist()]
            yield T.batch(schema, b.column("node"), marks)


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, chunk: int = CHUNK, list_rows: int = LIST_ROWS) -> DataFrame:
    """Groups documents whose sets of k-word shingles have a Jaccard similarity of percent/100 or more.

    docs: doc_id of any type that has an order, and text; other columns are ignored whatever their names. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z as a-z. Returns doc_id, n_shingles and component_id, the least doc_id reachable over
    links, a row a row of docs. A text of fewer than k words is one shingle; a null or empty text has none and links
    with nothing. Each row stands for itself, whatever its doc_id: rows with null or equal doc_id are linked by their
    texts alone, and a null is no least doc_id, so that component_id is null only if all of a component are. An empty
    table gives an empty result. Exact but for 64-bit fingerprints.
    """
    return components_of(Join(docs, partial(shingle_sets, k=k), percent, chunk, list_rows), "n_shingles")


def components_of(join: Join, size: str) -> DataFrame:
    """doc_id, the size of its set and component_id of each row of a join's documents."""
    own = join.signature.select("doc_id", F.col("n").alias(size), "key")
    classes = own.where(F.col(size) > 0).groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(join.labels().withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = G.kept(classes.join(least, "label").select("key", "component_id", F.lit(True).alias("has")))
    out = own.join(classes, (own["key"] == classes["key"]) & (own[size] > 0), "left")
    return out.select("doc_id", size, F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=5, percent=75)

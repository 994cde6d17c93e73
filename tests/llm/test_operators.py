"""The operators against brute force, with nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from terralith.llm import language_id, ngram_join, quality_net, registry, ring_shards, source_mix, spot_signatures, substring_dedup, suffix_dedup, tiling, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, g int, key long, node long, shard int, label string"


def corpus() -> list[tuple]:
    """Random words with shared passages, copies, near copies, null and empty texts, one long text and repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(120)]
    texts: list[str | None] = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 30) :]
        texts.append(" \n"[i % 2].join(w))
    base = [rng.choice(words) for _ in range(200)]
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 99)
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], None, "", "   ", "one two", "One TWO", "ab " * 1500, " ".join(rng.choice(words) for _ in range(30000))]
    rows = [(i, t, "ab"[i % 2], [None, "s1", "s2", "s3"][i % 4], 0, 1, 2, 3, 4, "x") for i, t in enumerate(texts)]
    return [*rows, (None, texts[5], None, None, 0, 1, 2, 3, 4, "x"), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def unique(rows):
    return {r["doc_id"]: r for r in rows}


def test_substring_dedup(docs, empty):
    got = substring_dedup.seed_extend_dedup(docs, window=20, group_bytes=20_000).collect()
    rows = sorted(((-1 if r[0] is None else r[0]), r[1]) for r in corpus())
    assert len(got) == len(rows)
    first: dict = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    want = {}
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        want[i] = (len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    for r in got:
        assert (r.n_words, r.kept) == want[-1 if r.doc_id is None else r.doc_id]
        assert sum(s.stop - s.start for s in r.spans) == r.n_words - len(WORD.findall(r.kept))
    assert substring_dedup.seed_extend_dedup(empty).collect() == []


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.suffix_array_dedup(docs, window=60, seed=40, group_bytes=30_000).collect()
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    count = collections.Counter(t[k : k + 60] for t in texts for k in range(len(t) - 59))
    want = collections.Counter()
    for (i, *_), t in zip(corpus(), texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - 59):
            if count[t[k : k + 60]] > 1:
                gone[k : k + 60] = b"\1" * 60
        want[i, bytes(x for x, g in zip(t, gone, strict=True) if not g)] += 1
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.suffix_array_dedup(empty).collect() == []


def test_suffixes_across_boundaries():
    """Whatever the places where sorted suffixes are cut, what is said of them is the same."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 40)), s % 4, s, s * 100 + int(rng.integers(0, 1 + s % 3)), False) for s in rng.integers(0, 6, 120).tolist()]
    rows = sorted({(g, lead, seed, name): (g, lead, seed, name, t) for g, lead, seed, name, t in rows}.values(), key=lambda r: (r[1], r[2], r[3], r[0]))

    def say(cuts):
        inner, pending, ends = [], [], []
        for bucket, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            if a == z:
                continue
            table = pa.Table.from_pydict({n: [r[k] for r in rows[a:z]] for k, n in enumerate(suffix_dedup.SUFFIX.names)}, schema=suffix_dedup.SUFFIX)
            for b in suffix_dedup._compared(table, bucket):
                for r in b.to_pylist():
                    (inner, pending, ends)[r["kind"]].append(r)
        ends.sort(key=lambda r: (r["bucket"], not r["head"]))
        over = {s: (several, names) for s, several, names in suffix_dedup.across([(r["bucket"], r["seed"], r["name"], r["last"], r["several"]) for r in ends])}
        for r in pending:
            several, names = over[r["seed"]]
            r["repeated"], r["several"] = r["repeated"] or r["name"] in names, r["several"] or several
        return {(r["g"], r["seed"], r["name"], r["repeated"], r["several"]) for r in inner + pending if r["repeated"] or r["several"]}

    whole = say([])
    for _ in range(60):
        assert say(sorted(rng.integers(0, len(rows) + 1, rng.integers(1, 14)).tolist())) == whole


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 50, 30000), rng.integers(0, 9, 30000)]
    assert (suffix_dedup.multikey_order(keys, small=100) == np.lexsort(keys[::-1])).all()


def test_pieces_hold_every_window_once():
    from terralith.llm import _seeds

    values = np.random.default_rng(1).integers(0, 2**60, 5000).astype(np.uint64)
    starts = np.array([0, 3, 3, 4000, 5000])
    for limit in (50, 700, 10_000):
        r = _seeds.runs_of(values, starts, 7, 20, limit)
        at, run = _seeds.windows_of(r.first, r.last)
        assert sorted(zip(r.row[run], at, strict=True)) == [(d, k) for d in range(4) for k in range(starts[d + 1] - starts[d] - 19)]


def jaccard_components(rows, percent=75):
    """Of each row its set's size, and the least id of its component, by all pairs."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [WORD.findall((t or "").translate(fold)) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                up[find(a)] = find(b)
    of = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        of[find(a)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in of.items()}
    return collections.Counter((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("chunk,list_rows", [(ngram_join.CHUNK, ngram_join.LIST_ROWS), (3, 4)])
def test_ngram_join(docs, empty, chunk, list_rows):
    got = ngram_join.ngram_jaccard_join(docs, chunk=chunk, list_rows=list_rows).collect()
    assert collections.Counter(map(tuple, got)) == jaccard_components([r[:2] for r in corpus()])
    if chunk == 3:
        assert ngram_join.ngram_jaccard_join(empty).collect() == []


@pytest.mark.parametrize("chunk,list_rows", [(ngram_join.CHUNK, ngram_join.LIST_ROWS), (7, 10)])
def test_ngram_join_near_the_threshold(spark, chunk, list_rows):
    """Families whose copies are about as similar to their source, and less to one another, than the threshold asks."""
    rng = random.Random(11)
    rows = []
    for size in (12, 30, 60, 100, 180):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(2, size // 30 + 1))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append((rng.choice([None, *range(1000)]), " ".join(w[rng.randint(0, size // 12) :])))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = ngram_join.ngram_jaccard_join(docs, chunk=chunk, list_rows=list_rows).collect()
    assert collections.Counter(map(tuple, got)) == jaccard_components(rows)


def test_large_family_is_dealt_to_many_tasks(spark, monkeypatch):
    """Copies of one text that share most of their tokens: a task gets a few of the lists, not a fourth of them."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    plain = ngram_join.tile_pairs

    def tile_pairs(percent):
        run = plain(percent)

        def watched(batches):
            got = list(batches)
            if sum(b.num_rows for b in got) > 1200:
                raise ValueError("too many rows in a task")
            return run(got)

        return watched

    monkeypatch.setattr(ngram_join, "tile_pairs", tile_pairs)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert collections.Counter(map(tuple, got)) == jaccard_components(rows)


@pytest.mark.parametrize("chunk", [ngram_join.CHUNK, 4])
def test_spot_signature_join(docs, empty, chunk):
    rows = [r[:2] for r in corpus()]
    sets = [set(x.tolist()) for x in spot_signatures.spot_sets(pa.array([t for _, t in rows], pa.large_string()))]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                up[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)] += [] if i is None else [i]
    want = collections.Counter((i, len(sets[a]), min(least[find(a)], default=None)) for a, (i, _) in enumerate(rows))
    assert collections.Counter(map(tuple, spot_signatures.similar_documents(docs, chunk=chunk).collect())) == want
    if chunk == 4:
        assert spot_signatures.similar_documents(empty).collect() == []


def test_size_bands_hold_similar_sets():
    n = np.arange(1, 3000)
    band = ngram_join.size_band(n, 75)
    for a in range(1, 3000, 7):
        near = (100 * np.minimum(a, n) >= 75 * np.maximum(a, n))
        assert (abs(band[near] - band[a - 1]) <= 1).all()


def test_sketches_differ_less_than_sets():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 300, 900):
        s = rng.integers(0, 2**62, size).astype(np.uint64)
        t = np.unique(np.concatenate([s[rng.random(size) < 0.9], rng.integers(0, 2**62, size // 5).astype(np.uint64)]))
        s = np.unique(s)
        a, b = (np.frombuffer(ngram_join.sketch(x), np.uint8)[None] for x in (s, t))
        width = min(a.shape[1], b.shape[1])
        assert ngram_join.differ(ngram_join.folded(a, width), ngram_join.folded(b, width))[0] <= len(np.setxor1d(s, t))


def test_t_occurrence_search_is_jaccard():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(200)]
    index = ngram_join.Index(sets)
    for q in sets[:60]:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert index.search(q, 75).tolist() == want


def test_ring_shards(docs, empty):
    got = ring_shards.ring_shards(docs, shards=7, nodes=32).collect()
    count = collections.Counter(r.shard for r in got)
    assert sum(count.values()) == len(corpus()) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    loose = ring_shards.ring_shards(docs, shards=7, nodes=32, slack=0.5).collect()
    more = ring_shards.ring_shards(docs, shards=8, nodes=32, slack=0.5).collect()
    moved = sum(a != b for a, b in zip(sorted((r.doc_id or -1, r.text or "", r.shard) for r in loose), sorted((r.doc_id or -1, r.text or "", r.shard) for r in more), strict=True))
    assert moved < len(corpus()) / 2
    assert ring_shards.ring_shards(empty, shards=7).collect() == []


def test_source_mix(docs, empty):
    mix = source_mix.mix_sources(docs)
    rows, taken = mix.rows.collect(), collections.Counter()
    for r in mix.schedule.collect():
        taken[r.sid, r.at] += r.stop - r.start
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        t = taken[r.sid, r.at] if r["size"] else 0
        assert t <= 3 * r["size"]
        by[r.sid] = [by[r.sid][0] + t, r.source_size, r.target]
    assert len(rows) == len(corpus())
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in corpus())
    assert sum(v[1] for v in by.values()) == total and sum(v[2] for v in by.values()) == pytest.approx(total)
    for t, size, target in by.values():
        assert abs(t - target) <= 0.01 * size + 2
    assert source_mix.mix_sources(empty).schedule.collect() == []


def test_targets_fill_up():
    assert source_mix.fill_targets([10, 100, 100], [1, 1, 1], 210, 3) == pytest.approx([30, 90, 90])
    assert source_mix.fill_targets([], [], 0, 3) == []


def test_spot_signatures(docs, empty):
    got = spot_signatures.fingerprints(docs).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    order = [r[0] for r in rows]
    for i in (50, 20, 7):
        a, b = texts[i], texts[order[order.index(i) + 1]]
        k = len(a) // 3
        assert unique(got)[i].edited_sha256 == hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()
    a, b = texts[None], texts[max(i for i in texts if i is not None)]
    assert unique(got)[None].edited_sha256 == hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    same = collections.defaultdict(set)
    for r in got:
        same[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in same.values())
    assert spot_signatures.fingerprints(empty).collect() == []


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/1", "http://x.net/es/1#t", "http://xnet/es/", "http://a.com", None, "no scheme", "", "http://notexample.com/en/", "ftp://h.net/fr/../a"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("net/es/", "block")
    assert got[3].rule is None and got[4].rule is None and got[4].path == ""
    assert all(got[i].host == got[i].path == "" for i in (5, 6, 7))
    assert got[8].rule == "com/" and got[9].rule == "net/fr/"
    w, b = url_filter.fit([*url_filter.ALLOWED, *url_filter.BLOCKED], [0] * len(url_filter.ALLOWED) + [1] * len(url_filter.BLOCKED))
    score = [sum(w[url_filter.grams(t)]) / len(url_filter.grams(t)) ** 0.5 + b for t in (*url_filter.ALLOWED, *url_filter.BLOCKED)]
    assert max(score[: len(url_filter.ALLOWED)]) < 0 < min(score[len(url_filter.ALLOWED) :])
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_url_filter_of_hosts_it_was_not_trained_on(spark):
    bad = ["casino-win", "adult-x", "spam-farm", "ads-track"]
    trained = " ".join([*url_filter.ALLOWED, *url_filter.BLOCKED])
    assert not any(h + "." in trained for h in bad)
    hosts = [*bad, "bird-songs", "city-library", "old-harbour", "baking-class"]
    urls = [(h, f"https://{p}{h}.example.{t}/{lang}/{n}") for h in hosts for p in ("", "www.", "m.", "blog.") for t in ("net", "org") for lang in ("en", "de") for n in (7, 428, 9931)]
    got = collections.defaultdict(list)
    for r in url_filter.judge_urls(spark.createDataFrame(urls, "h string, url string")).collect():
        assert r.rule is None
        got[r.h].append(r.verdict == "block")
    assert all(np.mean(got[h]) > 0.9 for h in bad) and all(np.mean(got[h]) < 0.1 for h in hosts[4:])
    free = url_filter.judge_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("rule is null and host <> ''").collect()
    words = "casino|adult|spam|ads-|bets|pills"
    assert all(r.verdict == "block" for r in free if re.search(words, r.host))
    assert np.mean([r.verdict == "block" for r in free if not re.search(words, r.host)]) < 0.02


def brute_tiles(a: list, b: list, tile: int) -> int:
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < tile:
            return total
        used_a[i : i + n] = used_b[j : j + n] = [True] * n
        total += n


def test_tiling(spark, docs, empty):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    item = [rng.choice(words) for _ in range(40)]
    reordered = item[25:] + ["x"] * 3 + item[:15]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (None, "a b c d e f g")], "item_id long, text string")
    other = spark.createDataFrame([(1000, "Start, " + " ".join(reordered).upper() + " end"), (1001, " ".join(item[:12]))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(other)
    got = tiling.contaminated(both, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1000, 7)]
    assert got[0].covered == brute_tiles(reordered, item, 5)
    left = tiling.without_contaminated(both, benchmark)
    assert left.count() == both.count() - 1
    assert tiling.contaminated(empty, benchmark).collect() == [] and tiling.contaminated(docs, benchmark.limit(0)).collect() == []
    for _ in range(30):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(3, 25))] for _ in range(2))
        pairs = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        got_n = sum(t[2] for t in tiling.tiles(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int), 3)) if pairs else 0
        assert got_n == brute_tiles(a, b, 3)


def test_language_id(spark, docs, empty):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(real, ~language_id.held_out())
    got = language_id.identify(real, model).where(language_id.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = {r.doc_id: r for r in language_id.identify(docs.withColumn("score", F.lit("x")), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i, t, *_ in corpus() if not re.search("[a-zé]", t or ""))
    none = language_id.train(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).collect() == []
    codes = language_id.codewords(9)
    assert min((codes[i] != codes[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_quality_net(spark, docs, empty):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality_net.train(real, labels, ~quality_net.held_out())
    got = quality_net.judge(real, net).join(labels, "doc_id").where(quality_net.held_out()).collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert len(quality_net.judge(docs, net).collect()) == len(corpus())
    assert quality_net.judge(empty, net).collect() == []
    blank = quality_net.train(real, labels.limit(0), F.lit(True))
    assert quality_net.judge(real.limit(3), blank).count() == 3


def test_quality_net_reads_whole_texts():
    net = quality_net.fit([], [])
    text = "a" * 5000
    a, b = quality_net.scores(net, pa.array([text, text[:-1] + "é!!"]))
    assert a != b


def test_quality_net_scores_of_each_text_alone():
    rng = np.random.default_rng(8)
    net = quality_net.fit([], [])
    texts = ["".join(rng.choice(list("abcdefgh é"), n)) for n in [*range(0, 140), *range(500, 600), 66000, 66001]]
    alone = [quality_net.scores(net, pa.array([t]))[0] for t in texts]
    for order in (np.arange(len(texts)), rng.permutation(len(texts)), rng.permutation(len(texts))):
        assert quality_net.scores(net, pa.array([texts[i] for i in order])).tolist() == [alone[i] for i in order]
    # against the definition: every place of a filter, zeros after the text, a chunk's and then the text's maxima
    for t, s in zip(texts[:240], alone[:240], strict=True):
        b = np.frombuffer(t.encode(), np.uint8)
        places = max(0, -(-(len(b) - quality_net.WIDTH) // quality_net.STRIDE)) + 1
        padded = np.concatenate([b, np.zeros(quality_net.WIDTH + 2, np.uint8)])
        act = np.stack([net.embed[padded[2 * p : 2 * p + quality_net.WIDTH]].ravel() @ net.filters for p in range(places)])
        step = quality_net.BLOCK * (quality_net.BLOCKS - 1)
        chunks = max(1, -(-(-(-places // quality_net.BLOCK) - 1) // (quality_net.BLOCKS - 1)))
        top = np.stack([np.maximum(act[k * step : k * step + quality_net.PLACES].max(0) + net.bias, 0) for k in range(chunks)])
        x = np.concatenate([top.mean(0), top.max(0)]) @ net.out + net.last
        assert s == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-5)


def test_quality_net_sums_are_exact():
    """What a place says doesn't depend on the order of a sum, and so on the machine's kernels or the rows beside it."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in rng.integers(0, 300, 80).tolist()]
    for net in (quality_net.fit([], []), quality_net.fit(texts, [len(t) % 2 for t in texts])):
        # texts of one chunk, whose last place ends with the text
        for t in [t[: len(t) // 2 * 2] for t in texts if 12 <= len(t) <= quality_net.CHUNK_BYTES]:
            got = quality_net.pooled(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, quality_net.FILTERS :]
            under = [net.embed[np.frombuffer(t[k : k + quality_net.WIDTH], np.uint8)].ravel().astype(float) for k in range(0, len(t) - quality_net.WIDTH + 1, 2)]
            most = np.array([max(math.fsum(u * f) for u in under) for f in net.filters.T.astype(float)]).astype(np.float32)
            assert got.tolist() == np.maximum(most + net.bias, 0).tolist()


def test_pipeline_stages(spark, docs):
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert len(last) == rows.count() and {r.shard for r in last} <= set(range(40))


def test_near_duplicates_of_null_and_shared_ids(spark):
    rng = random.Random(6)
    words = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(8)]
    texts = [" ".join(w) for w in words]
    near = " ".join([*words[0][:-1], "other"])
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, near), (7, texts[5]), (3, texts[6]), (4, texts[6]), (8, texts[7]), (8, texts[7]), (None, None), (9, ""), (9, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
    want = [r for r in rows if r not in ((6, near), (4, texts[6]))]
    want.remove((8, texts[7]))
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_names():
    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert zlib.crc32(b"") == 0

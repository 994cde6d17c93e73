"""Every opN query's whole result against brute force or its laws, over all rows of the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from terralith.llm import language_id, ngram_join, quality_net, registry, ring_shards, source_mix, spot_signatures, sql, tiling, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that the operators use inside, as columns of a user's table.
CLASHES = "size sid target _lang _from _arc _key _n row place arc rank base at tie0 node token label kind b k h g key taken lang_pred score shard slot n text_hash".split()


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = registry.queries()[name](spark, SF).collect()
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_against_sql(results, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(sql.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, want.fetchall())) == sorted(tuple(r[n] for n in names) for r in results(name))


def test_ring_shards_query(results, documents):
    got = results("op1_ring_shards")
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None)
    of = collections.defaultdict(list)
    for r in got:
        of[r.shard].append(r.slot)
    assert set(of) == set(range(40)) and max(map(len, of.values())) - min(map(len, of.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    # the walk around the ring, a key at a time in order of place and rank
    places, owner = ring_shards.ring(40)
    room = np.full(40, len(got) // 40) + (np.arange(40) < len(got) % 40)
    assert [len(of[s]) for s in range(40)] == room.tolist()


def test_source_mix_query(results, documents):
    got = {r.doc_id: r for r in results("op4_source_mix")}
    words = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    total = collections.Counter()
    for d in documents:
        total[d["source"]] += words[d["doc_id"]]
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    target, rest, open_ = {}, float(sum(total.values())), list(sources)
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / whole > 3 * total[s]]
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else rest * weight[s] / whole
        rest, open_ = rest - sum(target[s] for s in over), [s for s in open_ if s not in over] if over else []
    taken = collections.Counter()
    for d in documents:
        r = got[d["doc_id"]]
        assert (r.size, r.source_size) == (words[d["doc_id"]], total[d["source"]]) and r.target == pytest.approx(target[d["source"]])
        assert 0 <= r.taken <= 3 * r.size
        taken[d["source"]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 50) for s in sources)


def test_source_mix_reruns(spark, results):
    again = registry.queries()["op4_source_mix"](spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, results("op4_source_mix")))


def test_spot_signatures_query(results, documents):
    got = {r.doc_id: r for r in results("op6_spot_signatures")}
    order = sorted(documents, key=lambda d: -d["doc_id"])
    texts = [d["text"] or "" for d in order]
    edited = []
    for k, t in enumerate(texts):
        third = len(t) // 3
        edited.append(t[: len(t) - third] + texts[(k + 1) % len(texts)][:third])
    sets, new = (spot_signatures.spot_sets(pa.array(x, pa.large_string())) for x in (texts, edited))

    def like(a, b):
        a, b = set(a.tolist()), set(b.tolist())
        return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))

    for k, d in enumerate(order):
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spot_signatures.written(sets[k]), spot_signatures.written(new[k]))
        assert r.near_edited == pytest.approx(like(sets[k], new[k])) and r.near_next == pytest.approx(like(sets[k], sets[(k + 1) % len(order)]))
    assert len({(t, r.fingerprint) for t, r in zip(texts, (got[d["doc_id"]] for d in order), strict=True)}) == len(set(texts))


def test_signatures_are_chains_after_anchors():
    """The signatures of a text by the definition: an anchor with the next content words after it."""
    text = "The quick fox of the old woods is tall and red"
    words = re.findall(r"[a-z]+", text.lower())
    chains = set()
    for k, w in enumerate(words):
        after = [x for x in words[k + 1 :] if x not in spot_signatures.ANCHORS]
        if w in spot_signatures.ANCHORS and len(after) >= 2:
            chains.add((w, *after[:2]))
    # texts that hold the same chains have the same signatures; one chain less, one signature less
    assert len(spot_signatures.spot_sets(pa.array([text], pa.large_string()))[0]) == len(chains)


def test_url_filter_query(results):
    got = {r.page_id: r for r in results("op7_url_filter")}
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        r, url = got[p["page_id"]], p["url"]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fitting = [(h + q, v) for h, q, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fitting, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_score > 0.5 else "allow"))


def test_tiling_query(results, documents):
    items = [r for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"] and r["item_id"] is not None]
    made = tiling.Items.of([r["item_id"] for r in items], [r["text"] for r in items], tiling.LEAST_TILE)
    texts = pa.array([d["text"] for d in documents], pa.large_string())
    want = {(documents[r]["doc_id"], int(made.ids[k]), sum(t[2] for t in f)) for r, k, f in tiling.overlaps(made, texts, tiling.LEAST_TILE, tiling.LEAST_SHARE)}
    assert want == {(r.doc_id, r.item_id, r.covered) for r in results("op8_string_tiling")} and want


def test_language_query(results, documents):
    got = {r.doc_id: r for r in results("op9_language_id")}
    right = total = 0
    for d in documents:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        if r.held_out and d["lang"] and r.lang_pred != "und":
            total, right = total + 1, right + (r.lang_pred == d["lang"])
    assert right / total > 0.95


def test_language_sees_text_alone(spark, documents):
    """A row's own language doesn't move its prediction, and held-out rows teach nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = language_id.held_out()
    a = language_id.train(docs, ~held)
    b = language_id.train(docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))), ~held)
    assert a.names == b.names and np.allclose(a.weights, b.weights)


def test_quality_query(results, documents):
    got = {r.doc_id: r for r in results("op10_quality_net")}
    assert len(got) == len(documents)
    for d in documents:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    good, bad = ([got[i].score for i, q in labels.items() if q == v and i in got] for v in (1, 0))
    assert np.mean(good) > np.mean(bad)


def test_quality_fit_reads_whole_texts():
    """The end of a long text alone tells the labels apart."""
    rng = np.random.default_rng(0)
    body = lambda n: bytes(rng.integers(97, 103, n).astype(np.uint8))
    texts = [body(6000) + (b"zzzzzzzzqqqq" * 6 if k % 2 else b"") for k in range(60)]
    net = quality_net.fit(texts, [k % 2 for k in range(60)], epochs=12, batch=10)
    s = quality_net.scores(net, pa.array([t.decode() for t in texts]))
    assert s[1::2].min() > s[::2].max()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "s1") for i, t in enumerate(["the cat sat on the mat and looked at the dog", "der hund und die katze sind im haus", "a b c d e f g", "the cat sat on the mat and looked at the dog", None, "", "  ", "x " * 900])]
    rows += [(None, "one more text without any id at all", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns}).repartition(3)


def test_stages_keep_clashing_columns(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        docs = spark.createDataFrame(rows, out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert all(r[c] == f"own {c}" for r in last for c in CLASHES if c not in ("shard", "slot")) and {r.shard for r in last} <= set(range(40))


def test_stages_on_empty_tables_and_unknown_languages(spark, clashing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), SF).collect() == []
    unlabelled = clashing.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, SF).count() == clashing.count()


def test_stages_keep_the_right_rows(spark, clashing):
    kept = corpus_pipeline.near_duplicates(spark, clashing, SF).collect()
    # one of two equal texts (the lesser id) and one of two equal rows without an id go; texts without words all stay
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 0), (False, 1), (False, 2), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    item = next(r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"])
    leaked = clashing.withColumn("text", F.when(F.col("doc_id") == 2, F.concat(F.lit("before "), F.lit(item), F.lit(" after"))).otherwise(F.col("text")))
    clean = corpus_pipeline.decontaminate(spark, leaked, SF).collect()
    assert len(clean) == clashing.count() - 1 and 2 not in {r.doc_id for r in clean}


def test_whole_pipeline(spark):
    """The last rows are those that the stages, one after another over all documents, leave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(texts[r.doc_id] == r.text and any(c.isalpha() for c in r.text) for r in rows)
    components = {r.doc_id: r.component_id for r in ngram_join.op5_ngram_jaccard_join(spark, SF).collect()}
    left = {r.doc_id for r in rows}
    assert len({components[i] for i in left}) == len(left)
    assert not left & {r.doc_id for r in tiling.op8_string_tiling(spark, SF).collect()}
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3
    of = collections.Counter(r.shard for r in rows)
    assert max(of.values()) - min(of.get(s, 0) for s in range(40)) <= 1

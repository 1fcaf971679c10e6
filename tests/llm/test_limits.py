"""Large groups, odd magnitudes, awkward names, long runs: what small tables don't show."""

import json
import random
import threading
import time
from collections import Counter, defaultdict
from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dedup import exact_reference, near_reference, vector_reference

from millrace.llm import bpe, components, embeddings, exact_dedup, html, minhash, packing, page_families, pii, quality, sharding, storage, url_lists

# ---- near duplicates


def family(n, seed, words=60, shared=0.93):
    """Texts that differ from one text in a few words of their own."""
    rng = random.Random(seed)
    base = [f"s{seed}w{i}" for i in range(words)]
    return [" ".join(w if rng.random() < shared else f"s{seed}x{k}n{i}" for i, w in enumerate(base)) for k in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_large_nodes_lose_no_link(spark, depth):
    texts = [t for s in range(3) for t in family(120, s, shared=(0.99, 0.97, 0.93)[s])] + family(5, 9)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=1, node_limit=16, depth=depth, block=8).collect()}
    assert got == near_reference([i for i, _ in rows], texts, 1)


def test_hubs_cover_every_row_with_partners():
    rng = np.random.default_rng(2)
    for _ in range(50):
        agree = rng.integers(0, 33, (30, 30)).astype(np.uint8)
        agree = np.triu(agree, 1) + np.triu(agree, 1).T
        stars = minhash.hubs_of(agree, (26, 20, 14))
        assert all((agree[h, m] >= 14).all() for h, m in stars)
        members = [i for _, m in stars for i in m.tolist()]
        assert len(members) == len(set(members)) and {*members, *(h for h, _ in stars)} == set(np.flatnonzero((agree >= 14).any(1)).tolist())


def test_class_blocks_let_different_classes_meet(spark):
    rng = random.Random(4)
    rows = [(7, v, 0 if v < 40 else rng.choice([100, 101, 102, v])) for v in range(60)]
    met = defaultdict(set)
    for r in minhash.class_blocks(spark.createDataFrame(rows, "node long, v long, root long"), 8).collect():
        met[r.node].add(r.v)
    root = {v: r for _, v, r in rows}
    for a in root:
        for b in root:
            if root[a] != root[b]:
                assert any(a in m and b in m for m in met.values())
    assert max(map(len, met.values())) <= 40 and not any(sum(root[v] == 0 for v in m) > 20 for m in met.values())


def test_forests_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_VERTICES", 10)
    links = [(i, i + 1) for i in range(100)]
    got = components.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert {r.root for r in got} == {0} and len(got) == 101


def test_names_with_dots(spark):
    rows = [(1, "one two three four five six", "k"), (2, "one two  three four five six", "k"), (3, None, None)]
    t = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, `x.y` string")
    exact = exact_dedup.deduplicate(t, "doc.id", "the.text")
    near = minhash.deduplicate(t, "doc.id", "the.text")
    assert exact.columns == t.columns == near.columns and exact.count() == near.count() == 2
    assert exact_dedup.mark(t, "doc.id", "the.text").count() == 3
    assert minhash.near_duplicates(t, "doc.id", "the.text").count() == 3
    assert sharding.byte_shards(t, 2, "doc.id", "the.text").columns[0] == "doc.id"
    assert pii.detect(t, "doc.id", "the.text").collect()[0]["doc.id"] == 1
    labels = spark.createDataFrame([(1, 1), (2, 0)], "`doc.id` long, `q.l` int")
    model = quality.fit(t, labels, "q.l", "doc.id", "the.text")
    assert quality.score(t, model, "doc.id", "the.text", keep=("x.y",)).columns == ["doc.id", "x.y", "score"]
    for kept in (quality.accepted(t, model, 0.0, "the.text"), pii.scrub(t, "the.text")):
        assert kept.columns == t.columns and kept.count() == 3
    assert html.extract(t, html_col="the.text", keep=("doc.id",)).collect()[0]["doc.id"] == 1
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.encode(t, vocabulary, "doc.id", "the.text").columns[0] == packing.pack(t, vocabulary, id_col="doc.id", text_col="the.text").columns[0] == "doc.id"


# ---- exact duplicates


def test_texts_with_a_long_common_beginning_spill_again_and_again(spark):
    rng = random.Random(8)
    texts = ["same beginning of all " * 5 + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(800)]
    rows = list(enumerate(texts))
    got = exact_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), trie_bytes=4000, task_bytes=1 << 30).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact_reference(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=9).map(str.encode), min_size=1, max_size=40))
def test_subtrees_by_prefix(keys):
    trie = exact_dedup.Patricia()
    for k in keys:
        node = trie.terminal(k)
        node.value = (node.value or 0) + 1
    taken = []
    while (prefix := trie.largest()) is not None:
        some = list(trie.take(prefix))
        assert some and all(k.startswith(prefix) for k, _ in some)
        taken += some
    assert dict([*taken, *trie.drain()]) == Counter(keys)


# ---- embeddings


@pytest.mark.parametrize("scale", [1e200, 5e-324])
def test_vectors_of_any_magnitude(spark, scale):
    rows = [(1, [1.0, 1.0, 0.0]), (2, [1.0, 1.1, 0.0]), (3, [0.0, 0.0, 1.0])]
    rows = [(i, [scale * max(0.0, round(c)) if scale < 1e-300 else scale * c for c in v]) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_a_plan_whose_pairs_never_meet_takes_fewer_hashes():
    hashes, tables = embeddings.plan(10**15, 16, 0.7, 2, 1000, 1e-6)
    assert hashes < 10 and tables > 1
    with pytest.raises(ValueError, match="too low"):
        embeddings.plan(1000, 1 << 14, 0.0, 1, 1000, 1e-6)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for width in (3, 24, 100):
        a, b = rng.standard_normal((2, 4000, width))
        a, b = embeddings.unit(a), embeddings.unit(b - (embeddings.unit(a) * b).sum(1, keepdims=True) * embeddings.unit(a))
        p, q = embeddings.sketches(a), embeddings.sketches(0.9 * a + np.sqrt(0.19) * b)
        assert np.bitwise_count(p ^ q).sum(1).max() <= embeddings.most_apart(0.9, 1e-6)


def test_hot_buckets_count_every_link_once(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + 0.12 * rng.standard_normal((150, 16)), rng.standard_normal((150, 16)), np.repeat(centre[None], 3, 0)])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for block in (1 << 11, 20):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(t, block=block, bucket_rows=40).collect()}
        assert got == vector_reference(x, range(len(x)))


# ---- pages


def truth(page):
    found, _ = html.pieces(page, {}, around=True)
    return " ".join("".join(p.text for p in found if p.tag is not None or html.content(p)).split())


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_families_that_training_never_saw():
    names, scores = list(page_families.FAMILIES), {}
    for name in names:
        weights = html.train(page_families.pages([n for n in names if n != name]))
        held = page_families.pages([name], seed=99)
        scores[name] = sum(f1(html.main_text(p, weights), truth(p)) for p in held) / len(held)
    assert sum(scores.values()) / len(scores) >= 0.95 and min(scores.values()) >= 0.7, scores


@pytest.mark.parametrize("unit", ["<div>", "<p>word ", "</b>", "<li><a>x", "<b></i>"])
def test_unclosed_tags_take_linear_time(unit):
    html.default()
    start = time.perf_counter()
    html.main_text(unit * 100_000)
    assert time.perf_counter() - start < 3


def test_a_class_word_alone_deletes_no_article():
    prose = "The river rose over night and many families had to leave their homes before help arrived in the morning."
    for name in ("press-tags", "share", "banner", "popular"):
        page = f"<nav><a>Home</a> <a>World</a></nav><article><h1>High water</h1><p>{prose}</p><div class='{name}'><p>{prose}</p></div><p>{prose}</p></article><footer>All rights reserved</footer>"
        assert html.main_text(page) == f"High water {prose} {prose} {prose}", name


# ---- personal data


@pytest.mark.parametrize(
    "text",
    ["dot" + " " * 10**6, "dot " * 250_000, "[ " * 300_000, "x at y dot " * 90_000, "a at " + "b dot " * 160_000, "a-at-" + "b-dot-" * 160_000, "a_at_" + "b." * 400_000, "dot &#0000" * 100_000, "dot +1" + " " * 10**6],
)
def test_rewriting_takes_linear_time(text):
    start = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("john at example dot xyz", "email:0:23"),
        ("we pointed at the dot now", ""),
        ("met at seven dot five today", ""),
        ("a&#64;b&#46;org", "email:0:15"),
        ("a&commat;b&period;org", "email:0:21"),
        ("bob_at_example.com", "email:0:18"),
        ("bob-at-example-dot-museum", "email:0:25"),
        ("look_at_me.html created_at_utc", ""),
        ("bob   [at]   example.com", "email:0:24"),
    ],
)
def test_more_disguises(text, spans):
    assert pii.listing(pii.find(text)[1]) == spans


_MORE = ["bob", "x", "com", "org", "_at_", "-at-", "_dot_", "-dot-", "&#64;", "&#46;", "&commat;", "&period;", "&#x2E;", ".", "@", " ", " at ", " dot ", "one", "the", "_", "-"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(_MORE), max_size=10).map("".join))
def test_gate_lets_more_disguises_through(text):
    gated = pii.find(text)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii, "disguised", lambda _: True)
        assert pii.find(text) == gated


# ---- quality


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """The published per-coordinate update, over dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.copysign(l1, z[i])) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_scores_equal_plain_ftrl(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    bits = 12
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    turns = [r.doc_id for r in labels.where("quality is not null").select("doc_id", F.xxhash64("doc_id").alias("t")).orderBy("t", "doc_id").collect() if r.doc_id in texts]
    sparse = lambda t: dict(zip(*(a.tolist() for a in quality.features(t or "", bits)), strict=True))
    for most in (50_000_000, 3000):
        held, rows = 0, []
        for i in turns:
            held += len(x := sparse(texts[i]))
            if held <= most:
                rows.append(({k: float(np.float32(v)) for k, v in x.items()}, y[i]))
        assert (len(rows) == len(turns)) == (most > 3000) and rows
        w = plain_ftrl(rows, 2, 0.3, 1.0, 0.5, 1.0)
        model = quality.fit(docs, labels, bits=bits, max_features=most)
        got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
        want = {i: 1 / (1 + np.exp(-sum(w.get(k, 0.0) * v for k, v in sparse(t).items()))) for i, t in texts.items()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


# ---- URL lists


def test_as_of_equals_comparing_every_interval(spark):
    rng = random.Random(3)
    day = lambda: date(2023, 11, 20) + timedelta(rng.randint(0, 200))
    entries = [(rng.choice("lm"), rng.choice(["a.com", "b.a.com", "c.org/x"]), rng.choice(["add", "remove"]), day()) for _ in range(80)]
    urls = ["http://a.com/x", "http://b.a.com/", "http://z.c.org/x/y", "http://c.org/z", "http://other.net/"]
    captures = [(i, rng.choice(urls), day(), "k", 1, 2, 3) for i in range(300)]
    c = spark.createDataFrame(captures, "page_id int, url string, fetched_at date, `a.b` string, __n int, u int, t int")
    e = spark.createDataFrame(entries, "list string, key string, action string, at date")
    valid = [tuple(r) for r in url_lists.intervals(e).collect()]
    got = url_lists.active_lists(c, e)
    assert got.columns == [*c.columns, "host", "n_entries", "lists", "blocked"]
    names = {"http://a.com/x": {"a.com"}, "http://b.a.com/": {"a.com", "b.a.com"}, "http://z.c.org/x/y": {"c.org/x"}, "http://c.org/z": set(), "http://other.net/": set()}
    want = {}
    for i, url, at, *_ in captures:
        hits = [li for li, key, since, until in valid if key in names[url] and since <= at and (until is None or at < until)]
        want[i] = (len(hits), ",".join(sorted(set(hits))))
    assert {r.page_id: (r.n_entries, r.lists) for r in got.collect()} == want and any(n for n, _ in want.values())


# ---- vocabularies, stored tables


def test_settings_that_the_codec_does_not_follow_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 1, "content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError, match="isn't supported"):
            bpe.Codec(json.dumps(spec | change))


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_scopes_of_threads_are_their_own(spark):
    paths = {}

    def job(name):
        with storage.scope(spark, name):
            paths[name] = storage.stored(spark.range(3).toDF("x"), "t").inputFiles()

    threads = [threading.Thread(target=job, args=(f"job{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with storage.scope(spark, "job0"):
        pass
    assert spark.read.parquet(*{p.rsplit("/", 1)[0] for p in paths["job1"]}).count() == 3
    assert len(storage._made["job1"]) == 1 and "job0" not in storage._made

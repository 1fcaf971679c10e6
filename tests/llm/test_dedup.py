import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import components, embeddings, exact_dedup, minhash
from millrace.llm.queries import QUERIES

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


# ---- tries and components


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.text("ab", max_size=9).map(str.encode), max_size=40))
def test_trie_holds_each_string_once(keys):
    trie = exact_dedup.Patricia()
    for k in keys:
        node = trie.terminal(k)
        node.value = (node.value or 0) + 1
    assert dict(trie.drain()) == Counter(keys)
    firsts = list(trie.root.children or ())
    taken = [e for f in firsts for e in trie.take(f)]
    assert dict([*taken, *trie.drain()]) == Counter(keys)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 300))
def test_shared_prefix(a, cut):
    b = a[:cut] + b"\x00" + a[cut:]
    want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert exact_dedup.shared(a, 0, b, 0, min(len(a), len(b))) == want


def test_components_of_chains_stars_and_rings(spark):
    random.seed(5)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000), (1001, 1000)]
    random.shuffle(links)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, **{2000 + i: 2000 for i in range(50)}}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact


def exact_reference(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[(text or "").translate(SPACE)].append((-len(text or ""), doc is None, doc or 0, i))
    return {i: (rows[min(g)[3]][0], len(g), i == min(g)[3], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g}


@pytest.mark.parametrize("trie_bytes", [192 << 20, 2000])
def test_exact(spark, sf, trie_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "concat(' ', text) as text").where("doc_id % 2 = 0"))
    rows = [tuple(r) for r in more.collect()]
    got = exact_dedup.mark(more.repartition(5), trie_bytes=trie_bytes, task_bytes=1 << 14).collect()
    want = {rows[i][0]: v for i, v in exact_reference(rows).items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)


def test_exact_odd_rows(odd, none):
    got = exact_dedup.mark(odd).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == odd.count()
    assert [r.keep_id for r in by[1]] == [2] and by[1][0].group_size == 3 and not by[1][0].kept
    assert sorted(r.kept for r in by[2]) == [False, True]
    assert {i for i in (3, 4, 6) if by[i][0].kept} == {6} and by[3][0].group_size == 3
    assert by[None][0].kept and by[None][0].keep_id is None
    assert exact_dedup.mark(none).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.deduplicate(none).count() == 0


# ---- near


def shingle_sets(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def near_reference(ids, texts, words):
    sets = shingle_sets(texts, words)
    forest = components.Forest()
    index = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    for i, s in enumerate(sets):
        meets = Counter(j for x in s for j in index[x] if j < i)
        for j, n in meets.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                forest.join(i, j)
    least = {}
    for i, d in enumerate(ids):
        r = forest.find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[forest.find(i)] if sets[i] else d) for i, d in enumerate(ids)}


def test_near_misses_no_pair_at_the_threshold_at_the_last_depth(spark):
    """Sets of nine words of which a pair shares eight, so 8 / 10; every node with two members is split to the end."""
    rows = [(2 * i + side, " ".join([*(f"p{i}c{j}" for j in range(8)), f"p{i}s{side}"])) for i in range(300) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (2, 6):
        got = minhash.near_duplicates(docs, words=1, node_limit=1, depth=depth).collect()
        assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_number_of_trees():
    assert minhash.trees_for(80, 2) == 16
    for percent, depth in [(80, 1), (80, 2), (80, 6), (50, 2)]:
        n, t = minhash.trees_for(percent, depth), (percent / 100) ** depth
        assert (1 - t) ** n <= minhash.MISS < (1 - t) ** (n - 1)


@pytest.mark.parametrize(("words", "options"), [(4, {}), (5, {}), (4, {"node_limit": 4, "depth": 2, "block": 2})])
def test_near(spark, sf, words, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    # variants of some documents with one word in forty replaced, and more of one document
    random.seed(words)
    rows = [tuple(r) for r in docs.collect()]
    for d, t in rows[:60] + [rows[0]] * 40:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[random.randrange(len(w))] = random.choice(["alpha", "beta", "gamma"])
        rows.append((len(rows) + 10_000, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=words, **options).collect()
    want = near_reference([r[0] for r in rows], [r[1] for r in rows], words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_rows(odd, none):
    got = minhash.near_duplicates(odd, words=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.component_id for r in by[1] + by[2]} == {1} and by[1][0].kept and not any(r.kept for r in by[2])
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (3, 4, 6))
    assert by[7][0].n_shingles == 1 and by[5][0].n_shingles == 30_000 - 3
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert minhash.deduplicate(none).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(20)]
    got = minhash.intersections(sets, columns=16)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


# ---- embeddings


def vector_reference(x, ids):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = y @ y.T >= 0.9
    np.fill_diagonal(a, False)
    forest = components.Forest()
    for i, j in np.argwhere(np.triu(a)).tolist():
        forest.join(i, j)
    least = {}
    for i, d in enumerate(ids):
        least[forest.find(i)] = min(least.get(forest.find(i), d), d)
    return {d: (int(a[i].sum()), least[forest.find(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([centres, np.repeat(centres[:20], 5, 0) + 0.08 * rng.standard_normal((100, 24)), np.repeat(centres[:1], 60, 0) + 0.1 * rng.standard_normal((60, 24)), centres[:3], centres[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block, bucket_rows=60)
    want = vector_reference(x, range(len(x)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, []), (8, [1.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    t = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, v int, x int")
    got = defaultdict(list)
    for r in embeddings.near_duplicates(t).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(2, 1, True)] and got[2] == [(2, 1, False)] * 2
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8)) and got[None] == [(0, None, True)]
    assert embeddings.near_duplicates(t.limit(0)).count() == 0


def test_bucket_plan_covers_the_threshold():
    hashes, tables = embeddings.plan(10_000, 64, 0.9, 2, 1000, 1e-6)
    rng = np.random.default_rng(99)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    p, q = (embeddings.bucket_codes(v, tables, hashes, 2) for v in (a, 0.9 * a + np.sqrt(0.19) * b))
    assert (p[..., :, None] == q[..., None, :]).any((1, 2, 3)).mean() >= 0.999


def test_queries_have_contract_columns(spark, sf):
    want = {
        "op3_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
        "op6_embeddings": {"vec_id", "n_links", "component_id", "kept"},
        "op9_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    }
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, sf).columns)

"""Filter interactions, vector codes and quality rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import buffers, filter_audit, perplexity, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- buffers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t日", max_size=30)), max_size=8), st.booleans())
def test_runs_and_repeats_equal_python(texts, colliding):
    data, bounds = buffers.text_bytes(pa.array(texts, pa.string()))
    starts, ends, of = buffers.runs(~buffers.BLANK[data], bounds)
    words = [(i, w.encode()) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert [(int(i), data[a:b].tobytes()) for i, a, b in zip(of, starts, ends, strict=True)] == words
    number = buffers.repeats(data, starts, ends, of, np.zeros(len(starts), np.uint64) if colliding else None).tolist()
    named = [words[i] for i in number]
    assert named == words
    assert len(set(number)) == len(set(words))


def test_repeats_of_long_words_and_many_blocks(monkeypatch):
    monkeypatch.setattr(buffers, "BLOCK", 64)
    rng = random.Random(1)
    words = [rng.choice(["a", "bb", "x" * 50, "y" * 400, "y" * 399 + "z"]) for _ in range(300)]
    data, bounds = buffers.text_bytes(pa.array([" ".join(words), "  ".join(words[::-1])]))
    starts, ends, of = buffers.runs(~buffers.BLANK[data], bounds)
    number = buffers.repeats(data, starts, ends, of)
    spelled = [(int(t), data[a:b].tobytes()) for t, a, b in zip(of, starts, ends, strict=True)]
    assert [spelled[i] for i in number] == spelled and len(set(number.tolist())) == 10
    assert [hi - lo for lo, hi in buffers.groups(bounds, 10)] == [1, 1]


# ---- filter interactions


def audit_reference(rows, labels):
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = defaultdict(list)
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        docs[part or ""].append((i, {f for f in fails if fails[f]}))
    out, shapley = {}, Counter()
    for part, found in docs.items():
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in found if f in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in found), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(frame):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = frame.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in rows}


def audit_rows():
    rng = random.Random(5)
    pool = ["", None, "Short Text", "w " * 300, " ".join(f"w{i}" for i in range(250)), "ALL CAPS " * 120, "a # b", "é" * 99 + "AB", "é" * 100 + "AB"]
    pool += [" ".join(rng.choice(["x", "Y", "z%", f"u{k}"]) for _ in range(rng.randint(150, 260))) for k in range(8)]
    rows = [(rng.choice([*range(60), None]), rng.choice(pool), rng.choice(["a", "b", "", None])) for _ in range(160)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 0)]
    return rows, labels


def test_audit_equals_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "'x' as digest", "2 as n")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as text", "7 as part")
    assert audited(filter_audit.audit(docs.repartition(5), known)) == audit_reference(rows, labels)


def test_audit_of_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r["shard"]) for r in odd.collect()]
    assert audited(filter_audit.audit(odd, labels, part_col="shard")) == audit_reference(rows, [])
    assert audited(filter_audit.audit(none, labels, part_col="shard")) == {}


# ---- vector codes


def codes_reference(rows, entries=256, rounds=4, width=None):
    kept = []
    for i, v, label in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(1024 * c) for c in v], label))
    n = width or len(kept[0][1])
    kept = [k for k in kept if len(k[1]) == n]
    edges = [n * p // 4 for p in range(5)]
    order = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0))
    books = [[k[1][lo:hi] for k in order[:entries]] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            members = defaultdict(list)
            for _, x, _ in kept:
                members[nearest(x[lo:hi], books[p])[1]].append(x[lo:hi])
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for book in books for y in book for v in y).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, x, label in kept:
        found = [nearest(x[lo:hi], books[p]) for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def coded(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n=400, width=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    rows = [(1000 - i, [c + rng.gauss(0, 0.02) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(2000 + i, rows[7][1], 5) for i in range(150)]  # one vector that many rows share
    return rows + [(3, None, 1), (4, [None] * width, 1), (5, [math.nan] * width, 1), (6, [math.inf, *[0.0] * (width - 1)], 1), (7, [], 0), (8, [0.0] * width, 2), (9, [-0.0] * width, 2)]


@pytest.mark.parametrize(("width", "kind"), [(8, "double"), (7, "double"), (4, "double")])
def test_codes_equal_brute_force(spark, width, kind):
    rows = vectors(width=width)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'c' as code", "1 as rid", "2 as parts", "3 as pos")
    assert coded(vector_codes.compress(df.repartition(6), entries=32)) == codes_reference(rows, 32)


def test_codes_of_few_repeated_and_huge_vectors(spark):
    rows = [(1, [0.5, 1.0, 2.0, 3e5], 1), (2, [0.5, -1.0, 2.0, -3e9], 1), (3, [0.25, 1.0, 1e14, 0.0], None), (3, [0.25, 1.0, 1e14, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert coded(vector_codes.compress(df, entries=2)) == codes_reference(rows, 2)
    wide = spark.createDataFrame([(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1), (3, [0.0] * 4, 1), (4, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress(wide, entries=1, rounds=0).collect()
    assert {(r.vec_id, r.error) for r in got} == {(1, 0), (2, (1 << 63) - 1), (3, (1 << 63) - 1)} and all(r.label_error is None for r in got)
    assert vector_codes.compress(df.limit(0)).collect() == []


def test_nearest_takes_the_lowest_index_of_equals():
    book = np.array([[0, 0], [2, 0], [2, 0], [1 << 40, 0]])
    codes, errors = vector_codes.nearest(np.array([[1, 0], [2, 0], [1 << 40, 1], [-(1 << 61), 0]]), book)
    assert codes.tolist() == [0, 1, 3, 0] and errors == [1, 0, 1, 1 << 122]
    assert codes.tolist() == vector_codes.nearest(np.array([[1, 0], [2, 0], [1 << 40, 1], [-(1 << 61), 0]]), book)[0].tolist()


# ---- quality rules


def counts_reference(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aab  é\n#<", max_size=60)), max_size=6))
def test_rule_counts_equal_python(texts):
    data, bounds = buffers.text_bytes(pa.array(texts, pa.string()))
    found = perplexity.rule_counts(data, bounds, "#*$%&|<>")
    assert list(zip(*(found[c].tolist() for c in perplexity.COUNTS), strict=True)) == [counts_reference(t) for t in texts]


def kneser_ney(docs):
    """log-perplexity of each (lang, text) by dictionaries."""
    grams, holders = Counter(), defaultdict(set)
    for d, (lang, text) in enumerate(docs):
        t = perplexity.PAD * 4 + perplexity.normal(text)
        for e in range(4, len(t)):
            grams[lang, t[e - 4 : e + 1]] += 1
            holders[lang, t[e - 4 : e + 1]].add(d)
    level, docs_of = dict(grams), {g: len(h) for g, h in holders.items()}
    p, back = {}, {}
    for k in range(5, 0, -1):
        whole, kept, d = Counter(), defaultdict(list), {}
        for lang in {lang for lang, _ in level}:
            n = Counter(v for (x, _), v in level.items() if x == lang)
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
            for i in (1, 2, 3):
                v = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else -1
                d[lang, i] = v if 0 < v < i else i / 2
        for (lang, g), v in level.items():
            whole[lang, g[:-1]] += v
        for (lang, g), v in level.items():
            if k == 1 or docs_of[lang, g] > 1:
                p[lang, g] = (v - d[lang, min(v, 3)]) / whole[lang, g[:-1]]
                kept[lang, g[:-1]].append(p[lang, g])
        for c, ps in kept.items():
            back[c] = 1 - sum(ps)
        shorter, shorter_docs = Counter(), Counter()
        for lang, g in level:
            shorter[lang, g[1:]] += 1
            shorter_docs[lang, g[1:]] += docs_of[lang, g]
        if k == 1:
            sizes = Counter(lang for lang, _ in level)
        else:
            level, docs_of = dict(shorter), dict(shorter_docs)
    out = []
    for lang, text in docs:
        t, total = perplexity.PAD * 4 + perplexity.normal(text), 0.0
        for e in range(4, len(t)):
            value = 1 / (sizes[lang] + 1)
            for k in range(1, 6):
                g = t[e - k + 1 : e + 1]
                value = p.get((lang, g), 0.0) + back.get((lang, g[:-1]), 1.0) * value
            total += math.log(value)
        out.append(-total / (len(t) - 4) if len(t) > 4 else None)
    return out


def corpus():
    rng = random.Random(8)
    syllables = {"en": "the ing er on th re an".split(), "fr": "le eau oi é ch tion".split(), None: "x y zz".split()}
    rows = []
    for i in range(260):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 120))), lang))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(7)) for _ in range(90))
    odd = [(1000, noise, "en"), (1001, "the er " * 200, "en"), (1002, None, None), (1002, "", "en"), (None, "  \n ", "fr"), (1003, "Ü\x00\x01 7 日本", "ja")]
    return rows + odd + [(2000 + i, rows[1][1], rows[1][2]) for i in range(20)]


@pytest.mark.parametrize("most_entries", [perplexity.MODEL_ENTRIES, 10])
def test_perplexity_equals_dictionaries(spark, most_entries):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as gram", "3 as rid", "4 as kept")
    got = perplexity.judged(docs.repartition(3), most_entries=most_entries).collect()
    want = kneser_ney([(lang or "", text or "") for _, text, lang in rows])
    assert len(got) == len(rows)
    key = lambda i, n, v: (i is None, i or 0, n, -1 if v is None else v)
    got_ = sorted((key(r.doc_id, r.n_words, r.log_perplexity) for r in got))
    want_ = sorted(key(i, len(WORD.findall(t or "")), v) for (i, t, _), v in zip(rows, want, strict=True))
    assert [x[:3] for x in got_] == [x[:3] for x in want_]
    assert max(abs(x[3] - y[3]) for x, y in zip(got_, want_, strict=True)) < 2e-5
    of = {r.doc_id: r for r in got}
    for i, text, _ in rows[:262]:
        counts = counts_reference(text)
        assert tuple(of[i][c] for c in perplexity.COUNTS) == counts
        assert of[i].base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (of[i].kept and of[i].base_failed)
    assert not of[1000].base_failed and not of[1000].kept  # noise
    passed = [r for r in got if not r.base_failed and r.doc_id != 1000]
    assert len(passed) > 20 and all(r.kept for r in passed)


def test_rules_on_odd_and_empty_tables(spark, odd, none):
    got = perplexity.judged(odd.withColumnRenamed("shard", "lang")).collect()
    assert len(got) == odd.count()
    want = Counter((r.doc_id, *counts_reference(r.text)) for r in odd.collect())
    assert Counter((r.doc_id, *(r[c] for c in perplexity.COUNTS)) for r in got) == want
    assert perplexity.judged(none.withColumnRenamed("shard", "lang")).collect() == []


def test_fences_reject_few(spark):
    scores = [("en", 1.4 + 0.001 * (i % 50)) for i in range(400)] + [("en", 2.5), ("en", 0.3), ("en", None), ("de", 1.0)]
    found = {r.lang: r for r in perplexity.fences(spark.createDataFrame(scores, "lang string, log_perplexity double")).collect()}
    assert sum(v is not None and not found[lang].lowest <= v <= found[lang].highest for lang, v in scores) == 2

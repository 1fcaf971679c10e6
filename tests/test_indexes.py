"""Postings in blocks and vectors in lists against plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.sources import postings, vectorindex
from tests.shuffled import shuffled

# ---- postings


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(12)]
    rows = [(i, "ab"[i % 2], " ".join(rng.choice(topics[i % 12] if rng.random() < 0.7 else ["and", "the", "of", *topics[rng.randrange(12)]]) for _ in range(rng.randint(0, 60)))) for i in range(900)]
    return spark.createDataFrame(rows + [(1000, "a", ""), (1001, None, "t1w1 t1w2")], "id long, d string, t string").cache()


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(12)
    asked = [(q, " ".join(f"t{q % 12}w{rng.randrange(30)}" for _ in range(rng.randint(1, 5))) + rng.choice(["", " the", " AND of"])) for q in range(40)]
    return spark.createDataFrame(asked + [(90, "nothing alike"), (91, ""), (92, None), (93, "the the t0w0")], "question_id int, question string")


@pytest.mark.parametrize(("range_rows", "scope"), [(16, ""), (16, "a"), (100_000, "")])
def test_many_questions_equal_plain_bm25(spark, texts, questions, tmp_path, monkeypatch, range_rows, scope):
    monkeypatch.setattr(postings, "RANGE_ROWS", range_rows)
    folder = str(tmp_path / "p")
    postings.build(texts, "id", F.col("t"), folder, F.col("d"))
    rows = lambda df: sorted((r.question_id, r.id, round(r.raw, 6)) for r in df.collect())
    want = rows(search.bm25_each(texts.where(F.col("d") == scope) if scope else texts, questions, "id", F.col("t"), 5))
    assert len(want) > 100 and rows(postings.bm25_each(spark, folder, questions, "id", 5, scope)) == want
    report = postings.skipped(spark, folder, questions, 5, scope).agg(F.sum("pairs"), F.sum("scored")).first()
    assert report[1] <= report[0] and (range_rows > 900 or report[1] < 0.8 * report[0])


def test_asked_terms_may_be_joined(spark, texts, questions, tmp_path, monkeypatch):
    folder = str(tmp_path / "p")
    postings.build(texts, "id", F.col("t"), folder)
    rows = lambda: sorted((r.question_id, r.id, round(r.raw, 6)) for r in postings.bm25_each(spark, folder, questions, "id", 5).collect())
    sent = rows()
    monkeypatch.setattr(postings, "ASKED_ROWS", 1)
    assert rows() == sent


def test_postings_of_nothing(spark, texts, tmp_path):
    postings.build(texts.limit(0), "id", F.col("t"), str(tmp_path / "p"))
    assert postings.bm25(spark, str(tmp_path / "p"), "t1w1", "id", "long").collect() == []


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """3000 texts of 6 MB with 60 questions, their postings, and the bytes shuffled for these."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    rows = [(i, " ".join(words[min(3999, int(rng.expovariate(1 / 600)))] for _ in range(250))) for i in range(3000)]
    folder = str(tmp_path_factory.mktemp("postings") / "p")
    spark.createDataFrame(rows, "id long, t string").write.parquet(f"{folder}-texts")
    before = shuffled(spark)
    postings.build(spark.read.parquet(f"{folder}-texts"), "id", F.col("t"), folder)
    return folder, [(q, rows[q * 50][1][:320]) for q in range(60)], shuffled(spark) - before


def test_blocks_are_shuffled_once(many):
    assert many[2] < 5_500_000


def test_each_question_finds_its_text(spark, many):
    folder, questions, _ = many
    got = postings.bm25_each(spark, folder, spark.createDataFrame(questions, "question_id int, question string"), "id", 3).collect()
    assert len(got) == 180 and {r.question_id for r in got if r.id == r.question_id * 50} == set(range(60))


# ---- vectors


def vectors(n=1500, width=16, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(25)]
    rows = [(i, [c + rng.gauss(0, 0.25) for c in centres[i % 25]], "ab"[i % 2]) for i in range(n)]
    return rows + [(9000 + i, rows[3][1], "a") for i in range(40)] + [(9900, None, "a"), (9901, [0.0] * width, "a"), (9902, [math.nan] * width, "b"), (9903, [1.0], "b"), (9904, [None] * width, "b"), (9905, [], None)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors") / "v")
    df = spark.createDataFrame(vectors(), "vec_id long, v array<double>, d string")
    vectorindex.build(df, "vec_id", "v", folder, lists=30, scope_col="d")
    return vectorindex.VectorIndex(spark, folder)


def best(rows, q, n, scope=""):
    def cosine(v):
        if not v or len(v) != len(q) or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        return max(0.0, sum(a * b for a, b in zip(v, q, strict=True)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(a * a for a in q)))

    scored = [(-round(c, 9), i) for i, v, d in rows if (not scope or d == scope) and (c := cosine(v)) is not None]
    return [(i, round(-s, 6)) for s, i in sorted(scored)[:n]]


@pytest.mark.parametrize("scope", ["", "b"])
def test_lists_without_probes_are_exact(index, scope):
    rows = vectors()
    for at in (0, 3, 7, 1111):
        q = [x * 3 for x in rows[at][1]]
        assert [(r.vec_id, round(r.score, 6)) for r in index.nearest(q, "vec_id", 12, scope=scope).collect()] == best(rows, q, 12, scope)
    assert sum(len(index.plan(rows[at][1], 12)) for at in range(20)) < 0.7 * 20 * len(index.lists)


def opened(index, lists):
    return index._rows(lists, ["id"], "").select(F.input_file_name()).distinct().count()


def test_few_probes_find_nine_in_ten_and_read_few_files(index):
    rows, found, files = vectors(), 0, 0
    asked = [r[1] for r in rows[:1500:60]]
    for q in asked:
        got = index.nearest(q, "vec_id", 10, probes=3)
        found += len({r.vec_id for r in got.collect()} & {i for i, _ in best(rows, q, 10)})
        files += opened(index, index.plan(q, 10, 3))
    all_files = opened(index, index.lists)
    assert found >= 0.9 * 10 * len(asked)
    assert files <= 0.25 * all_files * len(asked)


def test_questions_that_find_nothing(index, spark, tmp_path):
    for q in ([0.0] * 16, [1.0], [], [math.nan] * 16):
        assert index.nearest(q, "vec_id").collect() == []
    empty = spark.createDataFrame([], "vec_id long, v array<double>")
    vectorindex.build(empty, "vec_id", "v", str(tmp_path / "v"))
    assert vectorindex.VectorIndex(spark, str(tmp_path / "v")).nearest([1.0], "vec_id").collect() == []

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1,234.5", 1234.5), (" 7 ", 7.0), ("", None), (None, None), ("abc", None), ("nan", None), ("inf", None), ("1d", None), ("-3e2", -300.0), ("1_000", None)],
)
def test_number(spark, raw, want):
    assert values(spark, [(raw,)], "c string", S.number(F.col("c"))) == [(want,)]


def test_period_order(spark):
    labels = ["Q1 2025", "2024", "Q4 2024", "2025", "2025 Q2", "H2 2024", "zz", "7"]
    got = spark.createDataFrame([(x,) for x in labels], "p string").orderBy(S.period_key(F.col("p"))).collect()
    assert [r.p for r in got] == ["2024", "H2 2024", "Q4 2024", "2025", "Q1 2025", "2025 Q2", "7", "zz"]


def test_formats(spark):
    c = F.col("x")
    got = values(spark, [(1234567.0,), (1500.0,), (2.5,)], "x double", S.money(c), S.plain(c), S.gloss(c))
    assert got == [("$1.23M", "1,234,567", "$1.2M"), ("$1.5K", "1,500", "$1.5K"), ("$2.50", "2.5", None)]


def test_mentions_quotes_and_plurals(spark):
    rows = [("two aces here", "ace", True), ("workspace", "ace", False), ("we like c++ a lot", "c++", True), ("boxes", "box", True)]
    got = values(spark, rows, "t string, k string, w boolean", S.mentions(F.col("t"), F.col("k")), F.col("w"))
    assert all(a == b for a, b in got)


def test_text_pieces(spark):
    c = F.col("c")
    rows = [("My Domain/Name",), ("One sentence. Another.",)]
    got = values(spark, rows, "c string", S.slug(c), S.first_sentence(c), S.answer_hash(c))
    assert got[0][0] == "my_domain_name"
    assert got[1][1] == "One sentence."
    assert len(got[0][2]) == 8


def test_confidential_reason(spark):
    rows = [("a/top_secret.txt", "x"), ("a/b.txt", "please do not share this"), ("a/b.txt", "nothing"), ("a/b.txt", None)]
    got = values(spark, rows, "p string, t string", S.confidential_reason(F.col("p"), F.col("t")))
    assert got == [("path: top secret",), ("body: do not share",), (None,), (None,)]


def loop_chunks(text, size, overlap):
    overlap, out, at = min(overlap, size // 2), [], 0
    if not text:
        return []
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abc ", max_size=60), st.integers(2, 20), st.integers(0, 15))
def test_chunks_equal_a_loop(spark, text, size, overlap):
    got = spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), size, overlap)).first()[0]
    assert got == loop_chunks(text, size, overlap)


def test_tokens(spark):
    c = F.col("c")
    got = values(spark, [("The boss's glasses and 42 Cats",)], "c string", T.search_tokens(c), T.topic_tokens(c), F.transform(T.gate_tokens(c), T.stem))
    assert got[0][0] == ["the", "boss", "s", "glasses", "and", "42", "cats"]
    assert got[0][1] == ["boss", "glasse", "42", "cat"]
    assert got[0][2] == ["the", "bos", "glass", "and", "cat"]


def test_cosine(spark):
    got = values(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>", F.round(S.cosine(F.col("a"), F.col("b")), 6))
    assert got == [(0.707107,), (None,), (None,)]


def test_sentences_keep_their_digits_and_lose_wide_spaces(spark):
    long = "words of a sentence that is long enough"
    text = "\u3000" + " ".join(f"{i} {long} {i}." for i in range(12)) + f"\u00a0{long}\x01{long}!\x0b{long}?\n \u2003{long}\u00a0"
    got = values(spark, [(text,)], "c string", T.sentences(F.col("c")))[0][0]
    assert got == [*(f"{i} {long} {i}." for i in range(11)), f"11 {long} 11.\u00a0{long}", f"{long}!\x0b{long}?", long]

import html as references
import re
import time
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import html, pii, quality, sharding, url_lists
from millrace.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return [int(c) for c in t if c.isdigit() and c.isascii()]


def luhn(ds):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(ds))) % 10 == 0


def base_reference(t):
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text("ab.@-+ 129()é", max_size=60))
def test_plain_spans(text):
    assert pii.plain_spans(text) == base_reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text("oneatdtwo [](). 4@xＡ​а", max_size=60))
def test_base_spans_stay(text):
    base, every = pii.find(text)
    assert all(set(base[k]) <= set(every[k]) and all(0 <= s < e <= len(text) for s, e in every[k]) for k in pii.KINDS)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail jane (dot) doe [at] example dot com now", "email:5:40"),
        ("call plus one two three four five six seven eight nine", "phone:5:54"),
        ("card four one one one one one one one one one one one one one one one", "card:5:69"),
        ("one nine two dot one six eight dot zero dot one", "ip:0:47"),
        ("jo​hn@exa​mple.com", "email:0:18"),
        ("１９２.１６８.1.1", "ip:0:11"),
        ("аdmin@example.com", "email:0:17,email:1:17"),
        ("we looked at the dot in time, one or two of them at seven", ""),
        ("4111 1111 1111 1112", ""),
        ("", ""),
    ],
)
def test_disguises(text, spans):
    assert pii.listing(pii.find(text)[1]) == spans


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("call plus 1 415 555 2671", "phone:5:24"),
        ("+49 30 one two 34567", "phone:0:20"),
        ("+1 (four) 155 552 671", "phone:0:21"),
        ("four 111 1111 1111 1111", "card:0:23"),
        ("4111 1111 1111 111 one", "card:0:22"),
        ("192.168.one.one", "ip:0:15"),
        ("bob [ at ] example.com", "email:0:22"),
        ("bob (\t at)example.com", "email:0:21"),
        ("bob@one two.com", "email:0:15"),
        ("\u017fix dot f\u0131ve", ""),
    ],
)
def test_disguises_that_stand_alone(text, spans):
    assert pii.listing(pii.find(text)[1]) == spans


_PIECES = ["one", "Four", "OH", "seven", "plus", "at", "dot", "com", "bob", "x", "1", "49", "255", "4111 1111 1111 111", "555 2671", "+", "@", ".", "-", " ", " ", "  ", "\t", "(", ")", "[", "]", "<", ">", "\u017f", "\u200b", "\u0430"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=14).map("".join))
def test_gate_lets_every_disguise_through(text):
    gated = pii.find(text)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii, "disguised", lambda _: True)
        assert pii.find(text) == gated


def test_redaction():
    text = "a@b.co, +1 (988) 555-2485 and 1.2.3.4."
    assert pii.redact(text, pii.find(text)[1]) == "[EMAIL], [PHONE] and [IP]."


def test_pii_table(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op8_pii"](spark, sf).collect():
        base = base_reference(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k in base for s, e in base[k])
        assert r.base_sha256 == sha256(listed.encode()).hexdigest() and r.spans == listed
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in base)
    assert pii.detect(odd).count() == odd.count() and pii.detect(none).count() == 0
    scrubbed = pii.scrub(odd.withColumn("n_chars", F.lit(-1).cast("long")))
    assert scrubbed.where("text is null and n_chars = -1").count() == 1 and scrubbed.where("n_chars != length(text)").count() == 0


# ---- quality


def test_quality_on_held_out_rows(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].score, q, got[i].predicted) for i, q in labels.items() if got[i].held_out]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(p == q for _, q, p in held) / len(held) >= 0.85
    assert all(p == 1 for _, q, p in held if q)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    again = quality.fit(odd.repartition(3), labels)
    assert (model.slots == again.slots).all() and (model.weights == again.weights).all()
    scores = {r.doc_id: r.score for r in quality.score(odd, model, keep=("shard",)).collect()}
    assert len(scores) == len({r.doc_id for r in odd.collect()}) and scores[3] == scores[4]
    kept = quality.accepted(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.score(none, model).count() == 0
    empty = quality.fit(none, labels)
    assert len(empty.slots) == 0 and {r.score for r in quality.score(odd, empty).collect()} == {0.5}


# ---- shards


def test_shards(spark, sf, odd, none):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(QUERIES["op4_sharding"](spark, sf).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in rows] == sorted(docs)
    assert all(r.size == len((docs[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in rows)
    total, most, sums, slots = sum(r.size for r in rows), max(r.size for r in rows), {}, {}
    for r in rows:
        assert r.slot == slots.get(r.shard, 0) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard] = r.slot + 1
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert all(abs(s - total / 16) <= most for s in sums.values())
    some = sharding.byte_shards(odd, 4, parts=3).collect()
    assert len(some) == odd.count() and sorted(r.slot for r in some if r.shard == max(x.shard for x in some))[0] == 0
    assert sharding.byte_shards(none).count() == 0
    assert {r.shard for r in sharding.byte_shards(odd.limit(1), 16).collect()} <= set(range(16))


# ---- pages


def test_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op10_html"](spark, sf).collect():
        parts = pages[r.page_id].split("<article>")
        body = parts[1].split("</article>")[0] if len(parts) > 1 else ""
        want = " ".join(references.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<nav><a>Home</a></nav><p>One &amp; two</p><footer>x</footer>", "One & two"),
        ("<article><h1>T</h1><p>a <b>b</b>c<br>d</p><script>var x='<p>';</script><!-- c --><p>e", "T a bc d e"),
        ("<div class='cookie-notice'>Accept all of our cookies</div><main><p>Real text is here</p></main><div id=comments><p>nice one</p></div>", "Real text is here"),
        ('<p title="a>b">x &lt; y</p>', "x < y"),
        ("<nav>menu never closed<article><p>the article stays whole</p></article>", "the article stays whole"),
        ("<style>p{}</style><form><label>Name</label></form>", ""),
        ("a < b and <b", "a < b and"),
    ],
)
def test_page_cases(page, text):
    assert html.main_text(page) == text


def test_page_table(spark):
    t = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>hi there</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(t).collect()) == [(0, "hi there", 8), (1, "", 0), (1, "", 0)]
    assert html.extract(t.limit(0)).count() == 0


def test_labelled_pages_give_back_their_content():
    for page in html.LABELLED:
        got = html.main_text(page).split()
        main = re.sub(r"</?(?:b|i|em|strong|span|code|u|small|a)>", "", page[page.index("data-main") :])
        assert len(got) > 20 and all(w in main for w in got)


# ---- lists


def test_intervals_and_matches(spark):
    entries = spark.createDataFrame(
        [("l", "bad.com", "add", "2024-01-10"), ("l", "bad.com", "remove", "2024-02-01"), ("l", "bad.com", "add", "2024-03-01"), ("l", "bad.com", "add", "2024-03-01"),
         ("m", "x.org/a", "add", "2024-01-01"), ("m", "gone.org", "remove", "2024-01-01"), ("m", "same.org", "add", "2024-01-05"), ("m", "same.org", "remove", "2024-01-05"), (None, "y.org", "add", "2024-01-01")],
        "list string, key string, action string, at string",
    ).withColumn("at", F.to_date("at"))
    assert sorted((r.key, str(r.since), str(r.until)) for r in url_lists.intervals(entries).collect()) == [
        ("bad.com", "2024-01-10", "2024-02-01"), ("bad.com", "2024-03-01", "None"), ("x.org/a", "2024-01-01", "None")]
    captures = spark.createDataFrame(
        [(1, "http://www.bad.com/p", "2024-01-10"), (2, "http://bad.com", "2024-02-01"), (3, "https://u@BAD.com:80/x?y", "2024-05-01"), (4, "http://notbad.com", "2024-05-01"), (5, "http://x.org/a/b", "2024-05-01"),
         (6, "http://x.org/ab", "2024-05-01"), (7, None, "2024-05-01"), (8, "http://bad.com", None), (9, "no url", "2024-05-01"), (1, "http://www.bad.com/p", "2024-01-10"), (10, "http://same.org", "2024-01-06")],
        "page_id int, url string, at string",
    ).select("page_id", "url", F.to_date("at").alias("fetched_at"), F.lit(1).alias("lists"))
    got = url_lists.active_lists(captures, entries)
    assert sorted((r.page_id, r.blocked, r.lists) for r in got.collect()) == [
        (1, True, "l"), (1, True, "l"), (2, False, ""), (3, True, "l"), (4, False, ""), (5, True, "m"), (6, False, ""), (7, False, ""), (8, False, ""), (9, False, ""), (10, False, "")]
    assert url_lists.active_lists(captures.limit(0), entries).count() == 0
    assert url_lists.active_lists(captures, entries.limit(0)).where("blocked").count() == 0


def test_entries_of_any_number_of_folders(spark):
    day = "cast('2024-01-01' as date)"
    urls = ["http://a.example.com/x/y/z/w/page", "http://a.example.com/x/y/z", "http://a.example.com/x/y/other/w", "http://b.example.com/1/2/3/4/5/6"]
    captures = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", f"{day} as fetched_at")
    keys = [("deep", "a.example.com/x/y/z/w"), ("three", "example.com/x/y/z"), ("page", "b.example.com/1/2/3/4/5/6")]
    entries = spark.createDataFrame(keys, "list string, key string").selectExpr("list", "key", "'add' as action", f"{day} as at")
    got = {r.url: r.lists for r in url_lists.active_lists(captures, entries).collect()}
    assert got == {urls[0]: "deep,three", urls[1]: "three", urls[2]: "", urls[3]: "page"}


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("john at example.com", "email:0:19"),
        ("john -at- example -dot- com", "email:0:27"),
        ("j.d - at - example - dot - com", "email:0:30"),
        ("john @ example . com", "email:0:20"),
        ("mail john.smith at mail.example.org now", "email:5:35"),
        ("see us at example.com or john at example.com", "email:25:44"),
        ("meet at noon dot we go", ""),
        ("look at this dot com boom", ""),
        ("read more at example.com", ""),
        ("we met at the office . Com was new", ""),
        ("5 @ 3", ""),
    ],
)
def test_marks_set_apart_and_prose(text, spans):
    assert pii.listing(pii.find(text)[1]) == spans


def test_marks_set_apart_take_linear_time():
    for text in ("a at b.c " * 100_000, "a @ " * 200_000, "a - at - " * 100_000, "a . com " * 100_000, "a at " + "b." * 300_000 + " x", " -" * 400_000):
        start = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - start < 3, text[:12]

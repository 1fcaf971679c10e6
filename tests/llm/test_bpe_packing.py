import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
ENCODER = packing.Encoder(open(PATH, encoding="utf-8").read(), longest=50)


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    (raw,) = CODEC.encode_batch([text])
    assert np.frombuffer(raw, "<u4").tolist() == want(text)
    assert CODEC.decode(np.frombuffer(raw, "<u4")).decode() == text
    assert ENCODER.encode(text) == raw


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeithn .'\n0!|", max_size=120))
def test_dense_text_encodes_as_the_library(text):
    assert [np.frombuffer(r, "<u4").tolist() for r in CODEC.encode_batch([text, text])] == [want(text)] * 2
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want(text)


def test_merge_equals_verified_proposal():
    words = [b" thereof", b"aaaaaaaaaaa", b" indivisible", "naïveté".encode(), b"\xff\xfe"]
    assert CODEC.encode_words(words) == [CODEC.merge(w) for w in words]


def test_small_cache_forgets_safely():
    codec = bpe.Codec(open(PATH, encoding="utf-8").read(), cache_words=3)
    texts = [f"word{i} and word{i % 3} again" for i in range(50)]
    assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode_batch(texts, chunk_chars=40)] == [want(t) for t in texts]


def test_round_trip_table(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = bpe.round_trip_digest(odd, PATH).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = want(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip_digest(none, PATH).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(repr, ((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())))


def checked(rows, texts, window):
    """Every id of every row in one piece, windows gapless, checksums right; returns the lengths of the windows."""
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for i, text in texts.items():
        ids, at = np.array(want(text) + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return [sum(n for _, n in p) for p in windows.values()]


@pytest.mark.parametrize(("window", "open_windows", "gap"), [(2048, 64, 32), (64, 4, 4), (16, 1, 0)])
def test_packing(spark, sf, window, open_windows, gap):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sizes = checked(packing.pack(docs, PATH, window, open_windows, gap).collect(), texts, window)
    assert sum(window - s for s in sizes) <= 0.08 * window * len(sizes)


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd.dropDuplicates(["doc_id"]), PATH).collect()
    checked(rows, {r.doc_id: r.text for r in odd.collect()}, 2048)
    total = sum(r.length for r in packing.pack(odd, PATH).collect())
    assert total == sum(len(want(r.text)) + 1 for r in odd.collect())
    assert packing.pack(none, PATH).count() == 0

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
from test_dedup import SPACE, near_reference
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import pii, quality
from millrace.llm.queries import ORACLES, QUERIES, held_out


def test_oracles(spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        places = [want.columns.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall()), name


def test_pipeline_equals_plain_steps(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    weights = model.dense()

    def good(t):
        at, x = quality.features(t, model.bits)
        return quality.logistic(weights[at] @ x) >= 0.3

    docs = [d for d in docs if good(d["text"])]
    owner = {}
    for d in sorted(docs, key=lambda d: (-len(d["text"]), d["doc_id"])):
        owner.setdefault(d["text"].translate(SPACE), d["doc_id"])
    docs = [d for d in docs if owner[d["text"].translate(SPACE)] == d["doc_id"]]
    near = near_reference([d["doc_id"] for d in docs], [d["text"] for d in docs], 5)
    docs = [d for d in docs if near[d["doc_id"]][1] == d["doc_id"]]
    texts = {d["doc_id"]: pii.redact(d["text"], pii.find(d["text"])[1]) for d in docs}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) and {r.doc_id for r in rows} == set(ids)
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert not any(pii.find(t)[1][k] for t in texts.values() for k in pii.KINDS)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_stages_on_empty_and_odd_documents(spark, sf, odd, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    strange = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "shard as source", "cast(length(text) as long) as n_chars")
    for k, rows in enumerate((docs.limit(0), strange)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}-{name}")
            assert (rows.count() == 0) == (k == 0), name


def test_a_second_run_leaves_the_first_result(spark, sf):
    first = corpus_pipeline.run(spark, sf)
    n = first.count()
    second = corpus_pipeline.run(spark, sf)
    assert n == first.count() == second.count() > 0
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, first.collect())) == sorted(map(key, second.collect()))

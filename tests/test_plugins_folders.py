import io
import zipfile

from pyspark.sql import functions as F

from millrace.operators import folders, gates
from millrace.plans import plugins, render


def test_rerank_and_classify(spark):
    hits = spark.createDataFrame([(1, 0.9, "a"), (2, 0.5, "bbb"), (3, 0.1, "cc")], "id long, score double, text string")
    assert [r.id for r in plugins.rerank(hits, "q", "id", "text", 2).collect()] == [1, 2]
    plugins.register("reranker", "length")(lambda q, texts: [len(t) for t in texts])
    plugins.register("classifier", "fixed")(lambda q, h, d: '{"domains": ["hr", "unknown"]}')
    try:
        assert [r.id for r in plugins.rerank(hits, "q", "id", "text", 2).collect()] == [2, 3]
        assert plugins.classify("q", [], ["hr", "it"], ["it"]) == ["hr"]
        plugins.register("classifier", "fixed")(lambda q, h, d: "no json")
        assert plugins.classify("q", [], ["hr", "it"], ["it"]) == ["it"]
    finally:
        plugins.unregister("reranker", "length")
        plugins.unregister("classifier", "fixed")
    assert plugins.classify("q", [], ["hr"], ["hr"]) == ["hr"]


def test_cache():
    now, calls = [0.0], []
    cache = plugins.Cache(2, 10, lambda: now[0])
    make = lambda k: lambda: calls.append(k) or k
    assert [cache.get("a", make("a")), cache.get("a", make("a")), cache.get("b", make("b")), cache.get("c", make("c")), cache.get("a", make("a"))] == ["a", "a", "b", "c", "a"]
    assert calls == ["a", "b", "c", "a"]
    cache.get("a", make("a"), stamp=1)
    now[0] = 11
    cache.get("a", make("a"), stamp=1)
    assert calls == ["a", "b", "c", "a", "a", "a"]


def test_tree_rename_paths(spark):
    f = spark.createDataFrame([("x/a.md",), ("x/y/b.md",), ("x/y/c.md",), ("d.md",)], "path string")
    assert {tuple(r) for r in folders.tree(f).collect()} == {("", 1, 3), ("x", 1, 2), ("x/y", 2, 0)}
    assert {r.path for r in folders.rename(f, "x/y", "z").collect()} == {"x/a.md", "z/b.md", "z/c.md", "d.md"}
    assert [r[0] for r in f.limit(1).select(folders.digest_path(F.lit("My Domain/sub/a.xlsx"))).collect()] == ["my_domain/sub/a.xlsx.md"]


def test_collapse_and_reuse(spark):
    f = spark.createDataFrame([("p1", "deal Q325.xlsx", "1"), ("p2", "deal q425.xlsx", "2"), ("p3", "notes.md", "3")], "path string, name string, hash string")
    assert {tuple(r) for r in folders.collapse(f, [("(?i)^deal", "Deals")]).collect()} == {("Deals", 2, "Q325,Q425"), ("notes.md", 1, "")}
    cache = spark.createDataFrame([("p1", "1", "kept"), ("p2", "old", "stale")], "path string, hash string, summary string")
    assert {(r.path, r.summary, r.fresh) for r in folders.reused(f, cache, F.col("name")).collect()} == {("p1", "kept", False), ("p2", "deal q425.xlsx", True), ("p3", "notes.md", True)}


def test_metadata_reasons(spark):
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w") as z:
        z.writestr("docProps/core.xml", "<cp:keywords>Internal Use Only</cp:keywords>")
    rows = [("a.eml", "eml", b"Sensitivity: Company-Confidential\n\nx"), ("b.eml", "eml", b"Subject: x\n\ny"), ("c.docx", "docx", office.getvalue()), ("d.docx", "docx", b"broken"), ("e.pdf", "pdf", b"%PDF /Keywords (Top Secret)"), ("f.txt", "txt", b"confidential")]
    got = {r.path: r.reason for r in gates.metadata_reasons(spark.createDataFrame([(p, e, bytearray(c)) for p, e, c in rows], "path string, ext string, content binary")).collect()}
    assert got == {"a.eml": "mail: confidential", "c.docx": "properties: internal use only", "e.pdf": "properties: top secret"}


def test_stub():
    assert "2 md, 1 txt" in render.readme_stub("hr", "", {"txt": 1, "md": 2})

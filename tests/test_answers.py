"""Answers, the assistant, the context store, stored postings and readers."""

import zlib

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import scalars as S
from millrace.operators import routing, search
from millrace.plans import assistant, contextstore, plugins
from millrace.plans.api import Engine
from millrace.plans.knowledge import KnowledgeBase
from millrace.sources import config, documents, postings, tables


def csv(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


# ---- tables


def test_entity_restricts_without_a_time_column(spark, tmp_path):
    f = csv(tmp_path / "t.csv", ["region,revenue", "EU,1", "US,10"])
    out = Engine(spark).query_data(f, "total revenue", {"entity": ("region", "EU")})
    assert out["rows"][0]["total"] == 1.0 and "$1.00" in out["answer"]


def test_entity_restricts_attrition_and_growth(spark, tmp_path):
    rows = [f"C{i},{r},{y},{10 + i * (y - 2022)}" for i in range(6) for r in (("EU", "US")[i % 2],) for y in (2023, 2024) if not (y == 2024 and i in (0, 1))]
    f = csv(tmp_path / "t.csv", ["customer,region,year,revenue", *rows])
    engine = Engine(spark)
    out = engine.query_data(f, "which customers churned", {"entity": ("region", "EU"), "group": "customer"})
    assert out["total"] == 1 and out["rows"][0]["entity"] == "C0"
    grown = engine.query_data(f, "which customer is growing fastest", {"entity": ("region", "EU"), "group": "customer"})
    assert {r["key"] for r in grown["rows"]} == {"C0", "C2", "C4"}


def test_lost_customers_are_counted_beyond_what_is_shown(spark, tmp_path):
    f = csv(tmp_path / "t.csv", ["customer,year,revenue", *(f"C{i:03d},2023,{i}" for i in range(123)), "C000,2024,1", "C001,2024,1", "C002,2024,1"])
    out = Engine(spark).query_data(f, "which customers churned")
    assert out["answer"].startswith("120 ") and len(out["rows"]) == 50 and out["truncated"] and out["total"] == 120


def test_a_period_named_on_the_command_line_counts(spark, tmp_path, capsys):
    f = csv(tmp_path / "t.csv", ["year,revenue", "2023,100", "2024,7"])
    assert cli.main(["query", f, "total", "revenue", "in", "2024"]) == 0
    assert "$7.00" in capsys.readouterr().out
    assert cli.main(["query", f, "total", "revenue"]) == 0
    assert "$107.00" in capsys.readouterr().out


def test_missing_files_are_errors_in_the_result(spark, tmp_path):
    engine = Engine(spark)
    assert engine.query_data(str(tmp_path / "none.csv"), "total")["status"] == "error"
    assert engine.compare_data(str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))["status"] == "error"


def test_comparison_asks_back_and_goes_on(spark, tmp_path):
    a = csv(tmp_path / "a.csv", ["year,revenue,cost", "2023,1,5", "2024,2,6"])
    b = csv(tmp_path / "b.csv", ["year,revenue,cost", "2024,3,7", "2025,4,8"])
    engine = Engine(spark)
    asked = engine.compare_data(a, b)
    assert asked["status"] == "clarifying"
    out = engine.refine_query(asked["session"], "cost")
    assert out["status"] == "answered" and {r["period"]: r["delta"] for r in out["rows"]} == {"2023": -5.0, "2024": 1.0, "2025": 8.0}


def test_charts_have_every_point(spark, tmp_path):
    f = csv(tmp_path / "t.csv", ["year,revenue", *(f"{1950 + i},{i}" for i in range(60))])
    out = Engine(spark).query_data(f, "trend of revenue over time", {"time": "year", "metric": "revenue"})
    assert len(out["chart"]["labels"]) == out["total"] == 60 and not out["truncated"]


def test_json_columns_keep_their_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"zeta": 1, "alpha": 2}\n{"mid": 3, "alpha": 4}\n')
    (tmp_path / "b.json").write_text('[{"zeta": 1, "beta": {"x": 1}},\n {"alpha": 2}]')
    (tmp_path / "c.json").write_text('{"z": 1,\n "a": 2}')
    assert tables.load(spark, str(tmp_path / "a.jsonl")).columns == ["zeta", "alpha", "mid"]
    assert tables.load(spark, str(tmp_path / "b.json")).columns == ["zeta", "beta", "alpha"]
    assert tables.load(spark, str(tmp_path / "c.json")).columns == ["z", "a"]


# ---- documents


def test_confidential_words_anywhere_in_a_text(spark):
    t = spark.createDataFrame([("a.txt", "word " * 20_000 + "strictly confidential")], "p string, t string")
    assert t.select(S.confidential_reason(F.col("p"), F.col("t"))).first()[0] == "body: confidential"
    assert t.select(S.confidential_reason(F.col("p"), F.col("t"), 4000)).first()[0] is None


def test_long_documents_are_chunked_whole(spark):
    d = spark.createDataFrame([(1, "n", "word " * 100_000)], "doc_id long, name string, text string")
    assert search.chunk(d).count() > 100 and search.chunk(d, cap=10).count() == 10


def pdf(*streams, deflate=True):
    out = b"%PDF-1.4\n"
    for s in streams:
        data = zlib.compress(s) if deflate else s
        out += b"1 0 obj\n<</Length " + str(len(data)).encode() + (b" /Filter /FlateDecode" if deflate else b"") + b">>\nstream\n" + data + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_text(deflate):
    pages = pdf(rb"BT /F1 12 Tf (Annual report) Tj 0 -14 Td (Costs \(net\) fell) Tj ET", b"BT [(Se) -20 (cond) -300 (page)] TJ T* <48692e> Tj ET", b"q 1 0 0 1 0 0 cm /Im1 Do Q", deflate=deflate)
    assert list(documents.pdf(pages)) == [("para", "Annual report\nCosts (net) fell", 0, "Page 1"), ("para", "Second page\nHi.", 0, "Page 2")]
    assert list(documents.pdf(b"no pdf")) == list(documents.pdf(pages + b"/Encrypt")) == []


def test_markdown_blocks():
    text = "---\na: b\n---\n# One ##\nline a\nline b\n\n```python\n# no heading\n```\n## Two\n~~~\nx\n~~~\nlast\n```\nnever closed"
    assert list(documents.markdown(text.encode())) == [("heading", "One", 1, ""), ("para", "line a line b", 0, ""), ("heading", "Two", 2, ""), ("para", "last", 0, "")]


# ---- retrieval


def test_stored_postings_equal_plain_bm25(spark, tmp_path):
    rows = [(i, ("a", "b")[i % 2], f"{'rare harbour' if i % 7 == 0 else 'plain words'} number n{i} and words") for i in range(60)] + [(99, "a", "")]
    t = spark.createDataFrame(rows, "id long, d string, t string")
    postings.build(t, "id", F.col("t"), str(tmp_path / "p"), F.col("d"))
    for scope, part in (("", t), ("a", t.where("d = 'a'"))):
        for q in ("rare harbour words", "plain", "nothing at all like it", ""):
            got = [(r.id, round(r.score, 9)) for r in postings.bm25(spark, str(tmp_path / "p"), q, "id", "long", 8, scope).collect()]
            assert got == [(r.id, round(r.score, 9)) for r in search.bm25_texts(part, q, "id", F.col("t"), 8).collect()], (scope, q)
    plan = postings.bm25(spark, str(tmp_path / "p"), "harbour", "id", "long")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [harbour])" in plan or "EqualTo(term,harbour)" in plan


def test_keywords_meet_questions_by_words(spark):
    q = spark.createDataFrame([(1, "Which customers left the Northern Region?"), (2, "holiday-pay and R&D boxes"), (3, "für über uns 日本"), (4, None)], "question_id int, question string")
    k = spark.createDataFrame([("s", "customer"), ("s", "northern region"), ("h", "holiday pay"), ("h", "box"), ("r", "r&d"), ("w", "über uns"), ("j", "日本"), ("x", "region of")], "domain string, keyword string")
    want = q.join(k, S.mentions(F.col("question"), F.col("keyword"))).groupBy("question_id", "domain").agg(F.count_distinct("keyword").alias("hits"))
    assert sorted(routing.keyword_hits(q, k).collect()) == sorted(want.collect())


# ---- the assistant


@pytest.fixture
def kb(spark, tmp_path):
    root = tmp_path / "kb"
    about = "The sales domain holds plans and price lists of all regions. " * 5
    for path, text in {
        "sales/README.md": f"# Sales\n\n{about}\n\n{assistant.INDEX_START}\n- plan.md\n{assistant.INDEX_END}\n\nLonger notes that only complex questions need.",
        "sales/plan.md": "# Sales plan\n\nRevenue of the northern region grows with every new customer we win this year.",
        "sales/deals.csv": "customer,year,revenue\nAcme,2023,100\nBeta,2024,7\n",
        "hr/leave.md": "# Leave\n\nEvery employee has thirty days of holiday, requested in the holiday calendar.",
        "hr/pay.txt": "CONFIDENTIAL salary bands and holiday pay of all employees.",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    rules = {"sales": config.Domain("sales", ("revenue", "customer", "sales"), "Plans", data_patterns=("how much",)), "hr": config.Domain("hr", ("holiday", "salary", "employee"))}
    kb = KnowledgeBase(spark, config.Settings(root=str(root), store=str(tmp_path / "store")), rules)
    kb.reindex(1.0)
    return kb


def test_ask_passes_context_through_remembers_and_logs(kb):
    a = assistant.Assistant(kb)
    out = a.ask("holiday and salary of an employee", "s1", 1e9)
    assert out["domains"] == ["hr"] and [s["path"] for s in out["sources"]] == ["hr/leave.md"] and out["withheld"] == 1
    assert out["text"].startswith("# hr") and "thirty days" in out["text"] and "CONFIDENTIAL" not in out["text"]
    assert [m["role"] for m in kb.store.history("s1", 1e9 + 1)] == ["user", "assistant"]
    assert kb.store.read_audit("s1").first().files_cited == ["hr/leave.md"]
    both = a.ask("holiday and salary of an employee", "s1", 1e9 + 5, acknowledged=True)
    assert {s["path"] for s in both["sources"]} == {"hr/leave.md", "hr/pay.txt"} and both["withheld"] == 0
    assert {d["domain"]: d["n_files"] for d in a.list_domains()} == {"hr": 2, "sales": 2}


def test_tiers_of_one_domain(kb):
    a = assistant.Assistant(kb)
    readme = a.domain_answer("sales", "tell me about sales", [], 3)
    assert readme.tier == "readme" and "- plan.md" in readme.text and "Longer notes" not in readme.text
    figure = a.domain_answer("sales", "how much total revenue in 2024", [], 3)
    assert figure.tier == "analyst" and "$7.00" in figure.text and figure.sources[0]["path"] == "sales/deals.csv"
    assert a.domain_answer("hr", "holiday calendar", [], 3).tier == "files"


def test_writers_answers_are_merged_and_failures_do_not_spread(kb, monkeypatch):
    a = assistant.Assistant(kb)
    plugins.register("writer", "test")(lambda prompt, context: "The total budget is 500." if "thirty" in context else "The total budget is 700.")
    monkeypatch.setattr(kb, "route", lambda q: ["hr", "sales", "gone"])
    fine = a.domain_answer
    monkeypatch.setattr(a, "domain_answer", lambda name, *r: (_ for _ in ()).throw(ValueError("no such domain")) if name == "gone" else fine(name, *r))
    try:
        out = a.ask("holiday of employees", "s2", 2e9)
    finally:
        plugins.unregister("writer", "test")
    assert "## hr" in out["text"] and "## sales" in out["text"] and "total budget: 500 or 700" in out["text"]
    assert "gone: no such domain" in out["warnings"]


def test_passed_blocks_are_unwrapped():
    assert assistant.unwrap(assistant.wrap("q?", "## x\n\ntext", "hr") + "\nrest") == "# hr\n\n## x\n\ntext\nrest"


# ---- the context store


def test_digests_are_built_reused_and_removed(kb):
    store = contextstore.ContextStore(kb)
    assert store.sync() == {"built": 4, "reused": 0, "removed": 0}
    assert store.sync() == {"built": 0, "reused": 4, "removed": 0}
    kb.update_document("hr/leave.md", "# Leave\n\nNow there are forty days of holiday for everyone here.")
    kb.update_document("hr/broken.docx", "not a zip file")
    files = kb.spark._jvm.org.apache.hadoop.fs.Path(f"{kb.settings.root}/hr/pay.txt")
    files.getFileSystem(kb.spark._jsc.hadoopConfiguration()).delete(files, False)
    assert store.sync() == {"built": 2, "reused": 2, "removed": 1}
    got = {r.path: r for r in store.digests().collect()}
    assert set(got) == {"hr/leave.md", "hr/broken.docx", "sales/plan.md", "sales/deals.csv"}
    assert "forty days" in got["hr/leave.md"].text and got["hr/broken.docx"].extraction == "empty" and "acme" in got["sales/deals.csv"].keywords
    assert "2 files" in store.read("index/hr.md") and "- sales: 2 files" in store.read("MANIFEST.md")
    assert "forty days" in store.context("hr", "how many days of holiday")
    with pytest.raises(ValueError):
        store.read("../x")


def test_compact_digests():
    page = "---\na: b\n---\n# t\n\n## Columns\n\n- x\n\n## By region\n\n- EU: 1\n\n## By product\n\n- boat: 2\n"
    assert contextstore.compact(page, "boat sales by product", 1000) == "# t\n\n## By product\n\n- boat: 2\n## By region\n\n- EU: 1"
    assert contextstore.compact(page, "x", 10).endswith("_cut_")


# ---- which table


def test_the_table_that_holds_the_entity_answers(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "sales").mkdir(parents=True)
    for i in range(10):
        client = "Zephyr Works" if i == 6 else f"Client{i}"
        (root / f"sales/list{i}.csv").write_text(f"customer,year,revenue\n{client},2024,{100 + i}\nOther{i},2024,1\n")
    kb = KnowledgeBase(spark, config.Settings(root=str(root), store=str(tmp_path / "store")), {"sales": config.Domain("sales", ("revenue",))})
    kb.reindex(1.0)
    assert kb.values.route("total revenue of Zephyr Works in 2024")[0] == "sales/list6.csv"
    found = assistant.Assistant(kb).domain_answer("sales", "total revenue of Zephyr Works in 2024", [], 3)
    assert found.tier == "analyst" and found.sources[0]["path"] == "sales/list6.csv"
    (root / "sales/list6.csv").write_text("customer,year,revenue\nNobody,2024,3\n")
    (root / "sales/list2.csv").write_text("customer,year,revenue\nZephyr Works,2024,3\n")
    before = {s.name for s in kb.values.log.state().of("rows")}
    kb.reindex(2.0)
    assert kb.values.route("total revenue of Zephyr Works in 2024")[0] == "sales/list2.csv"
    fresh = [s for s in kb.values.log.state().of("rows") if s.name not in before]
    assert sum(s.rows for s in fresh) < 40  # the entries of two files


def test_digests_answer_before_files(kb):
    store = contextstore.ContextStore(kb)
    store.sync()
    a = assistant.Assistant(kb, context=store)
    found = a.domain_answer("hr", "holiday calendar", [], 3)
    assert found.tier == "digest" and "thirty days" in found.text and {s["path"] for s in found.sources} == {"hr/leave.md"}
    assert a.domain_answer("hr", "quarterly zebra", [], 3).tier == "files"


def test_long_answers_say_what_they_leave_out():
    rows = [{"key": f"customer number {i}", "total": i} for i in range(400)]
    text = assistant.shown_rows(rows)
    assert len(text) < assistant.ANALYST_CHARS + 50 and text.endswith("more rows_") and text.count("\n|") >= 20
    assert "more rows" not in assistant.shown_rows(rows[:3])
    assert assistant.trimmed("a\nbc\nde", 5) == "a\nbc\n\n_cut_"

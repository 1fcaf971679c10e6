import pytest

from millrace.plans.knowledge import KnowledgeBase
from millrace.sources import config
from millrace.sources.store import Store


@pytest.fixture
def kb(spark, tmp_path):
    root = tmp_path / "kb"
    for path, text in {
        "sales/plan.md": "# Sales plan\n\nRevenue of the northern region grows with every new customer we win this year.",
        "sales/old.txt": "The former price list of the southern region, kept for reference only.",
        "hr/leave.md": "# Leave\n\nEvery employee has thirty days of holiday, requested in the holiday calendar.",
        "hr/pay.txt": "CONFIDENTIAL salary bands and holiday pay of all employees.",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    rules = {"sales": config.Domain("sales", ("revenue", "customer")), "hr": config.Domain("hr", ("holiday", "salary"), pins=("leave.md",))}
    return KnowledgeBase(spark, config.Settings(root=str(root), store=str(tmp_path / "store")), rules)


def test_life_of_an_index(kb):
    assert kb.reindex(1.0) == {"changed": 4, "removed": 0}
    assert kb.reindex(2.0) == {"changed": 0, "removed": 0}
    assert kb.doctor() == []
    kb.update_document("sales/plan.md", "\nOne more line.", "append")
    kb.update_document("sales/new.txt", "A new file about suppliers.")
    assert {(r.path, r.state) for r in kb.status().collect()} >= {("sales/plan.md", "stale"), ("sales/new.txt", "missing")}
    assert {d["finding"] for d in kb.doctor()} == {"index out of step"}
    assert kb.reindex(3.0) == {"changed": 2, "removed": 0}
    for bad in ("../x", "/etc/x", ""):
        with pytest.raises(ValueError):
            kb.update_document(bad, "x")
    with pytest.raises(ValueError):
        kb.update_document("a.txt", "x", "insert")


def test_search_route_and_context(kb):
    kb.reindex(1.0)
    assert kb.search("northern region revenue").first().path == "sales/plan.md"
    assert kb.route("holiday and salary questions") == ["hr"]
    shown = kb.context("holiday and salary questions")
    assert [s["path"] for s in shown["sources"]] == ["hr/leave.md"] and shown["withheld"] == 1
    assert {s["path"] for s in kb.context("holiday and salary questions", acknowledged=True)["sources"]} == {"hr/leave.md", "hr/pay.txt"}
    assert "hr: 2 files" in kb.manifest() and "hr/leave.md" in kb.index_page("hr")


def test_logs_and_sessions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.log_turn(100.0, "a", "what", "answer one", ["hr"], ["hr/x.md"], latency_ms=5)
    s.log_turn(200.0, "b", "why", "answer two", ["hr"], ["hr/y.md"], blocked=True)
    s.rate(250.0, "a", "what", "answer one", 5)
    with pytest.raises(ValueError):
        s.rate(1.0, "a", "q", "a", 6)
    row = s.audit_summary(300.0, 1).first()
    assert (row.n_turns, row.n_blocked, row.n_sessions) == (2, 1, 2)
    assert [r.session_id for r in s.read_audit().collect()] == ["b", "a"]
    weights = {r.file: r.weight for r in s.file_weights(300.0).collect()}
    assert set(weights) == {"hr/x.md"} and weights["hr/x.md"] > 1.4
    for i in range(3):
        s.remember("a", f"q{i}", f"a{i}", 1000.0 + i, max_turns=2)
    assert [m["text"] for m in s.history("a", 1010.0)] == ["q1", "a1", "q2", "a2"]
    assert s.history("a", 1e6) == [] and s.sessions(1e6).first().expired
    s.forget("a")
    assert s.history("a", 1010.0) == []
    assert s.rotate("audit", 150.0).count() == 1 and s.read("audit").count() == 1


def test_config(tmp_path):
    (tmp_path / ".env").write_text("# c\nMILLRACE_TOP_N=7\nexport MILLRACE_IGNORED='a, b'\nMILLRACE_ROOT=x\n")
    got = config.Settings.load(config.dotenv(str(tmp_path / ".env"), {"MILLRACE_ROOT": "y"}))
    assert (got.top_n, got.ignored, got.root) == (7, ("a", "b"), "y")
    d = config.domain("keywords: one\ntop_n: 3\ndata_patterns: ['(', ok]\nother: 1", "d")
    assert (d.keywords, d.top_n, d.data_patterns) == (("one",), 3, ("ok",))
    assert config.domain(d.to_yaml(), "d") == d
    assert config.missing_keys("domain: x") == ["keywords", "top_n", "max_chars"]

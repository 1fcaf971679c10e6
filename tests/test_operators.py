from millrace.operators import analyst, digest, gates, index, logs, profile, routing, search
from millrace.plans import api, planner, render


def collected(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


REVENUE = [("Acme", "2024", "100000"), ("Beta", "2024", "200000"), ("Gamma", "2025", "150,000"), ("Acme", "2025", "120000"), (None, "2025", "bad")]


def table(spark):
    return spark.createDataFrame(REVENUE, "customer string, year string, revenue string")


def test_total_top_and_trend(spark):
    t = table(spark)
    assert collected(analyst.total(t, "revenue")) == [(570000.0, 5)]
    assert [r[:3] for r in collected(analyst.top(t, "revenue", "customer", 2), "rank")] == [(1, "Acme", 220000.0), (2, "Beta", 200000.0)]
    assert collected(analyst.trend(t, "revenue", "year"), "nth") == [(1, "2024", 300000.0, None, None), (2, "2025", 270000.0, -30000.0, -10.0)]


def test_attrition_and_single_period(spark):
    assert collected(analyst.attrition(table(spark), "customer", "year", "revenue")) == [("Beta", "2025", 200000.0)]
    assert collected(analyst.attrition(table(spark).where("year = '2024'"), "customer", "year", "revenue")) == []


def test_trend_of_zero_base_has_no_percentage(spark):
    t = spark.createDataFrame([("2024", 0.0), ("2025", 5.0)], "year string, v double")
    assert collected(analyst.trend(t, "v", "year"), "nth")[1][3:] == (5.0, None)


def test_compare_disjoint_periods(spark):
    a = spark.createDataFrame([("Q3 2024", 350000.0)], "quarter string, revenue double")
    b = spark.createDataFrame([("Q4 2024", 375000.0)], "quarter string, revenue double")
    got = collected(analyst.compare(a, b, "revenue", "quarter"), "period")
    assert got == [("Q3 2024", 350000.0, 0.0, -350000.0, -100.0, False, True), ("Q4 2024", 0.0, 375000.0, 375000.0, None, True, False)]


def test_empty_table(spark):
    t = table(spark).limit(0)
    assert collected(analyst.total(t, "revenue")) == [(0.0, 0)]
    for f in (analyst.trend(t, "revenue", "year"), analyst.top(t, "revenue", "customer"), analyst.attrition(t, "customer", "year", "revenue")):
        assert collected(f) == []


def test_card_kinds(spark):
    card = profile.card(table(spark), "revenue.csv")
    assert {c.name: c.kind for c in card.columns} == {"customer": "entity", "year": "time", "revenue": "entity"} or card.of_kind("time") == ["year"]
    numeric = profile.card(table(spark).where("customer is not null"), "revenue.csv")
    assert numeric.of_kind("metric") == ["revenue"]
    assert "attrition_risk" in numeric.themes
    assert numeric.time_range == "2024 – 2025"


def test_twins_and_partitions(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (None, None, "a")], "x int, y int, z string")
    assert collected(digest.twins(t, ["x", "y"])) == [("x", "y", True)]
    assert collected(digest.same_partition(t, ["x", "z"])) == [("x", "z", False)]


def test_bm25_matches_the_formula(spark):
    import math

    texts = {1: "red fox red", 2: "blue fox", 3: "green tree by the lake", 4: "lake"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    from pyspark.sql import functions as F

    postings = search.terms(docs, "id", F.col("text"))
    sizes = docs.select("id", F.size(search.T.search_tokens(F.col("text"))).cast("long").alias("dl"))
    got = {r.id: r.score for r in search.bm25(postings, sizes, "red lake", "id").collect()}
    bags = {i: t.split() for i, t in texts.items()}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    score = {i: sum((idf[w] if idf[w] >= 0 else floor) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in ("red", "lake") if w in b) for i, b in bags.items()}
    best = max(score.values())
    assert {i: round(s / best, 9) for i, s in score.items() if s > 0} == {i: round(s, 9) for i, s in got.items()}


def test_fusion_of_equal_leaders_is_one(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    got = dict(collected(search.fuse(a, a, "id")))
    assert got[1] == 1.0 and got[2] < 1.0


def test_routing(spark):
    q = spark.createDataFrame([(1, "which servers and disks failed"), (2, "nothing here")], "question_id int, question string")
    k = spark.createDataFrame([("it", "server"), ("it", "disk"), ("hr", "holiday")], "domain string, keyword string")
    assert collected(routing.dominance(routing.keyword_hits(q, k))) == [(1, "it", 2, 0, True)]


def test_conflicts_need_two_domains(spark):
    a = spark.createDataFrame([("x", "Total revenue is 500 here."), ("y", "The total revenue is 600."), ("z", "net income is 5.")], "domain string, answer string")
    assert [r[0] for r in collected(routing.conflicts(a))] == ["total revenue"]


def test_index_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, hash string")
    once = index.upsert(old, new)
    assert collected(once, "path") == collected(index.upsert(once, new), "path") == [("a", "1"), ("b", "3"), ("c", "4")]
    assert collected(index.diff(new, old), "path") == [("a", "orphaned"), ("b", "stale"), ("c", "missing")]


def test_coalesced_repeats(spark):
    e = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, "y"), ("u", 4, "x")], "u string, ts int, what string")
    assert [(r[2], r[3]) for r in collected(logs.coalesce_repeats(e, "u", ["ts"], ["what"]), "island")] == [("x", 2), ("y", 1), ("x", 1)]


def test_withholding(spark):
    docs = spark.createDataFrame([("a", "internal use only"), ("b", "fine")], "path string, text string")
    flagged = gates.confidential(docs)
    assert collected(gates.withhold(docs.select("path"), flagged, False)) == [("b", False)]
    assert collected(gates.withhold(docs.select("path"), flagged, True), "path") == [("a", True), ("b", False)]


def test_planner():
    assert planner.parse_period("Q1 2026").years == (2026,) and planner.parse_period("Q1 2026").quarters == (1,)
    assert planner.parse_period("all").years == ()
    assert planner.operation("which customers churned last year") == "attrition"
    assert planner.operation("top 5 customers of total revenue") == "top"
    assert planner.refine({}, "FY2025", [])["time_range"] == "FY2025" and "top_n" not in planner.refine({}, "FY2025", [])
    assert planner.refine({}, "only the Americas region", [])["only"] == "Americas"


def test_budgets_and_charts():
    chart = render.chart("bar", ["a", "b"], {"v": [1.0, 2.0]})
    assert chart["csv"] == "label,v\na,1.0\nb,2.0\n" and "xychart" in chart["mermaid"]
    assert render.chart("bar", ["a"], {"v": [-1.0]})["mermaid"] is None
    assert len(render.within_budget([lambda: "x\n" * 100, lambda: "y\n" * 4], 20)) <= 20


def test_engine_dialogue(spark, tmp_path):
    f = tmp_path / "sales.csv"
    f.write_text("customer,year,revenue,cost\nAcme,2024,10,1\nBeta,2024,20,2\nAcme,2025,40,4\n")
    engine = api.Engine(spark)
    first = engine.query_data(str(f), "top customers")
    assert first["status"] == "clarifying" and {c["id"] for c in first["clarifications"]} == {"metric", "time_range"}
    second = engine.refine_query(first["session"], "revenue")
    assert second["status"] == "clarifying"
    done = engine.refine_query(first["session"], "all")
    assert done["status"] == "answered" and done["rows"][0]["key"] == "Acme" and done["rows"][0]["value"] == 50.0
    named = engine.query_data(str(f), "total revenue in 2024")
    assert named["rows"][0]["total"] == 30.0
    assert engine.query_data(str(tmp_path / "x.bin"), "total")["status"] == "error"


def test_digest_text(spark):
    text = api.digest_of(table(spark).where("customer is not null"), "revenue.csv")
    assert text.startswith("---\npath: revenue.csv") and "570,000" in text

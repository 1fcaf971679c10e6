"""Queries and answers that read all rows."""

from millrace.plans import catalogue
from millrace.operators import routing
from millrace.plans.api import SHOWN, Engine
from tests.shuffled import shuffled


def test_conflicts_of_later_turns(spark, tmp_path):
    rows = [(i, t, "user", f"The later budget is {i}00." if t == 5 else "Nothing.") for i in (1, 2) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.subject: r["values"] for r in catalogue.QUERIES["merge_conflicts"](spark, str(tmp_path)).collect()}["later budget"] == "100|200"


def test_complementary_sentences_of_all_documents(spark, tmp_path):
    common = "Every report repeats these common words."
    rows = [(i, f"{common} Only this mentions {' '.join(chr(97 + i % 26) * n for n in range(5 + i // 26 * 3, 8 + i // 26 * 3))} here.") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["merge_complementary"](spark, str(tmp_path)).collect()
    assert {(r.domain, r.n_new) for r in got} == {(i, 3) for i in range(60)} and all(r.sentence.startswith("Only this") for r in got)


def test_words_leave_their_sentence_behind(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    texts = [" ".join(word(3000 * k + i) for i in range(3000)) for k in range(4)]
    rows = [(k, f"Too short a one here. {t}. Then {t}?") for k, t in enumerate(texts)] + [(9, texts[0]), (8, None), (None, texts[3])]
    before = shuffled(spark)
    got = sorted((r.domain, r.sentence[:6], r.n_new) for r in routing.complementary(spark.createDataFrame(rows, "domain long, answer string")).where("domain is not null").collect())
    assert got == [(k, word(3000 * k)[:5] + " ", 3000) for k in (1, 2, 3)]
    assert shuffled(spark) - before < 5_000_000


def test_answers_count_beyond_what_they_show(spark, tmp_path):
    lines = ["customer,year,revenue", *(f"C{i:03d},2023,{100 + i}" for i in range(SHOWN + 20)), *(f"C{i:03d},2024,{100 + i}" for i in range(3))]
    (tmp_path / "sales.csv").write_text("\n".join(lines))
    out = Engine(spark).query_data(str(tmp_path / "sales.csv"), "which customers churned", {"time_range": "all"})
    assert len(out["rows"]) == SHOWN and out["total"] == SHOWN + 17 and out["answer"].startswith(f"{SHOWN + 17} ")
    docs = spark.createDataFrame([(f"f{i:03d}.txt", "CONFIDENTIAL plan" if i % 2 == 0 else "plan") for i in range(2 * SHOWN + 10)], "path string, text string")
    seen = Engine(spark).check_confidential(docs)
    assert len(seen["files"]) == SHOWN and seen["total"] == SHOWN + 5


def test_grounding_in_every_language(spark, tmp_path):
    spark.createDataFrame([(1, "the garden wall", "en"), (2, "der alte Turm", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "garden Turm nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["gate_grounding"](spark, str(tmp_path)).first()
    assert (got.n_claims, got.n_grounded) == (3, 2)


def test_recall_over_all_documents(spark, tmp_path):
    rows = [(i, f"{'A rare passage on harbours' if i == 10 else 'Plain words'} and number {i}.", "src0") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "rare passage on harbours"), (2, "nowhere to be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["eval_recall"](spark, str(tmp_path)).collect()
    assert {(r.question_id, r.n_found, r.recall) for r in got} == {(1, 1, 1.0), (2, 0, 0.0)}

import json

from millrace import cli
from millrace.operators import summaries


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master=None: spark)
    (tmp_path / "kb/hr").mkdir(parents=True)
    (tmp_path / "kb/hr/a.md").write_text("# Leave rules\n\nEvery employee has thirty days of holiday in a year.")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/hr.yaml").write_text("keywords: [holiday, leave]\n")
    (tmp_path / ".env").write_text(f"MILLRACE_ROOT={tmp_path}/kb\nMILLRACE_STORE={tmp_path}/store\n")
    opts = ["--env", f"{tmp_path}/.env", "--rules", f"{tmp_path}/rules"]

    def run(*words):
        code = cli.main([*words, *opts])
        return code, capsys.readouterr().out

    assert run("doctor")[0] == 1
    assert json.loads(run("reindex")[1]) == {"changed": 1, "removed": 0}
    assert run("doctor")[0] == 0
    assert json.loads(run("status")[1])[0]["n_ok"] == 1 and json.loads(run("diff")[1]) == []
    assert "hr: 1 files" in run("manifest")[1] and "thirty days" in run("ask", "holiday leave")[1]
    (tmp_path / "t.csv").write_text("customer,revenue\nA,1\nB,3\n")
    assert json.loads(run("query", f"{tmp_path}/t.csv", "total revenue")[1])["rows"][0]["total"] == 4.0
    assert json.loads(run("profile", f"{tmp_path}/t.csv")[1])["total_rows"] == 2


def test_blocks_and_summaries(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("a <!--s--> old <!--e--> b", "x/Plan.md"), ("none", "x/Budget of Sales.txt")], "t string, p string")
    got = t.select(summaries.marked_block(F.col("t"), "<!--s-->", "<!--e-->"), summaries.replace_block(F.col("t"), "<!--s-->", "<!--e-->", F.lit("new")), summaries.placeholder(F.lit("plan"), F.substring_index("p", "/", -1)), summaries.name_tokens(F.col("p"))).collect()
    assert got[0][0] == "old" and got[0][1] == "a <!--s-->\nnew\n<!--e--> b" and got[0][2] and not got[1][2]
    assert got[1][0] is None and got[1][1].endswith("<!--s-->\nnew\n<!--e-->") and got[1][3] == ["budget", "sale"]
    docs = spark.createDataFrame([(1, "x/tea.txt", "# All about tea\ntea | cup\nTea is made from tea leaves")], "id int, p string, t string")
    assert summaries.file_summaries(docs, "id", F.col("p"), F.col("t")).first().summary.startswith("All about tea. Terms: tea")

"""Sketches of columns: parts merged equal the whole, and empty columns."""

import random

from millrace.operators import profile, sketches
from millrace.plans import stored
from millrace.plans.knowledge import KnowledgeBase
from millrace.sources import config


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "b", " b ", "", None]), str(rng.randint(0, 400)) if i % 9 else None, None, f"id{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, amount string, none string, key string").cache()
    parts = [sketches.sketch(df.where(f"hash(key) % 3 in ({i}, -{i})"), f"p{i}") for i in range(3)]
    split = {r.name: r for r in sketches.report(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    whole = {r.name: r for r in sketches.report(sketches.sketch(df, "w")).collect()}
    exact = {r.name: r for r in profile.column_stats(df).collect()}
    for name, r in exact.items():
        for got in (split[name], whole[name]):
            assert (got.n_rows, got.n_nulls, got.null_rate, got.longest, got.least, got.greatest) == (r.n_rows, r.n_nulls, r.null_rate, r.longest, r.least, r.greatest)
            assert got.numeric_ratio == r.numeric_ratio and (got.total or 0) == (r.numeric_total or 0)
            assert abs(got.cardinality - r.cardinality) <= 0.025 * r.cardinality
    assert split["none"].quartiles is None and split["none"].common == [] and split["kind"].quartiles is None
    assert [(c.value, c.n) for c in split["kind"].common] == [("b", sum((k or "").strip() == "b" for k, *_ in rows)), ("a", sum(k == "a" for k, *_ in rows))]
    numbers = sorted(int(a) for _, a, *_ in rows if a)
    for k, q in enumerate(split["amount"].quartiles, 1):
        rank = sum(n <= q for n in numbers) / len(numbers)
        assert abs(rank - k / 4) < 0.03
    assert sketches.report(sketches.sketch(df.limit(0), "none")).collect() == []


def test_a_grown_folder_reads_its_new_file_only(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "sales").mkdir(parents=True)
    (root / "sales/a.csv").write_text("customer,revenue\nx,1\ny,2\n")
    kb = KnowledgeBase(spark, config.Settings(root=str(root), store=str(tmp_path / "store")), {"sales": config.Domain("sales", ("revenue",))})
    kb.reindex(1.0)
    first = set(kb.sketches.state().segments)
    (root / "sales/b.csv").write_text("customer,revenue\nz,5\nx,\n")
    kb.reindex(2.0)
    got = {r.name: r for r in kb.profile("sales").collect()}
    assert (got["revenue"].n_rows, got["revenue"].n_nulls, got["revenue"].total, got["customer"].cardinality) == (4, 1, 8.0, 3)
    assert first <= set(kb.sketches.state().segments)
    (root / "sales/a.csv").unlink()
    kb.reindex(3.0)
    assert {r.name: r.n_rows for r in kb.profile("sales").collect()} == {"customer": 2, "revenue": 2}


def test_columns_without_common_values_are_reported(spark, tmp_path):
    kinds = "case when id % 9 < 5 then 'A' when id % 9 < 8 then 'B' else 'C' end as c_mktsegment"
    rows = spark.range(15_000).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey", "cast(id * 7919 % 15000 as double) as c_acctbal", kinds)
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = stored.QUERIES["profile_sketches"](spark, str(tmp_path)).collect()
    assert sorted((r.name, r.n_rows, r.cardinality_near, r.quartiles_near, r.common_near) for r in got) == [(c, 15_000, True, True, True) for c in sorted(stored._SKETCHED)]

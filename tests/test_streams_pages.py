"""Folder events, bursts, changed sets and written pages against brute force."""

import os
import random
import time
import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.plans.stored import in_steps
from millrace.sources import pages
from millrace.streaming import events, folder, keyed


def put(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


def told(reader, start, end):
    return sorted((path, kind) for piece in reader.partitions({"listing": start}, {"listing": end}) for path, _, kind, *_ in reader.read(piece))


# ---- folder events


def test_listings_differ_by_what_happened(tmp_path):
    root = str(tmp_path / "in")
    reader = folder.FolderReader({"path": root, "listings": str(tmp_path / "listings"), "buckets": "3", "pattern": "*.txt"})
    assert reader.latestOffset() == reader.initialOffset() == {"listing": 0}  # no folder yet
    for name in ("a/1.txt", "a/2.txt", "b/c/3.txt", "_tmp/4.txt", "a/.5.txt", "a/6.md"):
        put(root, name, name)
    assert reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    assert told(reader, 0, 1) == [("a/1.txt", "created"), ("a/2.txt", "created"), ("b/c/3.txt", "created")]
    put(root, "a/1.txt", "other text")
    os.remove(f"{root}/a/2.txt")
    os.rename(f"{root}/b/c/3.txt", f"{root}/b/moved.txt")
    assert reader.latestOffset() == {"listing": 2}
    want = [("a/1.txt", "modified"), ("a/2.txt", "deleted"), ("b/c/3.txt", "deleted"), ("b/moved.txt", "created")]
    assert told(reader, 1, 2) == want == told(reader, 1, 2)  # a repeated batch is the same batch
    put(root, "a/2.txt", "back")
    again = folder.FolderReader({"path": root, "listings": str(tmp_path / "listings"), "buckets": "3", "pattern": "*.txt"})
    assert again.latestOffset() == {"listing": 3}
    # a listing that no batch was made of is passed over, and nothing is lost
    assert told(again, 1, 3) == [("a/1.txt", "modified"), ("a/2.txt", "modified"), ("b/c/3.txt", "deleted"), ("b/moved.txt", "created")]
    assert told(again, 3, 3) == []


def test_old_listings_go(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "KEPT", 1)
    reader = folder.FolderReader({"path": str(tmp_path / "in"), "listings": str(tmp_path / "listings")})
    for i in range(4):
        put(str(tmp_path / "in"), f"{i}.txt", "x")
        reader.commit(reader.latestOffset())
    assert reader.numbers() == [3, 4]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    root = str(tmp_path / "in")

    def run():
        out = events.drain(folder.watch(spark, root, str(tmp_path / "listings")), f"t{uuid.uuid4().hex}", "append", str(tmp_path / "checkpoint"))
        return sorted((r.path, r.kind, r.listing) for r in out.collect())

    put(root, "a/1.txt", "one")
    first = run()
    assert first == [("a/1.txt", "created", 1)] == run()
    os.remove(f"{root}/a/1.txt")
    put(root, "a/2.txt", "two")
    assert run() == [*first, ("a/1.txt", "deleted", 2), ("a/2.txt", "created", 2)]


# ---- bursts

EVENT = st.tuples(st.integers(0, 60), st.sampled_from("abc"), st.sampled_from(["modified", "deleted"]))


def bursts_reference(rows, quiet):
    out, last = [], None
    for t, seq, path, kind in sorted((t, i, p, k) for i, (t, p, k) in enumerate(rows)):
        if last is None or t - last >= quiet:
            out.append({"first": t, "n": 0, "paths": {}})
        last = t
        out[-1].update(last=t, n=out[-1]["n"] + 1)
        out[-1]["paths"][path] = kind
    return [(b["first"], b["last"], b["n"], tuple(sorted(b["paths"].items()))) for b in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(EVENT, min_size=1, max_size=25), st.integers(1, 12), st.randoms(use_true_random=False))
def test_bursts_in_any_order_equal_sorted_events(rows, quiet, rng):
    pieces = [pd.DataFrame({"first": [t], "last": [t], "path": [p], "kind": [k], "at": [t], "seq": [i], "n": [1]}) for i, (t, p, k) in enumerate(rows)]
    rng.shuffle(pieces)
    state = None
    while pieces:
        taken = [pieces.pop() for _ in range(min(len(pieces), rng.randint(1, 4)))]
        state = keyed.merged(pd.concat([*([] if state is None else [state]), *taken], ignore_index=True), quiet)
    got = [(a, b, int(x["n"].sum()), tuple(sorted(zip(x["path"], x["kind"], strict=True)))) for (a, b), x in state.groupby(["first", "last"])]
    assert got == bursts_reference(rows, quiet)


def test_bursts_lie_open_across_runs(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("f", "a", "modified", 0, 0, 1), ("f", "b", "modified", 8, 1, 1), ("f", "a", "deleted", 4, 2, 2), ("g", "x", "modified", 4, 3, 2), ("f", "c", "modified", 30, 4, 2), ("h", "end", "modified", 500, 5, 3), (None, "n", "deleted", 1, 6, 1)]
    df = spark.createDataFrame([(f, p, k, at(s), q, step) for f, p, k, s, q, step in rows], "folder string, path string, kind string, at timestamp, seq long, step int")
    out = in_steps(df, [F.col("step") == i for i in (1, 2, 3)], lambda s: keyed.debounced(s, "5 seconds", "60 seconds"), "append")
    got = sorted((r.folder or "", (r.first_at - at(0)).total_seconds(), (r.last_at - at(0)).total_seconds(), r.n_events, r.removed, r.indexed) for r in out.collect())
    # the late event at 4 joins those at 0 and 8
    assert got == [("", 1, 1, 1, ["n"], []), ("f", 0, 8, 3, ["a"], ["b"]), ("f", 30, 30, 1, [], ["c"]), ("g", 4, 4, 1, [], ["x"])]


def test_streamed_bursts_equal_those_in_memory(spark):
    rng = random.Random(5)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(rng.randrange(300), rng.choice("abc"), rng.choice(["modified", "deleted"]), at(s := rng.randrange(600)), i, s // 200) for i in range(12_000)]
    df = spark.createDataFrame([*rows, (-1, "end", "modified", at(2000), -1, 3)], "folder long, path string, kind string, at timestamp, seq long, step int")
    out = in_steps(df, [F.col("step") == i for i in range(4)], lambda s: keyed.debounced(s, "12 seconds", "100 seconds"), "append").collect()
    got = sorted((r.folder, (r.first_at - at(0)).total_seconds(), (r.last_at - at(0)).total_seconds(), r.n_events, tuple(r.removed), tuple(r.indexed)) for r in out)
    want = []
    for key in range(300):
        mine = [((t - at(0)).total_seconds(), p, k, i) for f, p, k, t, i, _ in rows if f == key]
        pieces = pd.DataFrame({"first": [m[0] for m in mine], "last": [m[0] for m in mine], "path": [m[1] for m in mine], "kind": [m[2] for m in mine], "at": [m[0] for m in mine], "seq": [m[3] for m in mine], "n": 1})
        for (a, b), x in keyed.merged(pieces, 12).groupby(["first", "last"]):
            gone = x["kind"] == "deleted"
            want.append((key, a, b, int(x["n"].sum()), tuple(x["path"][gone]), tuple(x["path"][~gone])))
    assert len(want) > 5000 and got == sorted(want)
    arriving = spark.readStream.schema(df.schema).parquet("file:///nowhere/at/all*")
    plan = keyed.debounced(arriving)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan  # a Python call for each burst took minutes


# ---- changed sets


@pytest.mark.parametrize(("keep", "want"), [("1 day", [(1, ["a", "b"], None), (1, ["a"], 2), (2, ["c"], None), (3, [], None)]), ("1 millisecond", None)])
def test_sets_are_told_when_they_change(spark, keep, want):
    rows = [(1, "a", 0), (1, "b", 0), (1, "a", 0), (2, "c", 0), (1, "b", 1), (1, "a", 1), (2, "c", 2), (1, "a", 2), (3, None, 2)]
    df = spark.createDataFrame(rows, "key long, item string, step int")

    def slow(s):
        time.sleep(0.05)
        return keyed.changed_sets(s, keep)

    out = in_steps(df, [F.col("step") == i for i in range(3)], slow, "update", idle=False)
    got = sorted(((r.key, r["items"], r.n_before) for r in out.collect()), key=lambda r: (r[0], -len(r[1])))
    if want:
        assert got == want
    else:  # forgotten at once, so every step tells its sets
        assert [g[:2] for g in got] == [(1, ["a", "b"]), (1, ["a", "b"]), (1, ["a"]), (2, ["c"]), (2, ["c"]), (3, [])]


# ---- pages


def test_pages_are_written_once(spark, tmp_path):
    root = str(tmp_path / "pages")
    rows = spark.createDataFrame([("a/1.md", "one"), ("b.md", ""), ("c d/é.md", "drei")], "path string, content string")
    assert pages.write(rows, root) == {"written": 3, "kept": 0, "deleted": 0}
    before = os.stat(f"{root}/a/1.md").st_mtime_ns
    changed = spark.createDataFrame([("a/1.md", "one"), ("b.md", "now"), ("c d/é.md", None), ("none.md", None)], "path string, content string")
    assert pages.write(changed, root) == {"written": 1, "kept": 1, "deleted": 1}
    assert os.stat(f"{root}/a/1.md").st_mtime_ns == before and not os.path.exists(f"{root}/c d/é.md")
    with open(f"{root}/b.md") as f:
        assert f.read() == "now"
    assert pages.write(changed.limit(0), root) == {"written": 0, "kept": 0, "deleted": 0}
    assert not os.listdir(f"{root}/{pages.PRIVATE}/unfinished")


@pytest.mark.parametrize("path", ["../x.md", "/etc/x.md", "a/../../x.md", "", "_pages/x.md"])
def test_pages_stay_below_their_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a page below its root"):
        pages.write(spark.createDataFrame([(path, "x")], "path string, content string"), str(tmp_path / "pages"))

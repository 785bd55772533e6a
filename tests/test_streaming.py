"""Incremental graphs."""

import json
import time

from latticework.streaming.watch import CHANGE, LiveGraph, change_stream, debounced, quiet_changes, snapshot_changes


def change(spark, *rows):
    return spark.createDataFrame(rows, "filepath string, event string, seen string, text string").selectExpr("filepath", "event", "cast(seen as timestamp) as seen", "text")


def test_batches(spark, tmp_path):
    live, seen = LiveGraph(spark, str(tmp_path / "g")), []
    assert live.version == -1 and live.read().nodes.count() == 0 and live.feed().count() == 0
    live.apply(change(spark, ("a.py", "created", "2024-01-01 00:00:00", "def old(): ..."), ("a.py", "modified", "2024-01-01 00:00:01", "import os\ndef one(): two()\ndef two(): ..."), ("b.py", "created", "2024-01-01 00:00:00", "def three(): ...")), 0, lambda f, e: seen.append((f, e)))
    assert sorted(r["name"] for r in live.read().nodes.collect()) == ["one", "three", "two"]
    assert sorted(seen) == [("a.py", "modified"), ("b.py", "created")]
    again = change(spark, ("a.py", "modified", "2024-01-01 00:00:02", "import os\ndef one(): ..."), ("b.py", "deleted", "2024-01-01 00:00:02", None))
    live.apply(again, 1, hot_weight="in_degree")
    live.apply(again, 1)
    g = live.read()
    assert [r["name"] for r in g.nodes.collect()] == ["one"] and [(r["source"], r["target"]) for r in g.edges.collect()] == [("a.py", "os")]
    assert {r["id"] for r in live.feed("graph_updated", since=0).collect()} == {"a.py", "b.py"}
    assert live.feed("node_changed", since=-1).where("change = 'updated' and batch = 0").count() == 3


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"filepath": "a.py", "event": "created", "seen": "2024-01-01T00:00:00Z", "text": "def f(): ..."}))
    live = LiveGraph(spark, str(tmp_path / "g"))
    live.follow(change_stream(spark, str(folder)), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert [r["name"] for r in live.read().nodes.collect()] == ["f"]


def test_snapshots(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "filepath string, modified long, text string").selectExpr("filepath", "timestamp_seconds(modified) as modified", "text")
    after = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 1, "z")], "filepath string, modified long, text string").selectExpr("filepath", "timestamp_seconds(modified) as modified", "text")
    assert {(r["filepath"], r["event"]) for r in snapshot_changes(before, after).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert debounced(spark.createDataFrame([], CHANGE)).count() == 0


def test_files_wait_until_they_are_quiet(spark, tmp_path):
    """Three changes of a file within the quiet period come out as one, the last; another file's isn't held up by them."""
    folder, got = tmp_path / "in", []
    folder.mkdir()
    line = lambda f, e, s, t: json.dumps({"filepath": f, "event": e, "seen": f"2024-01-01T00:00:0{s}Z", "text": t})
    (folder / "1.json").write_text("\n".join([line("a.py", "created", 0, "x = 1"), line("b.py", "created", 0, "y = 1"), line("a.py", "modified", 1, "x = 2")]))
    keep = lambda df, batch: got.extend((r["filepath"], r["event"], r["text"]) for r in df.collect())
    query = quiet_changes(change_stream(spark, str(folder)), 3000).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while len(got) < 2 and time.time() < end:
            time.sleep(0.2)
        assert sorted(got) == [("a.py", "modified", "x = 2"), ("b.py", "created", "y = 1")]
        (folder / "2.json").write_text(line("a.py", "deleted", 2, None))
        while len(got) < 3 and time.time() < end:
            time.sleep(0.2)
        assert got[2] == ("a.py", "deleted", None)
    finally:
        query.stop()


def test_a_batch_that_is_run_again(spark, tmp_path, monkeypatch):
    """Cut off before its mark, a batch writes the same version and messages; after it, nothing.  Old versions go."""
    live = LiveGraph(spark, str(tmp_path / "g"))
    live.apply(change(spark, ("a.py", "created", "2024-01-01 00:00:00", "def f(): ...\ndef g(): ...")), 0)
    shrink = change(spark, ("a.py", "modified", "2024-01-01 00:00:01", "def f(): ..."))
    live.apply(shrink, 1)
    want = sorted(map(tuple, live.feed(since=0).collect()))
    import shutil

    shutil.rmtree(tmp_path / "g" / "v1" / "mark")
    assert live.version == 0
    live.apply(shrink, 1)
    live.apply(shrink, 1)
    assert live.version == 1 and sorted(map(tuple, live.feed(since=0).collect())) == want and any("removed" in r for r in want)
    for batch in range(2, 6):
        live.apply(change(spark, ("b.py", "modified", f"2024-01-01 00:00:0{batch}", f"def h{batch}(): ...")), batch)
    assert live.version == 5 and sorted(r["name"] for r in live.read().nodes.collect()) == ["f", "h5"]
    assert sorted(p.name for p in (tmp_path / "g").glob("v*")) == ["v3", "v4", "v5"]

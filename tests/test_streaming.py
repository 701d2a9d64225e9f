import json

from codeloom.streaming import events


def test_call_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"tool_name": "a", "error": None}, {"tool_name": "a", "error": "x"}, {"tool_name": "b"}]
    (tmp_path / "in/1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    q = events.running_tool_counts(events.call_log(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.tool_name, r.calls, r.errors) for r in spark.table("counts").collect()) == [("a", 2, 1), ("b", 1, 0)]


def test_bursts(spark):
    rows = [("a.py", "2024-01-01 00:00:00"), ("b.py", "2024-01-01 00:00:01"), (".git/c.py", "2024-01-01 00:00:01"), ("a.py", "2024-01-01 00:00:09")]
    df = spark.createDataFrame(rows, "path string, ts string").selectExpr("path", "cast(ts as timestamp) ts")
    got = events.bursts(df).orderBy("start").collect()
    assert [(sorted(r.paths), r.n_events) for r in got] == [(["a.py", "b.py"], 2), (["a.py"], 1)]

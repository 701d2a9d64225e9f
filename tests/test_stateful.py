import json
import time

import pytest

from codeloom.operators import logs
from codeloom.streaming import stateful


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State is kept per partition; one keeps the micro-batches of a test short."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{name}").rename(folder / name)


def until(done, most=120):
    end = time.time() + most
    while not done() and time.time() < end:
        time.sleep(0.3)
    assert done()


def test_record_on_change_across_restarts(spark, tmp_path):
    """Three runs over growing input, each from the checkpoint of the last, give what the batch operator gives."""
    series = [{"spec": s, "ts": i, "avg": v, "n": n} for s, values in (("a", [(0.5, 1), (0.5, 1), (0.7, 1), (None, 1), (None, 1), (0.7, 2)]), ("b", [(1.0, None), (1.0, None), (1.0 + 1e-12, 0), (2.0, 0), (1.0, 0), (1.0, 0)])) for i, (v, n) in enumerate(values)]
    (tmp_path / "in").mkdir()
    schema = "spec string, ts long, avg double, n double"
    for part in range(3):
        put(tmp_path / "in", f"{part}.json", [r for r in series if r["ts"] // 2 == part])
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = stateful.record_on_change(stream, "spec", "ts", ("avg", "n")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
    got = sorted(map(str, spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()))
    want = logs.on_change(spark.createDataFrame([(r["spec"], r["ts"], r["avg"], None if r["n"] is None else float(r["n"])) for r in series], schema), "spec", "ts", ("avg", "n"))
    assert got == sorted(map(str, want.collect())) and len(got) == 8


def test_bursts_end_in_silence_and_survive_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key string, path string"

    def start():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        return stateful.quiet_bursts(stream, 4_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))

    def rows():
        try:
            return sorted((r.key, r.path, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        except Exception:
            return []

    put(tmp_path / "in", "1.json", [{"key": "w", "path": "a.py"}, {"key": "w", "path": "a.py"}, {"key": "v", "path": "z.py"}])
    q = start()
    until(lambda: any(p["numInputRows"] for p in q.recentProgress))
    put(tmp_path / "in", "2.json", [{"key": "w", "path": "b.py"}, {"key": "w", "path": None}])
    until(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 4)
    q.stop()  # an open burst waits in the checkpoint
    q.awaitTermination(30)
    q = start()
    put(tmp_path / "in", "3.json", [{"key": "v", "path": "y.py"}])  # the first event after a restart sets the clock going
    until(lambda: len(rows()) == 4)
    assert rows() == [("v", "y.py", 1), ("v", "z.py", 1), ("w", "a.py", 2), ("w", "b.py", 1)]
    put(tmp_path / "in", "4.json", [{"key": "w", "path": "a.py"}])
    until(lambda: len(rows()) == 5)
    assert ("w", "a.py", 1) in rows()
    q.stop()

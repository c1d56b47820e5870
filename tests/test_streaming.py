import json
import time

import pytest
from pyspark.sql import functions as F

from flowlake.operators import parse, registry
from flowlake.plans import fixtures as fx
from flowlake.sources import lake
from flowlake.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return fx.event_logs(spark, SF).drop("event_id").cache()


def text_file(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_suffix(".tmp")
    tmp.write_text("\n".join(lines) + "\n")
    tmp.rename(path)


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_ingest_survives_restart_and_keeps_late_rows(spark, logs, tmp_path):
    lines = [r[0] for r in logs.select(parse.render(logs, "A")).collect()]
    half = len(lines) // 2
    src, out, bad, ck = (str(tmp_path / x) for x in ("in", "out", "bad", "ck"))
    now = F.lit(1706745600)
    text_file(tmp_path / "in/2024-01-01-00.raw", lines[half:] + ["junk"])
    finish(jobs.ingest_batches(jobs.read_lines(spark, src), out, bad, ck, now))
    text_file(tmp_path / "in/2024-01-01-01.raw", lines[:half])  # older rows come later
    finish(jobs.ingest_batches(jobs.read_lines(spark, src), out, bad, ck, now))
    got = spark.read.parquet(out).drop("batch").select(*logs.columns)
    assert got.count() == logs.count() and got.exceptAll(logs).isEmpty()
    assert spark.read.parquet(bad).count() == 1


def test_append_sink_partitions_by_event_day(spark, logs, tmp_path):
    src = str(tmp_path / "rows")
    logs.write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src)
    q = jobs.ingest(stream, str(tmp_path / "lake"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lake.read_lake(spark, str(tmp_path / "lake"))
    assert rows.exceptAll(logs).isEmpty() and rows.count() == logs.count()


def test_running_registry_and_live_counts(spark, logs, tmp_path):
    for k in (0, 1):
        logs.where(F.col("src_port") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"rows/part{k}"))
    stream = spark.readStream.schema(logs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    finish(jobs.running_registry(stream, str(tmp_path / "dim"), str(tmp_path / "ck")))
    got = jobs.read_registry(spark, str(tmp_path / "dim"))
    want = registry.dim_ip(logs)
    assert sorted(p.name for p in (tmp_path / "dim").iterdir()) == ["delta=0", "delta=1"] and got.exceptAll(want).isEmpty() and got.count() == want.count()
    q = jobs.live_counts(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live").agg(F.sum("log_count")).first()[0] == logs.count()
    q = jobs.hourly_volume(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == logs.count()


def test_registry_is_merged_and_a_repeated_batch_counts_once(spark, logs, tmp_path):
    n, path = 7, str(tmp_path / "dim")
    parts = [logs.where(F.col("src_port") % n == k) for k in range(n)]
    runs = []

    class Writer:
        writeStream = property(lambda self: self)

        def foreachBatch(self, run):
            runs.append(run)
            return self

        def option(self, *_):
            return self

    jobs.running_registry(Writer(), path, "ck", every=2)
    for k, part in enumerate(parts):
        runs[0](part, k)
        if k in (2, 4, 5):
            runs[0](part, k)  # after a failure
    names = sorted(p.name for p in (tmp_path / "dim").iterdir())
    assert names == ["delta=5", "delta=6", "total=4", "total=6"]
    got, want = jobs.read_registry(spark, path), registry.dim_ip(logs)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_compacted_days_keep_their_rows(spark, logs, tmp_path):
    path = str(tmp_path / "lake")
    for k in range(3):
        lake.write_archive(logs.where(F.col("src_port") % 3 == k), path, mode="append")
    before = lake.catalog(spark, path, "hot").agg(F.sum("files")).first()[0]
    jobs.compact(spark, path, [f"2024-01-{d:02d}" for d in range(1, 11)])
    rows = lake.read_lake(spark, path)
    assert rows.exceptAll(logs).isEmpty() and rows.count() == logs.count()
    assert lake.catalog(spark, path, "hot").agg(F.sum("files")).first()[0] < before


def test_chunks_of_a_source_come_in_order():
    import pandas as pd

    frame = lambda *p: pd.DataFrame({"block": [b for b, _ in p], "line_no": [n for _, n in p]})
    got = list(jobs.Reassembler._in_order(iter([frame((0, 1), (0, 0)), frame((0, 2), (5, 0)), frame((3, 0)), frame((9, 9))])))
    assert [x.values.tolist() for x in got] == [[[0, 0], [0, 1]], [[0, 2], [3, 0], [5, 0]], [[9, 9]]]


def test_landing_and_audit_feed(spark, tmp_path):
    text_file(tmp_path / "in/a.txt", ["x", "y"])
    lines = spark.readStream.text(str(tmp_path / "in")).withColumn("arrived", F.timestamp_seconds(F.lit(1704844800)))
    finish(jobs.land(lines, str(tmp_path / "landed"), str(tmp_path / "ck")))
    assert sorted(r["value"] for r in spark.read.option("pathGlobFilter", "2024-01-10-00.*.raw").text(str(tmp_path / "landed")).collect()) == ["x", "y"]
    text_file(tmp_path / "audit/1.json", [json.dumps({"id": 1, "username": "u", "action": "search", "details": "{}", "ip_address": "1.2.3.4", "ts": 1704844800})])
    finish(jobs.audit_feed(spark, str(tmp_path / "audit"), str(tmp_path / "log"), str(tmp_path / "ck4")))
    assert [str(r["day"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["2024-01-10"]


def test_pending_line_is_kept_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "source string, block long, line_no long, value string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))

    def put(name, rows):
        text_file(tmp_path / f"in/{name}.json", [json.dumps(dict(zip(("source", "block", "line_no", "value"), r))) for r in rows])

    writer = jobs.reassemble(stream, wait_ms=15_000).writeStream.format("memory").queryName("whole").outputMode("append")
    q = writer.trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "ck")).start()

    def until(done):
        for _ in range(60):  # timers keep the query busy, so it is never out of work
            assert q.exception() is None
            if done():
                return
            time.sleep(1)
        raise AssertionError("no progress")

    def read():
        return sum(p["numInputRows"] for p in q.recentProgress)

    try:
        put("a", [("s", 0, 0, "one->1.2.3.4"), ("t", 0, 0, "other")])
        until(lambda: read() >= 2)
        put("b", [("s", 0, 0, "  :80, NAT"), ("s", 0, 1, "two")])
        until(lambda: spark.table("whole").count() >= 3)
        got = sorted((r["source"], r["line"]) for r in spark.table("whole").collect())
        assert got == [("s", "one->1.2.3.4:80, NAT"), ("s", "two"), ("t", "other")]
    finally:
        q.stop()


def test_freshness_and_old_files(spark):
    seen = spark.createDataFrame([("a", 1000), ("a", 900), ("b", 9000)], "source string, ts long")
    files = spark.createDataFrame([("a", 5, True), ("b", 70, False), ("b", 40, False)], "source string, size long, done boolean")
    got = sorted(tuple(r) for r in jobs.freshness(seen, files, 10_000, 3600, 100).collect())
    assert got == [("a", "stalled", 9000), ("b", "backlog", 110)]
    f = spark.createDataFrame([("x", 0), ("y", None), ("z", 90_000)], "path string, processed_at long")
    assert [r["path"] for r in jobs.processed_files_to_drop(f, 100_000, 24).collect()] == ["x"]

import os
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.operators import parse
from flowlake.plans import fixtures as fx
from flowlake.sources import growing, lake
from flowlake.sources import versions as vs
from flowlake.schemas import ALERTS
from flowlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert q.exception() is None


def grown(data, ranges, at):
    return sorted((n, x) for r in ranges for found, starts in growing.lines(at(data), r) for x, n in zip(found, starts))


def test_ranges_give_every_line_once(monkeypatch):
    import io

    rng = random.Random(9)
    for _ in range(300):
        data = b"".join(bytes(rng.choice(b"ab ") for _ in range(rng.choice([0, 1, 2, 5, 40]))) + b"\n" for _ in range(rng.randint(0, 12))) + b"rest" * rng.randint(0, 3)
        monkeypatch.setattr(growing, "BLOCK", rng.choice([1, 3, 8, 1 << 20]))
        end = growing.last_line_end(io.BytesIO(data), len(data))
        assert end == data.rfind(b"\n") + 1
        want, at = [], 0
        for x in data[:end].split(b"\n")[:-1]:
            want.append((at, x))
            at += len(x) + 1
        reader = growing.Reader("", "*", rng.randint(1, 30))
        floor = rng.choice([n for n, _ in want] + [0])
        assert grown(data, reader.partitions({"f": floor}, {"f": end} if end else {}), io.BytesIO) == [w for w in want if w[0] >= floor]
    reader = growing.Reader("", "*", 10)
    assert [(r.begin, r.floor) for r in reader.partitions({"f": 50}, {"f": 15})] == [(0, 0), (10, 0)]  # a file that has shrunk
    assert reader.partitions({"f": 50, "g": 1}, {"f": 50}) == []  # nothing new, and one that is gone


def test_appended_bytes_arrive_once_over_a_restart(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def read():
        stream = growing.read_growing(spark, str(src), range_bytes=7)
        run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
        return sorted((os.path.basename(r["file"]), r["line"], r["value"]) for r in spark.read.schema(growing.SCHEMA).parquet(out).collect())

    (src / "a.raw").write_bytes(b"one\ntwo\nthr")
    (src / "b.raw").write_bytes(b"no line yet")
    (src / "c.txt").write_bytes(b"other\n")
    first = [("a.raw", 0, "one"), ("a.raw", 4, "two")]
    assert read() == first
    with open(src / "a.raw", "ab") as f:
        f.write(b"ee\r\n\xff\n")
    (src / "b.raw").write_bytes(b"no line yet\n" + b"x" * 30 + b"\n")
    second = sorted([*first, ("a.raw", 8, "three"), ("a.raw", 15, "�"), ("b.raw", 0, "no line yet"), ("b.raw", 12, "x" * 30)])
    assert read() == second
    assert read() == second
    (src / "a.raw").write_bytes(b"new\n")  # written anew, shorter
    os.remove(src / "b.raw")
    assert read() == sorted([*second, ("a.raw", 0, "new")])


def test_growing_files_are_ingested(spark, tmp_path):
    logs = fx.event_logs(spark, SF).drop("event_id")
    texts = [r[0] for r in logs.select(parse.render(logs, "A")).collect()]
    src, hot, bad, ck = (str(tmp_path / x) for x in ("in", "hot", "bad", "ck"))
    os.mkdir(src)
    for k in range(2):
        with open(f"{src}/2024-01-01-00.raw", "a") as f:
            f.write("".join(x + "\n" for x in texts[k::2]) + ("" if k else "junk\n"))
        run(jobs.ingest_batches(growing.read_growing(spark, src, range_bytes=5000), hot, bad, ck, F.lit(1706745600)))
    got = lake.read_lake(spark, hot)
    assert got.count() == logs.count() and got.exceptAll(logs).isEmpty() and spark.read.parquet(bad).count() == 1


def test_hours_are_closed_and_every_line_is_read_once(spark, tmp_path):
    src, landed, ck, out = (str(tmp_path / x) for x in ("in", "landed", "ck", "out"))
    os.mkdir(src)
    hour, state = 1704844800, {"now": 1704844800 + 60, "fail": False}  # 2024-01-10 00:00

    def batch(name, *rows):
        with open(f"{src}/{name}", "w") as f:
            f.write("".join(f"{at} {text}\n" for at, text in rows))

    def land():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
        parts = lines.select(F.split("value", " ", 2).alias("p")).select(F.col("p")[1].alias("value"), F.timestamp_seconds(F.col("p")[0].cast("long")).alias("arrived"))
        q = jobs.land(parts, landed, ck, clock=clock).trigger(availableNow=True).start()
        try:
            q.awaitTermination(100)
        except StreamingQueryException as e:
            return e
        return q.exception()

    def clock():
        return state["now"]

    def closed():
        return sorted(n for n in os.listdir(landed) if n.endswith(".raw"))

    def read():
        run(jobs.read_lines(spark, landed).select("value").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck + "2"))
        return sorted(r["value"] for r in spark.read.schema("value string").parquet(out).collect())

    batch("1", (hour + 5, "a"), (hour + 6, "b"))
    assert land() is None and closed() == []
    state["now"] = hour + 3700
    batch("2", (hour + 3590, "c"), (hour + 3650, "d"))
    real = lake.drop
    try:  # the batch closes its hour, then fails before it is committed
        lake.drop = lambda s, p: (_ for _ in ()).throw(OSError("lost"))
        assert land() is not None
    finally:
        lake.drop = real
    assert land() is None
    assert all(n.startswith("2024-01-10-00.b") for n in closed()) and len(closed()) >= 2
    assert read() == ["a", "b", "c"]
    assert jobs.close_hours(spark, landed, hour + 7200) == 1 and jobs.close_hours(spark, landed, hour + 7200) == 0
    assert read() == ["a", "b", "c", "d"]
    assert [net.finalised(x, 3600.0) for x in ("1970-01-01-00", "1970-01-01-01", "x")] == [True, False, False]


def test_watchdog_alerts_once_a_day(spark, tmp_path):
    path, progress, alerts = tmp_path / "in", str(tmp_path / "progress"), str(tmp_path / "alerts")
    path.mkdir()
    (path / "a.txt").write_text("x y\n")
    log = jobs.ProgressLog(spark, progress)
    spark.streams.addListener(log)
    try:
        lines = spark.readStream.text(str(path)).select(F.lit(True).alias("ok"), F.lit(77).alias("ts"))
        q = jobs.observed(lines).writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        for _ in range(50):
            if not jobs.read_progress(spark, progress).isEmpty():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = jobs.read_progress(spark, progress).where("source = 'watched'").collect()
    assert sum(r["rows"] for r in rows) == 1 and '"newest": 77' in rows[0]["metrics"] and '"rejected": 0' in rows[0]["metrics"]
    seen, waiting = jobs.read_progress(spark, progress), spark.createDataFrame([("watched", 3 << 30, False)], "source string, size long, done boolean")
    now = rows[0]["ts"]
    assert jobs.watchdog(spark, seen, waiting.where("done"), alerts, now + 10) == 0 and not vs.versioned(spark, alerts)
    stalled = now + 90_000
    for _ in range(2):
        assert jobs.watchdog(spark, seen, waiting, alerts, stalled) == 1
    got = vs.read(spark, alerts, ALERTS).collect()
    assert len(got) == 1 and got[0]["category"] == "watchdog_stream" and got[0]["size_bytes"] == 3 << 30
    assert "no progress" in got[0]["analysis"] and "3.00 GB" in got[0]["analysis"] and not got[0]["acknowledged"]
    jobs.watchdog(spark, seen, waiting, alerts, stalled + 86_400)
    assert sorted(r["id"] for r in vs.read(spark, alerts, ALERTS).collect()) == [1, 2]
    assert vs.numbers(spark, alerts) == [1, 2]


def test_old_files_are_deleted(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    os.utime(tmp_path / "a", (1000, 1000))
    files = jobs.processed_files(spark, str(tmp_path))
    assert {os.path.basename(r["path"]) for r in files.collect()} == {"a", "b"}
    files = files.unionByName(spark.createDataFrame([(f"file:{tmp_path}/gone", 5)], "path string, processed_at long"))
    jobs.drop_processed(files, 1000 + 7201, 2)
    assert sorted(os.listdir(tmp_path)) == ["b"] and jobs.processed_files(spark, str(tmp_path / "none")).isEmpty()


@pytest.mark.parametrize("plain", [True, False])
def test_statistics_are_refreshed_from_footers(spark, tmp_path, plain):
    from datetime import date

    logs = fx.event_logs(spark, SF).drop("event_id")
    hot, cold, stats = (str(tmp_path / x) for x in ("hot", "cold", "stats"))
    want = {str(r["day"]): r["count"] for r in logs.groupBy("day").count().collect()}
    read = lambda: {str(r["day"]): (r["log_count"], r["updated_at"]) for r in vs.read(spark, stats, lake.STATS).collect()}
    assert lake.refresh_stats(spark, hot, cold, stats, 0).number == 0
    if plain:
        lake.write_archive(logs, hot)
    else:
        vs.append(logs, hot, ("day",))
    assert lake.refresh_stats(spark, hot, cold, stats, 1).number == 1
    assert read() == {d: (n, 1) for d, n in want.items()}
    assert lake.refresh_stats(spark, hot, cold, stats, 2).number == 1  # nothing has changed
    lake.archive_days(spark, hot, cold, spark.createDataFrame([(date(2024, 1, 2),)], "day date"))
    more = logs.where("day = DATE'2024-01-07'")
    lake.write_archive(more, hot, mode="append") if plain else vs.append(more, hot, ("day",))
    lake.refresh_stats(spark, hot, cold, stats, 3)
    want["2024-01-07"] *= 2
    assert read() == {d: (n, 3 if d in ("2024-01-02", "2024-01-07") else 1) for d, n in want.items()}


def test_counts_read_no_rows(spark, tmp_path):
    logs = fx.event_logs(spark, SF).drop("event_id")
    path = str(tmp_path / "lake")
    vs.append(logs, path, ("day",))
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        paths = [f"{path}/{p}" for p in vs.snapshot(spark, path).parts]
        counts = spark.read.schema("ts long, day date, part string").option("basePath", path).parquet(*paths).groupBy("day", "part").agg(F.count(F.lit(1)).alias("n"))
        assert "PushedAggregation: [COUNT(*)]" in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")


def test_lines_that_span_batches_of_a_large_source(spark, tmp_path, monkeypatch):
    logs = fx.event_logs(spark, SF).drop("event_id")
    texts = [r[0] for r in logs.select(parse.render(logs, "A")).collect()]
    rng, data = random.Random(4), b""
    for x in texts:
        cut = x.index("->") + 2 + x[x.index("->") + 2 :].index(":")
        data += f"{x[:cut]}\n  {x[cut:]}\n".encode() if rng.random() < 0.4 else f"{x}\n".encode()
    src, hot, bad, pend, ck = (str(tmp_path / x) for x in ("in", "hot", "bad", "pend", "ck"))
    os.mkdir(src)
    marks = [0, *sorted(rng.sample(range(len(data)), 3)), len(data)]
    now = F.lit(1706745600)
    for a, b in zip(marks, marks[1:]):
        with open(f"{src}/a.raw", "ab") as f:
            f.write(data[a:b])
        run(jobs.ingest_growing(growing.read_growing(spark, src, range_bytes=4000), hot, bad, pend, ck, now))
    assert lake.read_lake(spark, hot).count() == logs.count() - 1 and len(lake.folders(spark, pend)) <= 2
    jobs.flush_pending(spark, hot, bad, pend, ck, now)
    got = lake.read_lake(spark, hot)
    assert got.count() == logs.count() and got.exceptAll(logs).isEmpty() and spark.read.parquet(bad).isEmpty()

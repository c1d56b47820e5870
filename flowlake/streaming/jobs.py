"""Streaming jobs: landing, ingest, line reassembly, running registry, live counts, freshness."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions import net
from ..operators import parse, registry
from ..schemas import ALERTS, AUDIT, LOG_COLUMNS, PROGRESS, REGISTRY
from ..sources import lake, versions

TRIGGER, FILES_PER_BATCH = "2 seconds", 64


def land(lines: DataFrame, path: str, checkpoint: str, clock: Callable[[], float] = time.time) -> DataStreamWriter:
    """A stream of ``(value, arrived)`` lands as text files by arrival hour; hours that have passed are closed as ``*.raw``.

    Open files lie in ``_open``, which readers pass over. A batch that is run again after a failure writes its open
    hours anew and leaves those that it has closed before.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        closed = {hour for hour, n in _closed(spark, path) if n == number}
        rows = batch.select("value", F.date_format("arrived", "yyyy-MM-dd-HH").alias("hour")).where(~F.col("hour").isin(*closed) if closed else F.lit(True))
        rows.write.mode("overwrite").partitionBy("hour").text(f"{path}/_open/batch={number}")
        close_hours(spark, path, clock())

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _closed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(hour, batch) of what is closed, or is being closed."""
    names = lake.names(spark, path) + lake.names(spark, f"{path}/_closing")
    return [(m[1], int(m[2])) for n in names if (m := re.match(r"(\d{4}-\d{2}-\d{2}-\d{2})\.b(\d+)(?:-\d+\.raw)?$", n))]


def close_hours(spark: SparkSession, path: str, now: float) -> int:
    """Gives the files of all hours that ended before ``now`` (epoch seconds, UTC hours) their names ``HOUR.bBATCH-PART.raw``.

    An hour's folder of a batch is moved away in one step, then its files one by one; a run that breaks off
    is taken up by the next one. Returns the number of files closed.
    """
    n = 0
    for batch in lake.folders(spark, f"{path}/_open"):
        for hour in lake.folders(spark, f"{path}/_open/{batch}"):
            name = hour.removeprefix("hour=")
            if net.finalised(name, now):
                lake.move(spark, f"{path}/_open/{batch}/{hour}", f"{path}/_closing/{name}.b{int(batch.removeprefix('batch=')):08d}")
    for folder in lake.folders(spark, f"{path}/_closing"):
        for file in lake.names(spark, f"{path}/_closing/{folder}"):
            if m := re.match(r"part-(\d+)", file):
                lake.move(spark, f"{path}/_closing/{folder}/{file}", f"{path}/{folder}-{m[1]}.raw")
                n += 1
        lake.drop(spark, f"{path}/_closing/{folder}")
    return n


def read_lines(spark: SparkSession, path: str, pattern: str = "*.raw", archive: str | None = None) -> DataFrame:
    """``(file, block, value)`` of closed raw files as they appear; finished files move to ``archive`` if given.

    The checkpoint of the query that uses it remembers the files that were read.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", FILES_PER_BATCH).option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


class Reassembler(StatefulProcessor):
    """Keeps a source's pending line across batches, so that a continuation joins it whenever it comes.

    State is one line a source. A timer emits a line that nothing follows.
    """

    def __init__(self, wait_ms: int = 5_000):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "line string")

    def _rows(self, source: str, lines: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"source": [source] * len(lines), "line": lines})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import re

        held = self.pending.get()[0] if self.pending.exists() else ""
        for given in self._in_order(rows):
            out = []
            for value in given["value"]:
                value = value.rstrip("\r\n")
                if held and re.match(parse.CONTINUATION, value):
                    held += value.lstrip()
                else:
                    if held:
                        out.append(held)
                    held = value
            if out:
                yield self._rows(key[0], out)
        self.pending.update((held,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A source's lines by (block, line_no), as chunks; a chunk is passed on as soon as the next one begins behind it.

        Only chunks that overlap are held together, and ``reassemble`` sorts them beforehand.
        """
        held = None
        for chunk in rows:
            chunk = chunk.sort_values(["block", "line_no"])
            if held is None:
                held = chunk
            elif tuple(held[["block", "line_no"]].iloc[-1]) <= tuple(chunk[["block", "line_no"]].iloc[0]):
                yield held
                held = chunk
            else:
                held = pd.concat([held, chunk]).sort_values(["block", "line_no"])
        if held is not None:
            yield held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.pending.get()[0] if self.pending.exists() else ""
        self.pending.clear()
        if held:
            yield self._rows(key[0], [held])

    def close(self) -> None:
        pass


def reassemble(lines: DataFrame, wait_ms: int = 5_000) -> DataFrame:
    """``(source, line)`` from a stream of ``(source, block, line_no, value)``. Needs the RocksDB state store."""
    return lines.groupBy("source").transformWithStateInPandas(
        Reassembler(wait_ms), outputStructType="source string, line string", outputMode="append", timeMode="processingTime"
    )


def parsed_rows(lines: DataFrame, now: Column) -> DataFrame:
    """Log rows of a stream of whole lines: the same projection as the batch parser's."""
    return parse.accepted(parse.parse(lines, now))


def ingest(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends log rows to the day of their own time, however late; no watermark drops any.

    Each batch is a version of the lake, so days can be compacted and archived beside the stream. A batch that
    is run again after a failure adds nothing: the version remembers the stream's last batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        versions.append(batch.select(*LOG_COLUMNS), path, ("day",), stream=checkpoint, batch=number)

    return rows.writeStream.foreachBatch(run).trigger(processingTime=TRIGGER).option("checkpointLocation", checkpoint)


def ingest_batches(lines: DataFrame, path: str, quarantine: str, checkpoint: str, now: Column) -> DataStreamWriter:
    """Files of lines to rows and rejects, one parse a batch. Rows go to the lake as in ``ingest``.

    A batch's rejects are written under its number and overwrite only that, so a batch that is run again
    leaves nothing twice. Lines come as ``(file, block, value)``, with their place in the block as ``line`` if known.
    """

    def run(batch: DataFrame, number: int) -> None:
        line = F.col("line") if "line" in batch.columns else F.monotonically_increasing_id()
        joined = parse.join_continuations(batch.select("file", F.struct("block", line.alias("line")).alias("pos"), "value"))
        _take(joined, path, quarantine, checkpoint, number, now)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


PENDING = "file string, block long, line long, value string"


def ingest_growing(lines: DataFrame, path: str, quarantine: str, pending: str, checkpoint: str, now: Column) -> DataStreamWriter:
    """Like ``ingest_batches`` for a stream of ``growing.read_growing``; a line is put together however many batches it spans.

    Each file's last line waits in ``pending`` (its raw lines, by batch) until another line follows it: only these are
    handed from batch to batch, so however large a source is, a batch's ranges of it are tasks of their own. A batch
    that is run again takes up the same pending lines. ``flush_pending`` adds those that nothing follows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _batches(spark, pending) if n < number]
        rows = batch.select("file", "block", "line", "value")
        if before:
            rows = rows.unionByName(spark.read.schema(PENDING).parquet(f"{pending}/batch={max(before)}"))
        rows, raw = lake.table(rows, "lines")
        joined, whole = lake.table(parse.join_continuations(rows.select("file", F.struct("block", "line").alias("pos"), "value")), "joined")
        last = joined.groupBy("file").agg(F.max("pos").alias("last"))  # one row a file
        waiting = rows.join(last, "file").where(F.struct("block", "line") >= F.col("last")).select("file", "block", "line", "value")
        waiting.write.mode("overwrite").parquet(f"{pending}/batch={number}")
        _take(joined.join(last, "file").where(F.col("pos") < F.col("last")).drop("last"), path, quarantine, checkpoint, number, now)
        lake.drop(spark, raw), lake.drop(spark, whole)
        for n in before[:-1]:
            lake.drop(spark, f"{pending}/batch={n}")

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in lake.folders(spark, path) if n.startswith("batch="))


def _take(joined: DataFrame, path: str, quarantine: str, stream: str, number: int, now: Column) -> None:
    """Parses whole lines once; rows become a version of the lake, rejects a folder of the batch."""
    parsed, scratch = lake.table(parse.parse(joined, now), "parsed")
    versions.append(parse.accepted(parsed), path, ("day",), stream=stream, batch=number)
    parse.rejected(parsed, "file", "line").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
    lake.drop(joined.sparkSession, scratch)


def flush_pending(spark: SparkSession, path: str, quarantine: str, pending: str, checkpoint: str, now: Column) -> None:
    """Takes in the lines that wait, when a stream has stopped for good: nothing will continue them."""
    if found := _batches(spark, pending):
        rows = spark.read.schema(PENDING).parquet(f"{pending}/batch={found[-1]}")
        _take(parse.join_continuations(rows.select("file", F.struct("block", "line").alias("pos"), "value")), path, quarantine, checkpoint, found[-1] + 1, now)
        for n in found:
            lake.drop(spark, f"{pending}/batch={n}")


def running_registry(rows: DataFrame, path: str, checkpoint: str, every: int = 64) -> DataStreamWriter:
    """Registry counters kept up to date: each batch writes what it adds, and every ``every`` batches all is merged.

    ``delta=N`` is batch N's own counts, ``total=N`` those of all batches up to N; ``read_registry`` adds
    them up. A batch that is run again overwrites its own files only and merges from the same ones as
    before, so nothing counts twice: what a total holds is dropped when the next total is written.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        registry.dim_ip(batch).write.mode("overwrite").parquet(f"{path}/delta={number}")
        if number and number % every == 0:
            last = number - every
            read_registry(spark, path, last, number).write.mode("overwrite").parquet(f"{path}/total={number}")
            names = lake.folders(spark, path)
            if f"total={last}" in names:
                for kind, _, n in (name.partition("=") for name in names):
                    if (kind == "delta" and int(n) <= last) or (kind == "total" and int(n) < last):
                        lake.drop(spark, f"{path}/{kind}={n}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_registry(spark: SparkSession, path: str, total: int | None = None, last: int | None = None) -> DataFrame:
    """``(ip, total_hits, first_seen, last_seen)`` of a running registry: a merged table and the batches after it."""
    found = [(k, int(n)) for k, _, n in (name.partition("=") for name in lake.folders(spark, path)) if k in ("delta", "total")]
    if total is None:
        total = max((n for k, n in found if k == "total"), default=None)
    base = total if ("total", total) in found else -1  # before the first merge there are batches only
    use = [f"{path}/{k}={n}" for k, n in found if (k == "total" and n == base) or (k == "delta" and n > base and (last is None or n <= last))]
    rows = spark.read.schema(REGISTRY).parquet(*use)
    return rows.groupBy("ip").agg(F.sum("total_hits").alias("total_hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def running_dicts(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stored dictionary that takes up each batch's new names. Ids never change, however late rows come, so a batch can be run again."""

    def run(batch: DataFrame, number: int) -> None:
        registry.store_dicts(batch.sparkSession, path, batch)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def live_counts(rows: DataFrame) -> DataFrame:
    """Rows by day, for an update or complete sink."""
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("log_count"))


def hourly_volume(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows by hour of their own time; an hour closes when the watermark has passed it."""
    timed = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("hour"), "n")


def audit_feed(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataStreamWriter:
    """A feed of audit events as JSON lines, appended to a table by day."""
    events = spark.readStream.schema(AUDIT).json(path).withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    return events.writeStream.format("parquet").partitionBy("day").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def freshness(last_seen: DataFrame, files: DataFrame, now: int, max_age: int = 3600, max_backlog: int = 2 << 30) -> DataFrame:
    """Alerts ``(source, kind, value)``: sources without progress, and sources with too large a backlog.

    ``last_seen(source, ts)`` and ``files(source, size, done)``; at most one alert a source and kind.
    """
    late = last_seen.groupBy("source").agg((F.lit(now) - F.max("ts")).cast("long").alias("value")).where(F.col("value") > max_age)
    waiting = files.where("not done").groupBy("source").agg(F.sum("size").cast("long").alias("value")).where(F.col("value") > max_backlog)
    return late.select("source", F.lit("stalled").alias("kind"), "value").unionByName(waiting.select("source", F.lit("backlog").alias("kind"), "value"))


def processed_files_to_drop(files: DataFrame, now: int, hours: int) -> DataFrame:
    """Processed raw files ``(path, processed_at)`` that are past their time."""
    return files.where(F.col("processed_at").isNotNull() & (F.lit(now) - F.col("processed_at") > hours * 3600))


def processed_files(spark: SparkSession, archive: str) -> DataFrame:
    """``(path, processed_at)`` of the files that ``read_lines`` has moved to its archive; none is opened."""
    if not lake.names(spark, archive):
        return spark.createDataFrame([], "path string, processed_at long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archive)
    return files.select("path", F.unix_seconds("modificationTime").alias("processed_at"))


def drop_processed(files: DataFrame, now: int, hours: int) -> None:
    """Deletes processed raw files that are past their time, in tasks. Files that are gone already don't matter."""

    def delete(rows) -> None:
        from pyarrow import fs

        for r in rows:
            system, path = fs.FileSystem.from_uri(r["path"])
            try:
                system.delete_file(path)
            except FileNotFoundError:
                pass

    processed_files_to_drop(files, now, hours).foreachPartition(delete)


class ProgressLog(StreamingQueryListener):
    """Writes a row for each batch of each named query below ``path``: a small file named by query and batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp())
        metrics = {k: {c: v for c, v in r.asDict().items()} for k, r in (p.observedMetrics or {}).items()}
        row = {"source": p.name or str(p.id), "batch": p.batchId, "ts": seconds, "rows": p.numInputRows, "metrics": json.dumps(metrics, default=str)}
        lake.put_text(self.spark, f"{self.path}/{row['source']}-{p.batchId:012d}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(parsed: DataFrame, name: str = "lines") -> DataFrame:
    """Counts the lines of a stream, those rejected, and the newest time, as metrics of its progress."""
    return parsed.observe(name, F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("rejected"), F.max("ts").alias("newest"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``(source, batch, ts, rows, metrics)`` of a ``ProgressLog``; metrics is JSON."""
    return spark.read.schema(PROGRESS).json(path) if lake.names(spark, path) else spark.createDataFrame([], PROGRESS)


def watchdog(spark: SparkSession, progress: DataFrame, files: DataFrame, alerts: str, now: int, max_age: int = 3600, max_backlog: int = 2 << 30) -> int:
    """Stores at most one alert a day of ``freshness`` in the table ``alerts``; returns the number of sources with one now.

    A batch that read no rows is no progress. All sources' findings of the run make one alert, with the backlog's bytes.
    A day that has an alert, of this or another kind, gets no more.
    """
    found = freshness(progress.where("rows > 0").select("source", "ts"), files, now, max_age, max_backlog).orderBy("source", "kind").collect()  # a few rows a source
    if not found:
        return 0
    day = datetime.fromtimestamp(now, timezone.utc).date()
    said = [f"{r['source']}: no progress for {r['value']} s" if r["kind"] == "stalled" else f"{r['source']}: {r['value'] / 2**30:.2f} GB waiting" for r in found]
    backlog = sum(r["value"] for r in found if r["kind"] == "backlog")
    details = json.dumps({"issues": said, "checked_at": now})

    def add(s: versions.Snapshot) -> versions.Snapshot | None:
        have = versions.read(spark, alerts, ALERTS, s)
        if not have.where(F.col("day") == F.lit(day)).isEmpty():
            return None
        last = have.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
        row = (last + 1, day, 0, backlog, 0.0, "watchdog_stream", "; ".join(said), details, False, None, None)
        return versions.Snapshot(0, s.parts + versions.write_part(spark.createDataFrame([row], ALERTS), alerts), s.batches)

    versions.commit(spark, alerts, add)
    return len({r["source"] for r in found})


#: Compaction beside running streams.
compact = lake.compact

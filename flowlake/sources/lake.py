"""The log lake: day partitions, their catalog and lifecycle, daily statistics."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONN_LOGS, LOG_COLUMNS, SIDECAR, STATS
from . import versions


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/flowlake-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/flowlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe against lost executors."""
    return table(df, name)[0]


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the table's path, for ``drop``."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written_together(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """``written`` for several frames by name, as jobs at the same time: the cores that one job's last tasks leave idle do another's."""
    paths = {name: scratch(df.sparkSession, name) for name, df in frames.items()}
    session = next(iter(frames.values())).sparkSession
    write = inheritable_thread_target(session)(lambda name: frames[name].write.option("compression", "zstd").parquet(paths[name]))
    with ThreadPoolExecutor(len(frames)) as pool:
        list(pool.map(write, frames))
    return [df.sparkSession.read.schema(df.schema).parquet(paths[name]) for name, df in frames.items()]


#: How days are written for good.
ARCHIVE = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.block.size": str(32 << 20), "parquet.bloom.filter.enabled#nat_ip": "true",
}
SORT = ("ts", "src_ip")


def ranged(logs: DataFrame, files: int | None = None) -> DataFrame:
    """Rows ranged by (day, ts), so a large day has several files with narrow minima and maxima; days are never one task."""
    n = files or int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return logs.select(*LOG_COLUMNS).repartitionByRange(n, "day", "ts")


def write_archive(logs: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Day partitions sorted by (ts, src_ip), zstd level 6, with a bloom filter on nat_ip."""
    rows = ranged(logs, files).sortWithinPartitions("day", *SORT).write.mode(mode).partitionBy("day")
    rows.options(**ARCHIVE).option("partitionOverwriteMode", "dynamic").parquet(path)  # overwriting replaces whole days, no others


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a lake, of its newest version if it has versions."""
    if versions.versioned(spark, path):
        return versions.read(spark, path, CONN_LOGS)
    return spark.read.schema(CONN_LOGS).parquet(path).select(*LOG_COLUMNS)


def day_of(part: str) -> str:
    return part.split("/", 1)[0].removeprefix("day=")


#: A cold tier's version names the hot tier's parts that it has taken over, so they count once whenever a move breaks off.
TAKEN = "from "


def taken(cold: versions.Snapshot) -> set[str]:
    return {k.removeprefix(TAKEN) for k in cold.batches if k.startswith(TAKEN)}


def read_tiers(spark: SparkSession, hot: str, cold: str) -> DataFrame:
    """The rows of both tiers of a lake with versions, each once, while days are moved and late rows come in."""
    h = versions.snapshot(spark, hot)  # before the cold one: what leaves hot is in cold already
    c = versions.snapshot(spark, cold)
    gone = taken(c)
    return versions.read(spark, hot, CONN_LOGS, h, lambda p: p not in gone).unionByName(versions.read(spark, cold, CONN_LOGS, c))


def scan_day(logs: DataFrame, day: str) -> DataFrame:
    return logs.where(F.col("day") == F.to_date(F.lit(day)))


def scan_range(logs: DataFrame, first: str, last: str) -> DataFrame:
    return logs.where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def new_days(incoming: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows of days that the lake doesn't have, or all of them when overwriting."""
    return incoming if overwrite else incoming.join(existing.select("day").distinct(), "day", "left_anti").select(*incoming.columns)


def import_days(incoming: DataFrame, path: str, overwrite: bool = False) -> None:
    """Idempotent import: known days are skipped, or replaced as whole partitions.

    A lake with versions gets one new version.
    """
    spark = incoming.sparkSession
    if versions.versioned(spark, path):
        base = versions.snapshot(spark, path)
        rows = new_days(incoming, versions.read(spark, path, CONN_LOGS, base), overwrite)
        days = {r["d"] for r in rows.select(F.col("day").cast("string").alias("d")).distinct().collect()} if overwrite else set()  # one entry a day
        versions.replace(ranged(rows), path, tuple(p for p in base.parts if day_of(p) in days), ("day",), SORT, **ARCHIVE)
        return
    rows = incoming
    if _exists(spark, path):
        rows = new_days(incoming, read_lake(spark, path), overwrite)
    write_archive(rows, path, mode="overwrite" if overwrite else "append")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if there is no such folder."""
    if not _exists(spark, path):
        return []
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder, with the folders above its new name; a name that is taken is an error."""
    (fs, a), (_, b) = _fs(spark, old), _fs(spark, new)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise OSError(f"{old} could not be moved to {new}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in place of one that has its name."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def drop(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def drop_days(spark: SparkSession, path: str, days: DataFrame) -> int:
    """Deletes the partitions of ``days(day)``, or publishes a version without them; one entry a day reaches the driver."""
    n = 0
    if versions.versioned(spark, path):
        gone = {r["d"] for r in days.select(F.col("day").cast("string").alias("d")).distinct().collect()} & set(days_in(spark, path))
        versions.commit(spark, path, lambda s: versions.Snapshot(0, tuple(p for p in s.parts if day_of(p) not in gone), s.batches))
        return len(gone)
    for r in days.select(F.col("day").cast("string").alias("d")).distinct().collect():
        n += drop(spark, f"{path}/day={r['d']}")
    return n


def days_in(spark: SparkSession, path: str) -> list[str]:
    """The day partitions of a tier, from its newest version or its folder; a tier that doesn't exist has none."""
    if versions.versioned(spark, path):
        return sorted({day_of(p) for p in versions.snapshot(spark, path).parts})
    return [name[4:] for name in folders(spark, path) if name.startswith("day=")]


def find_day(spark: SparkSession, hot: str, cold: str, day: str) -> str | None:
    """The tier's path that holds a day, the hot one first; None for a day that neither has."""
    return next((p for p in (hot, cold) if day in days_in(spark, p)), None)


def archive_days(spark: SparkSession, hot: str, cold: str, days: DataFrame) -> None:
    """Moves hot days to the cold tier in one job: rewritten beside it, then renamed; cold days that exist are kept.

    Days that hot doesn't have are passed over. A run that was broken off is repeated as it is: what is
    cold already is only dropped from hot. Where hot has versions, cold gets them too, and a cold day takes late rows.
    """
    if versions.versioned(spark, hot):
        _archive_parts(spark, hot, cold, days)
        return
    have, done = set(days_in(spark, hot)), set(days_in(spark, cold))
    every = [r["d"] for r in days.select(F.col("day").cast("string").alias("d")).distinct().collect() if r["d"] in have]  # one entry a day
    if todo := [d for d in every if d not in done]:
        stage = f"{cold}.stage-{uuid.uuid4().hex}"
        write_archive(read_lake(spark, hot).where(F.col("day").cast("string").isin(todo)), stage)
        fs, root = _fs(spark, cold)
        fs.mkdirs(root)
        for day in days_in(spark, stage):
            if not fs.rename(_fs(spark, f"{stage}/day={day}")[1], _fs(spark, f"{cold}/day={day}")[1]):
                raise OSError(f"{cold}/day={day} could not be put in place")
        fs.delete(_fs(spark, stage)[1], True)
    for day in every:
        drop(spark, f"{hot}/day={day}")


def _archive_parts(spark: SparkSession, hot: str, cold: str, days: DataFrame) -> None:
    """Parts of hot days become one part of the cold tier; two versions, of which readers see the first or both."""
    versions.adopt(spark, cold)
    wanted = {r["d"] for r in days.select(F.col("day").cast("string").alias("d")).distinct().collect()}  # one entry a day
    base = versions.snapshot(spark, hot)
    parts = {p for p in base.parts if day_of(p) in wanted}
    if todo := parts - taken(versions.snapshot(spark, cold)):
        new = versions.write_part(ranged(versions.read(spark, hot, CONN_LOGS, base, todo.__contains__)), cold, ("day",), SORT, **ARCHIVE)

        def take(s: versions.Snapshot) -> versions.Snapshot:
            if taken(s) & todo:
                raise versions.Conflict(f"{cold}: another run moves the same days")
            keep = {k: v for k, v in s.batches.items() if not k.startswith(TAKEN) or k.removeprefix(TAKEN) in base.parts}
            return versions.Snapshot(0, s.parts + new, keep | {TAKEN + p: 1 for p in todo})

        versions.commit(spark, cold, take)
    if parts:
        versions.commit(spark, hot, lambda s: versions.Snapshot(0, tuple(p for p in s.parts if p not in parts), s.batches))


def compact(spark: SparkSession, path: str, days: list[str]) -> None:
    """Days that many small batches have filled, each as few sorted files: a new version, beside which readers and streams go on.

    Rows that are added meanwhile stay as they are. A lake without versions gets them. Old files stay until ``versions.expire``.
    """
    base, wanted = versions.adopt(spark, path), set(days)
    old = tuple(p for p in base.parts if day_of(p) in wanted)
    if old:
        versions.replace(ranged(versions.read(spark, path, CONN_LOGS, base, set(old).__contains__)), path, old, ("day",), SORT, **ARCHIVE)


CATALOG = "day date, kind string, size_bytes long, files long"


def catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(day, kind, size_bytes, files)`` of a tier, from its file listing; no file is opened. A tier that doesn't exist has no rows."""
    paths = [f"{path}/{p}" for p in versions.snapshot(spark, path).parts] if versions.versioned(spark, path) else [path] * _exists(spark, path)
    if not paths:
        return spark.createDataFrame([], CATALOG)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path", "length")
    day = F.to_date(F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1))
    return files.groupBy(day.alias("day")).agg(F.lit(kind).alias("kind"), F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("files"))


def precedence(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """All partitions; where a day is in both tiers the hot one counts."""
    return hot.unionByName(cold.join(hot.select("day"), "day", "left_anti"))


def days_older(cat: DataFrame, today: str, age: int, kind: str) -> DataFrame:
    """Partitions of a tier that are more than ``age`` days old."""
    old = F.datediff(F.to_date(F.lit(today)), F.col("day"))
    return cat.where((F.col("kind") == kind) & (old > age)).withColumn("age", old)


def days_to_archive(cat: DataFrame, today: str, age: int = 30) -> DataFrame:
    return days_older(cat, today, age, "hot")


def days_expired(cat: DataFrame, today: str, age: int = 365) -> DataFrame:
    """Cold days past retention; an age of 0 or less keeps all."""
    return days_older(cat, today, age, "cold") if age > 0 else cat.where(F.lit(False)).withColumn("age", F.lit(0))


def upsert_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily statistics ``(day, log_count, size_bytes, updated_at)``: the newest row of each day."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("day", "updated_at")]
    return both.groupBy("day").agg(F.max("updated_at").alias("updated_at"), F.max_by(F.struct(*rest), "updated_at").alias("x")).select("day", "x.*", "updated_at")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """``(day, part, size_bytes, listing)`` of a tier's part folders, from their files' names and sizes; plain day folders have a null part."""
    if versions.versioned(spark, path):
        paths = [f"{path}/{p}" for p in versions.snapshot(spark, path).parts]
    else:
        paths = [path] * _exists(spark, path)
    if not paths:
        return spark.createDataFrame([], "day date, part string, size_bytes long, listing long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path", "length")
    day = F.to_date(F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1))
    part = F.nullif(F.regexp_extract("path", r"/(day=[^/]+/part=[^/]+)/", 1), F.lit(""))
    name = F.xxhash64(F.regexp_extract("path", r"[^/]+$", 0), "length")
    return files.groupBy(day.alias("day"), part.alias("part")).agg(F.sum("length").alias("size_bytes"), F.bit_xor(name).alias("listing"))


def footer_counts(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    """``(day, part, log_count)`` of some days of a tier, written: the numbers come from the Parquet footers, no row is read."""
    if versions.versioned(spark, path):
        keys, paths = ["day", "part"], [f"{path}/{p}" for p in versions.snapshot(spark, path).parts if day_of(p) in days]
    else:
        keys, paths = ["day"], [f"{path}/day={d}" for d in days_in(spark, path) if d in days]
    if not paths:
        return spark.createDataFrame([], "day date, part string, log_count long")
    part = F.concat(F.lit("day="), F.col("day").cast("string"), F.lit("/part="), F.col("part")) if "part" in keys else F.lit(None).cast("string")
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        [spark.conf.set(k, v) for k, v in settings.items()]
        schema = "ts long, day date, part string" if "part" in keys else "ts long, day date"
        counts = spark.read.schema(schema).option("basePath", path).parquet(*paths).groupBy(*keys).agg(F.count(F.lit(1)).alias("log_count"))
        return written(counts.select("day", part.alias("part"), "log_count"), "footer-counts")
    finally:
        [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in before.items()]


def refresh_stats(spark: SparkSession, hot: str, cold: str, stats: str, now: int) -> versions.Snapshot:
    """Brings the stored daily statistics up to date with both tiers; only days whose files have changed are touched.

    Files are listed, footers of changed days are read, and rows are never. Where plain tiers both have a day, the hot one
    counts; parts that a cold tier with versions has taken over count there. Statistics of days that are gone stay.
    """
    gone = sorted(taken(versions.snapshot(spark, cold))) if versions.versioned(spark, cold) else []
    tiers = []
    for path in (hot, cold):
        files = _listing(spark, path)
        tiers.append(files.where(F.col("part").isNull() | ~F.col("part").isin(gone)) if path == hot and gone else files)
    plain = not versions.versioned(spark, hot)
    cold_files = tiers[1].join(tiers[0].select("day").distinct(), "day", "left_anti") if plain else tiers[1]
    both = tiers[0].withColumn("tier", F.lit("hot")).unionByName(cold_files.withColumn("tier", F.lit("cold")))
    days = both.groupBy("day").agg(F.sum("size_bytes").alias("size_bytes"), F.bit_xor("listing").alias("listing"), F.collect_set("tier").alias("tiers"))
    known = versions.read(spark, stats, STATS).select("day", F.col("listing").alias("old"))
    changed = days.join(known, "day", "left").where(F.col("old").isNull() | (F.col("old") != F.col("listing")))
    rows = changed.select(F.col("day").cast("string").alias("d"), "size_bytes", "listing", "tiers").collect()  # one entry a day
    if not rows:
        return versions.snapshot(spark, stats)
    wanted = {tier: [r["d"] for r in rows if tier in r["tiers"]] for tier in ("hot", "cold")}
    hot_counts = footer_counts(spark, hot, wanted["hot"])
    counts = (hot_counts.where(F.col("part").isNull() | ~F.col("part").isin(gone)) if gone else hot_counts).unionByName(footer_counts(spark, cold, wanted["cold"]))
    sizes = spark.createDataFrame([(r["d"], r["size_bytes"], r["listing"]) for r in rows], "d string, size_bytes long, listing long")
    new = sizes.join(counts.groupBy(F.col("day").cast("string").alias("d")).agg(F.sum("log_count").alias("log_count")), "d", "left").select(
        F.to_date("d").alias("day"), F.coalesce("log_count", F.lit(0).cast("long")).alias("log_count"), "size_bytes", "listing", F.lit(now).cast("long").alias("updated_at")
    )
    return versions.update(spark, stats, STATS, lambda old: upsert_stats(old, new))


def daily_overview(stats: DataFrame, cat: DataFrame, alerts: DataFrame) -> DataFrame:
    """Statistics with tier (``absent`` without a partition) and alert flag."""
    flag = alerts.select("day").distinct().withColumn("has_alert", F.lit(True))
    return (
        stats.join(cat.select("day", "kind"), "day", "left").join(flag, "day", "left")
        .select("day", "log_count", "size_bytes", F.coalesce("kind", F.lit("absent")).alias("kind"), F.coalesce("has_alert", F.lit(False)).alias("has_alert"))
    )


def calendar(stats: DataFrame, alerts: DataFrame) -> DataFrame:
    flag = alerts.select("day").distinct().withColumn("has_alert", F.lit(True))
    return stats.join(flag, "day", "left").select("day", "log_count", F.coalesce("has_alert", F.lit(False)).alias("has_alert"))


def overview_totals(overview: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return overview.agg(
        n.alias("days"), F.sum("log_count").alias("logs"), F.sum("size_bytes").alias("bytes"), F.avg("log_count").alias("mean_per_day"),
        (F.count_if(F.col("kind") == "hot") / n).alias("hot_share"), (F.count_if(F.col("kind") == "cold") / n).alias("cold_share"),
    )


def last_days(stats: DataFrame, n: int = 14) -> DataFrame:
    return stats.orderBy(F.desc("day")).limit(n)


def write_dicts(dims: DataFrame, path: str) -> None:
    """Dictionaries as a table partitioned by day."""
    dims.write.mode("overwrite").partitionBy("day").parquet(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``(day, kind, id, name)`` from ``{day}.dicts.json`` files; a folder without any gives no rows."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.dicts.json").text(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))
    kinds = rows.select(day.alias("day"), F.explode(F.from_json("value", SIDECAR)).alias("kind", "names"))
    return kinds.select("day", "kind", F.explode("names").alias("id", "name")).withColumn("id", F.col("id").cast("int"))

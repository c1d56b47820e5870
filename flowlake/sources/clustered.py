"""Days clustered along a space-filling curve, and an index of their files that a search reads first.

Rows of a day are ordered by interleaved bits of their places in time, NAT address and source address,
so a file is a small box in all three. The index has a row per file: minima, maxima, and bitmaps of
hashed addresses. A search keeps the files whose row doesn't rule it out and those that aren't indexed,
and reads these alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONN_LOGS, LOG_COLUMNS
from . import lake, versions

#: Columns of the curve, the bits of each, and columns whose values the index has as bitmaps.
CURVE, BITS = ("ts", "nat_ip", "src_ip"), 4
BOUNDED, HASHED = ("ts", "src_ip", "dst_ip", "nat_ip", "src_port", "dst_port", "nat_port"), ("src_ip", "dst_ip", "nat_ip")
#: Bits of a bitmap; Spark's own have this size.
BITMAP = 32_768

INDEX = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("rows", T.LongType())]
    + [T.StructField(f"{end}_{c}", T.LongType()) for c in BOUNDED for end in ("min", "max")]
    + [T.StructField(f"bits_{c}", T.BinaryType()) for c in HASHED]
)


def _bucket(logs: DataFrame) -> dict[str, Column]:
    """Each curve column's place among its own quantiles, BITS bits: even whatever the values are. 15 numbers a column reach the driver."""
    n = 1 << BITS
    cuts = logs.agg(*[F.percentile_approx(F.pmod(c, F.lit(86_400)) if c == "ts" else F.col(c), [k / n for k in range(1, n)], 1000) for c in CURVE]).first()
    out = {}
    for c, found in zip(CURVE, cuts):
        value = F.pmod(c, F.lit(86_400)) if c == "ts" else F.col(c)
        out[c] = reduce(lambda a, b: a + b, [F.coalesce((value > x).cast("int"), F.lit(0)) for x in found or []], F.lit(0))
    return out


def curve(logs: DataFrame) -> Column:
    """The place on the curve: the bits of the three places, interleaved from the highest."""
    places = _bucket(logs)
    bit = lambda c, k: F.shiftright(places[c], k).bitwiseAND(F.lit(1))
    z = F.lit(0)
    for k in reversed(range(BITS)):
        for c in CURVE:
            z = z * 2 + bit(c, k)
    return z


def index_path(path: str) -> str:
    return f"{path}/_index"


def indexed(spark: SparkSession, path: str) -> bool:
    return versions.versioned(spark, index_path(path))


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BITMAP))


def describe(spark: SparkSession, path: str, parts: tuple[str, ...]) -> DataFrame:
    """Index rows of the files of some parts: one partially aggregated pass."""
    rows = spark.read.schema(T.StructType([*CONN_LOGS.fields, T.StructField("part", T.StringType())])).option("basePath", path).parquet(*[f"{path}/{p}" for p in parts])
    ends = [f(F.col(c)).cast("long").alias(f"{name}_{c}") for c in BOUNDED for name, f in (("min", F.min), ("max", F.max))]
    bits = [F.bitmap_construct_agg(_bit(F.col(c))).alias(f"bits_{c}") for c in HASHED]
    file = F.regexp_extract(F.col("_metadata.file_path"), r"(day=[^/]+/part=[^/]+/[^/]+)$", 1)
    return rows.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends, *bits).select(*INDEX.fieldNames())


def cluster(spark: SparkSession, path: str, days: list[str], files: int | None = None) -> None:
    """Like ``lake.compact``, along the curve, with index rows. ``files`` for all days together; the shuffle partitions if not given.

    Rows that are added meanwhile, and later, aren't indexed until their day is clustered again; searches read them all.
    """
    base, wanted = versions.adopt(spark, path), set(days)
    old = tuple(p for p in base.parts if lake.day_of(p) in wanted)
    if not old:
        return
    rows = versions.read(spark, path, CONN_LOGS, base, set(old).__contains__)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("z", curve(rows)).repartitionByRange(n, "day", "z", "ts").sortWithinPartitions("day", "z", "ts").drop("z")
    done = versions.replace(placed, path, old, ("day",), (), **lake.ARCHIVE)
    new = tuple(p for p in done.parts if p not in base.parts and lake.day_of(p) in wanted)
    versions.append(describe(spark, path, new).coalesce(8), index_path(path))


def _may(name: str, value: int) -> Column:
    """Whether a file can hold a value of a column, by its index row."""
    inside = (F.col(f"min_{name}") <= value) & (F.col(f"max_{name}") >= value)
    if name in HASHED:
        place = _bit(F.lit(value).cast("long"))
        byte = F.conv(F.hex(F.col(f"bits_{name}").substr((F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.pow(F.lit(2), place.bitwiseAND(F.lit(7))).cast("int")
        inside = inside & (byte.bitwiseAND(bit) != 0)
    return inside


def files_for(spark: SparkSession, path: str, equal: dict[str, int], ts_from: int | None = None, ts_to: int | None = None, days: list[str] | None = None) -> tuple[list[str], int]:
    """The files that may hold matching rows, and how many the lake's newest version has (on the ``days`` given).

    ``equal`` is column -> value for columns of the index. Names of files that stay reach the driver, as those of any scan do.
    """
    s = versions.snapshot(spark, path)
    parts = [p for p in s.parts if days is None or lake.day_of(p) in days]
    if not parts:
        return [], 0
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{p}" for p in parts]).select("path")
    listed = listed.select(F.regexp_extract("path", r"(day=[^/]+/part=[^/]+/[^/]+)$", 1).alias("file"))
    may = F.lit(True)
    for name, value in equal.items():
        may = may & _may(name, value)
    if ts_from is not None:
        may = may & (F.col("max_ts") >= ts_from)
    if ts_to is not None:
        may = may & (F.col("min_ts") <= ts_to)
    index = versions.read(spark, index_path(path), INDEX).select("file", may.alias("may"))
    found = lake.written(listed.join(index, "file", "left"), "files")
    keep = found.where(F.coalesce("may", F.lit(True))).select("file").collect()
    return sorted(r["file"] for r in keep), found.count()


def search(spark: SparkSession, path: str, equal: dict[str, int], ts_from: int | None = None, ts_to: int | None = None, days: list[str] | None = None) -> DataFrame:
    """Rows with these values in this time, from the files that may hold any."""
    unknown = set(equal) - set(BOUNDED)
    if unknown:
        raise ValueError(f"not in the index: {', '.join(sorted(unknown))}")
    files, _ = files_for(spark, path, equal, ts_from, ts_to, days)
    if not files:
        return spark.createDataFrame([], CONN_LOGS)
    rows = spark.read.schema(CONN_LOGS).option("basePath", path).parquet(*[f"{path}/{f}" for f in files]).select(*LOG_COLUMNS)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    rows = rows.where(F.col("ts") >= ts_from) if ts_from is not None else rows
    return rows.where(F.col("ts") <= ts_to) if ts_to is not None else rows

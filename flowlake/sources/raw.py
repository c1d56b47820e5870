"""Raw line files: an ordered scan, and bulk imports with a summary per file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

DATE_IN_NAME = r"(\d{4}-\d{2}-\d{2})"


def read_raw(spark: SparkSession, paths: Iterable[str], pattern: str = "*.raw") -> DataFrame:
    """``(file, pos, value, name_day, file_time)`` of all lines.

    pos orders a file's lines however Spark splits it: splits by their offset, lines within by a
    rising id. Directories are expanded, a path given twice is read once, bytes that aren't
    UTF-8 are replaced. name_day is the date in the file's name, null if it has none.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(sorted(set(paths)))
    m = "_metadata."
    return lines.select(
        F.col(m + "file_path").alias("file"),
        F.struct(F.col(m + "file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("pos"),
        "value",
        F.to_date(F.nullif(F.regexp_extract(F.col(m + "file_name"), DATE_IN_NAME, 1), F.lit(""))).alias("name_day"),
        F.unix_seconds(F.col(m + "file_modification_time")).alias("file_time"),
    )


def undated(lines: DataFrame) -> DataFrame:
    """Files without a date in their name."""
    return lines.where("name_day is null").select("file").distinct()


def import_raw(lines: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(log rows, summary per file) of raw lines; ``now`` defaults to each file's modification time.

    The row's own time sets its day. Both results come from one parse; write the parsed table first
    to read the text once.
    """
    times = lines.select("file", "file_time").distinct() if "file_time" in lines.columns and now is None else None
    joined = parse.join_continuations(lines.select("file", "pos", "value"))
    if times is not None:
        joined, now = joined.join(times, "file"), F.col("file_time")
    parsed = parse.parse(joined, now)
    return parse.accepted(parsed), parse.quality(parsed)

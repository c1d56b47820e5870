"""Days whose volume departs from a trailing baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anomaly_days(
    daily: DataFrame, baseline_days: int = 7, ratio: float = 3.0, min_count: int = 100_000, by: list[str] | None = None
) -> DataFrame:
    """``(day, log_count, expected_count, ratio)`` of the days over ``ratio`` times their baseline.

    The baseline is the mean of the previous ``baseline_days`` rows (days that are present, not
    calendar days) without those of zero rows, and needs three rows at least. ``daily`` has one row
    per day (and per value of ``by``, e.g. a site), so its window holds one row per day whatever the logs' size.
    """
    w = Window.partitionBy(*(by or [])).orderBy("day").rowsBetween(-baseline_days, -1)
    d = daily.withColumn("rows_before", F.count(F.lit(1)).over(w)).withColumn(
        "expected_count", F.avg(F.when(F.col("log_count") > 0, F.col("log_count"))).over(w)
    )
    return (
        d.where((F.col("log_count") >= min_count) & (F.col("rows_before") >= 3) & (F.col("expected_count") >= min_count / 10))
        .withColumn("ratio", F.col("log_count") / F.col("expected_count"))
        .where(F.col("ratio") >= ratio)
        .select(*(by or []), "day", "log_count", "expected_count", "ratio")
    )


def new_only(candidates: DataFrame, alerts: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Candidates whose day has a partition and, unless forced, no alert yet."""
    here = candidates.join(catalog.select("day").distinct(), "day", "left_semi")
    return here if force else here.join(alerts.select("day").distinct(), "day", "left_anti")


def forced_day(daily: DataFrame, day: str) -> DataFrame:
    """A single day as a candidate: expected is its own count, the ratio 1."""
    return daily.where(F.col("day") == F.to_date(F.lit(day))).select(
        "day", "log_count", F.col("log_count").cast("double").alias("expected_count"), F.lit(1.0).alias("ratio")
    )

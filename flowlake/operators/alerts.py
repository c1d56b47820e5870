"""Alert and audit tables: upserts as new versions, acknowledgements, lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import versions


def upsert_by_day(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same day; of several new rows of a day the one with the largest id wins.

    A replaced alert is unacknowledged again: the new row comes as it is.
    """
    columns = old.columns
    best = new.groupBy("day").agg(F.max_by(F.struct(*[c for c in columns if c != "day"]), "id").alias("x")).select("day", "x.*").select(*columns)
    return old.join(best.select("day"), "day", "left_anti").select(*columns).unionByName(best)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Applies ``acks(alert_id, username, ts)``: the earliest of each alert, on alerts that aren't acknowledged yet."""
    first = acks.groupBy(F.col("alert_id").alias("id")).agg(F.min(F.struct("ts", "username")).alias("a"))
    hit = ~F.col("acknowledged") & F.col("a").isNotNull()
    return alerts.join(first, "id", "left").withColumns(
        {
            "acknowledged_by": F.when(hit, F.col("a.username")).otherwise(F.col("acknowledged_by")),
            "acknowledged_at": F.when(hit, F.col("a.ts")).otherwise(F.col("acknowledged_at")),
            "acknowledged": F.col("acknowledged") | hit,
        }
    ).drop("a")


def store_upsert(path: str, new: DataFrame, schema: StructType) -> versions.Snapshot:
    """``upsert_by_day`` on a stored table: a new version, and nothing that another writer stores meanwhile is lost."""
    return versions.update(new.sparkSession, path, schema, lambda old: upsert_by_day(old, new))


def store_acknowledge(path: str, acks: DataFrame, schema: StructType) -> versions.Snapshot:
    """``acknowledge`` on a stored table."""
    return versions.update(acks.sparkSession, path, schema, lambda old: acknowledge(old, acks))


def listed(alerts: DataFrame, only_open: bool = False, limit: int = 200) -> DataFrame:
    """Alerts, newest day first."""
    return (alerts.where("not acknowledged") if only_open else alerts).orderBy(F.desc("day"), F.desc("id")).limit(limit)


def by_key(alerts: DataFrame, alert_id: int | None = None, day: str | None = None) -> DataFrame:
    return alerts.where(F.col("id") == alert_id) if alert_id is not None else alerts.where(F.col("day") == F.to_date(F.lit(day)))


def open_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged")).alias("open_alerts"))


def audit_filtered(audit: DataFrame, username: str | None = None, action: str | None = None) -> DataFrame:
    for column, value in (("username", username), ("action", action)):
        audit = audit.where(F.col(column) == value) if value is not None else audit
    return audit


def audit_page(audit: DataFrame, page: int = 1, size: int = 200) -> DataFrame:
    """Newest first."""
    return audit.orderBy(F.desc("ts"), F.desc("id")).offset((page - 1) * size).limit(size)


def audit_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct().orderBy("action")


def bruteforce(audit: DataFrame, now: int, seconds: int = 86_400) -> DataFrame:
    """Failed logins per client address in the time before ``now``, with the number of distinct users."""
    recent = audit.where((F.col("action") == "login_failed") & (F.col("ts") > now - seconds) & (F.col("ts") <= now))
    pairs = recent.groupBy("ip_address", "username").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("ip_address").agg(F.sum("n").alias("failures"), F.count("username").alias("users"))


def user_actions(audit: DataFrame, now: int, days: int = 180, limit: int = 30) -> DataFrame:
    recent = audit.where((F.col("ts") > now - days * 86_400) & (F.col("ts") <= now))
    counts = recent.groupBy("username", "action").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "username", "action").limit(limit)


def user_recent(audit: DataFrame, username: str, now: int, days: int = 7) -> DataFrame:
    return audit.where((F.col("username") == username) & (F.col("ts") > now - days * 86_400) & (F.col("ts") <= now))


def last_of(audit: DataFrame, action: str, limit: int = 50) -> DataFrame:
    return audit_page(audit_filtered(audit, action=action), 1, limit)

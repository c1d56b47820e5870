"""Lake lifecycle, daily statistics, alerts, audit and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import anomaly
from ..schemas import CONN_LOGS, STATS
from ..sources import lake, versions
from ..streaming import jobs
from . import fixtures as fx
from .fixtures import AUDIT_SQL, EVENT_SQL, LOGS
from .profile_queries import DAILY_SQL, anomaly_sql, event_daily
from .registered import query

TODAY = "2024-02-15"
NOW = 1706659200  # 2024-01-31 00:00:00


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev")
def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = lake.scratch(spark, "archive")
    lake.write_archive(fx.event_logs(spark, sf), path)
    return lake.read_lake(spark, path)


@query(f"WITH {EVENT_SQL} SELECT day, count(*) AS n, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM ev GROUP BY day")
def import_new_days(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the days are there already; importing all of them again must not double those."""
    path, logs = lake.scratch(spark, "lake"), fx.event_logs(spark, sf).drop("event_id")
    lake.import_days(lake.scan_range(logs, "2024-01-01", "2024-01-15"), path)
    lake.import_days(logs, path)
    return lake.read_lake(spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("pkt_len").alias("bytes"))


def _tier(spark: SparkSession, sf: str, kind: str, first: str, last: str, factor: int) -> DataFrame:
    d = event_daily(spark, sf).where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return d.select("day", F.lit(kind).alias("kind"), (F.col("log_count") * factor).alias("size_bytes"), F.lit(1).cast("long").alias("files"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return lake.precedence(_tier(spark, sf, "hot", "2024-01-15", "2024-01-28", 16), _tier(spark, sf, "cold", "2024-01-01", "2024-01-20", 9))


CATALOG_SQL = """ct AS (SELECT day, CASE WHEN day >= DATE '2024-01-15' THEN 'hot' ELSE 'cold' END AS kind,
  log_count * CASE WHEN day >= DATE '2024-01-15' THEN 16 ELSE 9 END AS size_bytes, CAST(1 AS BIGINT) AS files FROM dc WHERE day <= DATE '2024-01-28')"""


@query(f"WITH {EVENT_SQL}, {DAILY_SQL}, {CATALOG_SQL} SELECT * FROM ct")
def catalog_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf)


def _old(kind: str, age: int) -> str:
    return f"WITH {EVENT_SQL}, {DAILY_SQL}, {CATALOG_SQL} SELECT *, CAST(DATE '{TODAY}' - day AS INTEGER) AS age FROM ct WHERE kind = '{kind}' AND DATE '{TODAY}' - day > {age}"


@query(_old("hot", 25))
def days_to_archive(spark: SparkSession, sf: str) -> DataFrame:
    return lake.days_to_archive(_catalog(spark, sf), TODAY, 25)


@query(_old("cold", 40))
def days_expired(spark: SparkSession, sf: str) -> DataFrame:
    return lake.days_expired(_catalog(spark, sf), TODAY, 40)


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    d = event_daily(spark, sf)
    old = d.where("day <= DATE'2024-01-20'").select("day", (F.col("log_count") - 5).alias("log_count"), (F.col("log_count") * 8).alias("size_bytes"), F.lit(1).cast("long").alias("updated_at"))
    new = d.where("day >= DATE'2024-01-10'").select("day", "log_count", (F.col("log_count") * 9).alias("size_bytes"), F.lit(2).cast("long").alias("updated_at"))
    return lake.upsert_stats(old, new)


STATS_SQL = """st AS (SELECT day, CASE WHEN day < DATE '2024-01-10' THEN log_count - 5 ELSE log_count END AS log_count,
  log_count * CASE WHEN day < DATE '2024-01-10' THEN 8 ELSE 9 END AS size_bytes, CAST(CASE WHEN day < DATE '2024-01-10' THEN 1 ELSE 2 END AS BIGINT) AS updated_at FROM dc)"""
ALERT_SQL = f"{anomaly_sql(1.02, 5)}, ad AS (SELECT *, row_number() OVER (ORDER BY day) AS id FROM an)"
OVERVIEW_SQL = f"""WITH {EVENT_SQL}, {DAILY_SQL}, {CATALOG_SQL}, {STATS_SQL}, {ALERT_SQL},
  ov AS (SELECT st.day, st.log_count, st.size_bytes, coalesce(kind, 'absent') AS kind, ad.day IS NOT NULL AS has_alert
  FROM st LEFT JOIN ct ON st.day = ct.day LEFT JOIN ad ON st.day = ad.day)"""


@query(f"WITH {EVENT_SQL}, {DAILY_SQL}, {STATS_SQL} SELECT * FROM st")
def daily_stats_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.anomaly_days(event_daily(spark, sf), ratio=1.02, min_count=5)


def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return lake.daily_overview(_stats(spark, sf), _catalog(spark, sf), _found(spark, sf))


@query(f"{OVERVIEW_SQL} SELECT * FROM ov")
def daily_overview(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf)


@query(f"{OVERVIEW_SQL} SELECT day, log_count, has_alert FROM ov")
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return lake.calendar(_stats(spark, sf), _found(spark, sf))


@query(
    f"""{OVERVIEW_SQL} SELECT count(*) AS days, CAST(sum(log_count) AS BIGINT) AS logs, CAST(sum(size_bytes) AS BIGINT) AS bytes, avg(log_count) AS mean_per_day,
    count(*) FILTER (WHERE kind = 'hot') / count(*) AS hot_share, count(*) FILTER (WHERE kind = 'cold') / count(*) AS cold_share FROM ov"""
)
def overview_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lake.overview_totals(_overview(spark, sf))


@query(f"WITH {EVENT_SQL}, {DAILY_SQL}, {STATS_SQL} SELECT * FROM st ORDER BY day DESC LIMIT 14")
def last_14_days(spark: SparkSession, sf: str) -> DataFrame:
    return lake.last_days(_stats(spark, sf), 14)


@query()
def bytes_per_row(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes a row of the archive, per day, from the files written."""
    path, logs = lake.scratch(spark, "archive"), fx.event_logs(spark, sf)
    lake.write_archive(logs, path, files=4)
    sizes = lake.catalog(spark, path, "cold")
    counts = lake.read_lake(spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(counts, "day").select("day", "kind", "n", (F.col("size_bytes") / F.col("n")).alias("bytes_per_row"))


# alerts: found days, numbered; every third one is acknowledged


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    found = _found(spark, sf).withColumn("id", F.row_number().over(Window.orderBy("day")).cast("long"))  # one row per day
    done = F.col("id") % 3 == 0
    return found.select(
        "id", "day", "log_count", "ratio", done.alias("acknowledged"), F.when(done, "admin").alias("acknowledged_by"), F.when(done, F.lit(NOW - 999)).cast("long").alias("acknowledged_at")
    )


ALERTS_SQL = f"""{ALERT_SQL}, a AS (SELECT id, day, log_count, ratio, id % 3 = 0 AS acknowledged, CASE WHEN id % 3 = 0 THEN 'admin' END AS acknowledged_by,
  CAST(CASE WHEN id % 3 = 0 THEN {NOW - 999} END AS BIGINT) AS acknowledged_at FROM ad)"""
_HEAD = f"WITH {EVENT_SQL}, {DAILY_SQL}, {ALERTS_SQL}"


@query(
    f"""{_HEAD}, n AS (SELECT id + 100 AS id, day, log_count, ratio * 2 AS ratio, false AS acknowledged, CAST(NULL AS VARCHAR) AS acknowledged_by, CAST(NULL AS BIGINT) AS acknowledged_at FROM a WHERE id % 2 = 0)
    SELECT * FROM a WHERE day NOT IN (SELECT day FROM n) UNION ALL SELECT * FROM n"""
)
def alerts_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = _alerts(spark, sf)
    new = old.where("id % 2 = 0").withColumns(
        {"id": F.col("id") + 100, "ratio": F.col("ratio") * 2, "acknowledged": F.lit(False), "acknowledged_by": F.lit(None).cast("string"), "acknowledged_at": F.lit(None).cast("long")}
    )
    again = new.withColumns({"id": F.col("id") - 50, "ratio": F.lit(0.0)})
    return al.upsert_by_day(old, new.unionByName(again))


@query(
    f"""{_HEAD}, k AS (SELECT event_id % 10 AS alert_id, min((CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), concat('user', CAST(user_id AS VARCHAR)))) AS x FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT id, day, log_count, ratio, acknowledged OR x IS NOT NULL AS acknowledged, CASE WHEN NOT acknowledged AND x IS NOT NULL THEN x[2] ELSE acknowledged_by END AS acknowledged_by,
      CASE WHEN NOT acknowledged AND x IS NOT NULL THEN x[1] ELSE acknowledged_at END AS acknowledged_at FROM a LEFT JOIN k ON id = alert_id"""
)
def alerts_ack(spark: SparkSession, sf: str) -> DataFrame:
    acks = fx.audit_rows(spark, sf).where("action = 'click'").select((F.col("id") % 10).alias("alert_id"), "username", "ts")
    return al.acknowledge(_alerts(spark, sf), acks)


@query(f"{_HEAD} SELECT * FROM a WHERE NOT acknowledged ORDER BY day DESC LIMIT 200")
def alerts_unacked(spark: SparkSession, sf: str) -> DataFrame:
    return al.listed(_alerts(spark, sf), only_open=True)


@query(f"{_HEAD} SELECT count(*) FILTER (WHERE NOT acknowledged) AS open_alerts FROM a")
def alerts_unacked_count(spark: SparkSession, sf: str) -> DataFrame:
    return al.open_count(_alerts(spark, sf))


@query(f"{_HEAD} SELECT * FROM a WHERE id = 3 UNION ALL SELECT * FROM a WHERE day = (SELECT min(day) FROM a)")
def alerts_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """One alert by its id, one by its day."""
    a = _alerts(spark, sf)
    first = a.agg(F.min("day").cast("string")).first()[0]
    return al.by_key(a, alert_id=3).unionByName(al.by_key(a, day=first))


@query(
    f"""{_HEAD}, n AS (SELECT id + 100 AS id, day, log_count, ratio * 2 AS ratio, false AS acknowledged, CAST(NULL AS VARCHAR) AS acknowledged_by, CAST(NULL AS BIGINT) AS acknowledged_at FROM a WHERE id % 2 = 0),
    v1 AS (SELECT * FROM a), v2 AS (SELECT * FROM a WHERE day NOT IN (SELECT day FROM n) UNION ALL SELECT * FROM n),
    v3 AS (SELECT * REPLACE (true AS acknowledged, CASE WHEN acknowledged THEN acknowledged_by ELSE 'operator' END AS acknowledged_by, CASE WHEN acknowledged THEN acknowledged_at ELSE {NOW} END AS acknowledged_at) FROM v2)
    SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3"""
)
def alerts_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A stored alert table: written, upserted by day and acknowledged as three versions, each read back."""
    path, first = lake.scratch(spark, "alerts"), _alerts(spark, sf)
    new = first.where("id % 2 = 0").withColumns(
        {"id": F.col("id") + 100, "ratio": F.col("ratio") * 2, "acknowledged": F.lit(False), "acknowledged_by": F.lit(None).cast("string"), "acknowledged_at": F.lit(None).cast("long")}
    )
    schema = first.schema
    steps = [versions.append(first, path), al.store_upsert(path, new, schema)]  # without alerts, the first one publishes nothing
    ids = versions.read(spark, path, schema).select(F.col("id").alias("alert_id"), F.lit("operator").alias("username"), F.lit(NOW).cast("long").alias("ts"))
    steps.append(al.store_acknowledge(path, ids, schema))
    every = [versions.read(spark, path, schema, s).withColumn("version", F.lit(n)) for n, s in enumerate(steps, 1)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"WITH {EVENT_SQL} SELECT 'newest' AS version, {LOGS} FROM ev UNION ALL SELECT 'third', {LOGS} FROM ev WHERE event_id % 3 <> 2 UNION ALL SELECT 'cold', {LOGS} FROM ev WHERE day <= DATE '2024-01-05'")
def lake_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A lake that three batches fill, one of them after days were compacted; its first five days are then archived."""
    hot, cold, logs = lake.scratch(spark, "hot"), lake.scratch(spark, "cold"), fx.event_logs(spark, sf)
    for k in (0, 1):
        versions.append(logs.where(F.col("event_id") % 3 == k).drop("event_id"), hot, ("day",), stream="events", batch=k)
    lake.compact(spark, hot, [f"2024-01-{d:02d}" for d in range(1, 16)])
    for _ in range(2):  # a batch that comes again
        versions.append(logs.where("event_id % 3 = 2").drop("event_id"), hot, ("day",), stream="events", batch=2)
    lake.archive_days(spark, hot, cold, logs.where("day <= DATE'2024-01-05'").select("day"))
    named = {"newest": lake.read_tiers(spark, hot, cold), "third": versions.read(spark, hot, CONN_LOGS, 3), "cold": lake.read_lake(spark, cold)}
    out = [rows.withColumn("version", F.lit(name)) for name, rows in named.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    f"""WITH {EVENT_SQL}, d AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE event_id % 10 = 0) AS late FROM ev GROUP BY day)
    SELECT day, n AS log_count, CAST(CASE WHEN day > DATE '2024-01-20' AND late > 0 THEN 2 WHEN day <= DATE '2024-01-10' THEN 2 ELSE 1 END AS BIGINT) AS updated_at FROM d"""
)
def stats_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """Stored statistics after a first ingest, and after late rows of some days and the archiving of others: only those are counted anew."""
    hot, cold, stats, logs = lake.scratch(spark, "hot"), lake.scratch(spark, "cold"), lake.scratch(spark, "stats"), fx.event_logs(spark, sf)
    late = F.expr("day > DATE'2024-01-20' AND event_id % 10 = 0")
    versions.append(logs.where(~late).drop("event_id"), hot, ("day",))
    lake.refresh_stats(spark, hot, cold, stats, 1)
    versions.append(logs.where(late).drop("event_id"), hot, ("day",))
    lake.archive_days(spark, hot, cold, logs.where("day <= DATE'2024-01-10'").select("day"))
    lake.refresh_stats(spark, hot, cold, stats, 2)
    return versions.read(spark, stats, STATS).select("day", "log_count", "updated_at")


# audit


@query(f"WITH {AUDIT_SQL} SELECT * FROM au WHERE action = 'login_failed' ORDER BY ts DESC, id DESC LIMIT 50")
def audit_last_of(spark: SparkSession, sf: str) -> DataFrame:
    return al.last_of(fx.audit_rows(spark, sf), "login_failed")


@query(f"WITH {AUDIT_SQL} SELECT * FROM au ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 200")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    return al.audit_page(fx.audit_rows(spark, sf), 2)


@query(f"WITH {AUDIT_SQL} SELECT * FROM au WHERE username = 'user3' AND action = 'search'")
def audit_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return al.audit_filtered(fx.audit_rows(spark, sf), "user3", "search")


@query(f"WITH {AUDIT_SQL} SELECT ip_address, count(*) AS failures, count(DISTINCT username) AS users FROM au WHERE action = 'login_failed' AND ts > {NOW - 86400} AND ts <= {NOW} GROUP BY ip_address")
def audit_bruteforce(spark: SparkSession, sf: str) -> DataFrame:
    return al.bruteforce(fx.audit_rows(spark, sf), NOW)


@query(f"WITH {AUDIT_SQL} SELECT username, action, count(*) AS n FROM au WHERE ts > {NOW - 180 * 86400} AND ts <= {NOW} GROUP BY ALL ORDER BY n DESC, username, action LIMIT 30")
def audit_user_actions(spark: SparkSession, sf: str) -> DataFrame:
    return al.user_actions(fx.audit_rows(spark, sf), NOW)


@query(f"WITH {AUDIT_SQL} SELECT DISTINCT action FROM au ORDER BY action")
def audit_actions(spark: SparkSession, sf: str) -> DataFrame:
    return al.audit_actions(fx.audit_rows(spark, sf))


@query(f"WITH {AUDIT_SQL} SELECT * FROM au WHERE username = 'user5' AND ts > {NOW - 7 * 86400} AND ts <= {NOW}")
def audit_user_recent(spark: SparkSession, sf: str) -> DataFrame:
    return al.user_recent(fx.audit_rows(spark, sf), "user5", NOW)


@query(
    f"""WITH {EVENT_SQL}, s AS (SELECT in_iface AS source, ts, pkt_len FROM ev), f AS (SELECT source, ts - ts % 3600 AS hour, sum(pkt_len) AS size FROM s GROUP BY ALL)
    SELECT source, 'stalled' AS kind, {NOW - 12000} - max(ts) AS value FROM s GROUP BY source HAVING {NOW - 12000} - max(ts) > 3600
    UNION ALL SELECT source, 'backlog', CAST(sum(size) AS BIGINT) FROM f WHERE hour >= {NOW - 86400 * 5} GROUP BY source HAVING sum(size) > 20000"""
)
def freshness_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Interfaces as sources; their hours of the last five days are the unprocessed files."""
    s = fx.event_logs(spark, sf).select(F.col("in_iface").alias("source"), "ts", "pkt_len")
    files = s.groupBy("source", (F.col("ts") - F.col("ts") % 3600).alias("hour")).agg(F.sum("pkt_len").alias("size")).withColumn("done", F.col("hour") < NOW - 86400 * 5)
    return jobs.freshness(s.select("source", "ts"), files, NOW - 12000, 3600, 20000)

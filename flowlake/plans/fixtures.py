"""Connection logs, raw lines, audit rows and stats derived from the given tables, in Spark and in SQL.

Every ``*_SQL`` string is the common-table expression that gives DuckDB the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOG_COLUMNS

# 100.64.0.0, 8.8.8.8 and 170.245.175.121
SRC_BASE, DST_BASE, NAT_BASE = 1681915904, 134744072, 2868227961


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as connection logs: 30 days."""
    e = F.expr
    return (
        read(spark, sf_dir, "events")
        .withColumn("stamp", F.col("ts").cast("timestamp"))
        .select(
            e("CAST(floor(unix_micros(stamp) / 1000000) AS BIGINT)").alias("ts"),
            e("CAST(stamp AS DATE)").alias("day"),
            e("concat('VLAN', CAST(user_id % 8 AS STRING))").alias("in_iface"),
            e("concat('ether', CAST(1 + user_id % 4 AS STRING))").alias("out_iface"),
            e("CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END").alias("proto"),
            e("CASE event_type WHEN 'error' THEN 'invalid' WHEN 'signup' THEN 'new' ELSE 'established' END").alias("conn_state"),
            e("event_type <> 'error'").alias("has_snat"),
            (F.lit(SRC_BASE) + F.col("user_id")).cast("long").alias("src_ip"),
            e("CAST(1024 + event_id % 64512 AS INT)").alias("src_port"),
            (F.lit(DST_BASE) + e("(event_id * 7 + user_id) % 97")).cast("long").alias("dst_ip"),
            e(
                "CAST(CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN IF(event_id % 2 = 0, 80, 8080) WHEN 'signup' THEN 53 "
                "WHEN 'error' THEN CASE event_id % 5 WHEN 2 THEN 22 WHEN 3 THEN 25 WHEN 4 THEN 3389 ELSE 123 END "
                "ELSE 49152 + event_id % 16384 END AS INT)"
            ).alias("dst_port"),
            (F.lit(NAT_BASE) + e("user_id % 4")).cast("long").alias("nat_ip"),
            e("CAST(1024 + event_id % 64512 AS INT)").alias("nat_port"),
            e("CAST(40 + event_id % 1400 AS INT)").alias("pkt_len"),
            e("CASE WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 'SYN' END").alias("tcp_flags"),
            F.lit("nat").alias("log_type"),
            F.col("event_id"),
        )
    )


def item_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as connection logs: some 2,500 days."""
    e = F.expr
    return read(spark, sf_dir, "lineitem").withColumn("stamp", F.col("l_shipdate").cast("timestamp")).select(
        e("unix_seconds(stamp) + (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 86400").alias("ts"),
        e("CAST(stamp AS DATE)").alias("day"),
        e("concat('VLAN', CAST(l_suppkey % 8 AS STRING))").alias("in_iface"),
        e("concat('ether', CAST(1 + l_suppkey % 4 AS STRING))").alias("out_iface"),
        e("CASE WHEN l_linenumber % 3 = 0 THEN 'UDP' ELSE 'TCP' END").alias("proto"),
        e("CASE WHEN l_linestatus = 'O' THEN 'new' ELSE 'established' END").alias("conn_state"),
        e("l_returnflag = 'R'").alias("has_snat"),
        (F.lit(SRC_BASE) + F.col("l_suppkey")).cast("long").alias("src_ip"),
        e("CAST(1024 + (l_orderkey * 17 + l_linenumber) % 64512 AS INT)").alias("src_port"),
        (F.lit(DST_BASE) + F.col("l_partkey")).cast("long").alias("dst_ip"),
        e(
            "CAST(CASE l_partkey % 8 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 123 WHEN 4 THEN 22 WHEN 5 THEN 25 "
            "WHEN 6 THEN 8080 ELSE 49152 + (l_partkey * 31) % 16384 END AS INT)"
        ).alias("dst_port"),
        (F.lit(NAT_BASE) + e("l_suppkey % 8")).cast("long").alias("nat_ip"),
        e("CAST(1024 + (l_orderkey * 17 + l_linenumber) % 64512 AS INT)").alias("nat_port"),
        e("CAST(40 + l_quantity AS INT)").alias("pkt_len"),
        e("CASE WHEN l_linenumber % 3 <> 0 AND l_returnflag = 'A' THEN 'SYN' END").alias("tcp_flags"),
        F.lit("nat").alias("log_type"),
    )


def months(logs: DataFrame) -> DataFrame:
    """Logs whose ``day`` is the first of the month: larger groups for the day profiles."""
    return logs.withColumn("day", F.trunc("day", "month"))


EVENT_SQL = f"""ev AS (
  SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, CAST(ts AS DATE) AS day,
    concat('VLAN', CAST(user_id % 8 AS VARCHAR)) AS in_iface, concat('ether', CAST(1 + user_id % 4 AS VARCHAR)) AS out_iface,
    CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE event_type WHEN 'error' THEN 'invalid' WHEN 'signup' THEN 'new' ELSE 'established' END AS conn_state,
    event_type <> 'error' AS has_snat, CAST({SRC_BASE} + user_id AS BIGINT) AS src_ip,
    CAST(1024 + event_id % 64512 AS INTEGER) AS src_port,
    CAST({DST_BASE} + (event_id * 7 + user_id) % 97 AS BIGINT) AS dst_ip,
    CAST(CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 80 ELSE 8080 END WHEN 'signup' THEN 53
      WHEN 'error' THEN CASE event_id % 5 WHEN 2 THEN 22 WHEN 3 THEN 25 WHEN 4 THEN 3389 ELSE 123 END
      ELSE 49152 + event_id % 16384 END AS INTEGER) AS dst_port,
    CAST({NAT_BASE} + user_id % 4 AS BIGINT) AS nat_ip, CAST(1024 + event_id % 64512 AS INTEGER) AS nat_port,
    CAST(40 + event_id % 1400 AS INTEGER) AS pkt_len,
    CASE WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 'SYN' END AS tcp_flags, 'nat' AS log_type, event_id
  FROM events)"""

ITEM_SQL = f"""li AS (
  SELECT epoch_us(l_shipdate) // 1000000 + (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 86400 AS ts, CAST(l_shipdate AS DATE) AS day,
    concat('VLAN', CAST(l_suppkey % 8 AS VARCHAR)) AS in_iface, concat('ether', CAST(1 + l_suppkey % 4 AS VARCHAR)) AS out_iface,
    CASE WHEN l_linenumber % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE WHEN l_linestatus = 'O' THEN 'new' ELSE 'established' END AS conn_state, l_returnflag = 'R' AS has_snat,
    CAST({SRC_BASE} + l_suppkey AS BIGINT) AS src_ip, CAST(1024 + (l_orderkey * 17 + l_linenumber) % 64512 AS INTEGER) AS src_port,
    CAST({DST_BASE} + l_partkey AS BIGINT) AS dst_ip,
    CAST(CASE l_partkey % 8 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 123 WHEN 4 THEN 22 WHEN 5 THEN 25
      WHEN 6 THEN 8080 ELSE 49152 + (l_partkey * 31) % 16384 END AS INTEGER) AS dst_port,
    CAST({NAT_BASE} + l_suppkey % 8 AS BIGINT) AS nat_ip, CAST(1024 + (l_orderkey * 17 + l_linenumber) % 64512 AS INTEGER) AS nat_port,
    CAST(40 + l_quantity AS INTEGER) AS pkt_len,
    CASE WHEN l_linenumber % 3 <> 0 AND l_returnflag = 'A' THEN 'SYN' END AS tcp_flags, 'nat' AS log_type
  FROM lineitem)"""

MONTH_SQL = ITEM_SQL + ", mo AS (SELECT * REPLACE (CAST(date_trunc('month', day) AS DATE) AS day) FROM li)"

LOGS = ", ".join(LOG_COLUMNS)


def ip_sql(v: str) -> str:
    return f"concat((({v}) >> 24) & 255, '.', (({v}) >> 16) & 255, '.', (({v}) >> 8) & 255, '.', ({v}) & 255)"


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as audit events: the event type is the action, errors are failed logins."""
    e = F.expr
    return read(spark, sf_dir, "events").withColumn("stamp", F.col("ts").cast("timestamp")).select(
        F.col("event_id").alias("id"),
        e("concat('user', CAST(user_id AS STRING))").alias("username"),
        e("CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'export' ELSE event_type END").alias("action"),
        F.col("props").alias("details"),
        e("concat('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(event_id % 50 AS STRING))").alias("ip_address"),
        e("CAST(floor(unix_micros(stamp) / 1000000) AS BIGINT)").alias("ts"),
    )


AUDIT_SQL = """au AS (
  SELECT event_id AS id, concat('user', CAST(user_id AS VARCHAR)) AS username,
    CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'export' ELSE event_type END AS action,
    props AS details, concat('10.0.', CAST(user_id % 7 AS VARCHAR), '.', CAST(event_id % 50 AS VARCHAR)) AS ip_address,
    CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts
  FROM events)"""

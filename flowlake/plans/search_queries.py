"""Scans, scalar functions and forensic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import search as s
from ..sources import clustered, lake, versions
from . import fixtures as fx
from .fixtures import EVENT_SQL, ITEM_SQL, LOGS, NAT_BASE, SRC_BASE, ip_sql
from .registered import query

DAY, DAY_START = "2024-01-10", 1704844800
ORDER = ", ".join(s.ORDER)
SERVICE_SQL = "CASE dst_port " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in net.SERVICES.items()) + " ELSE '' END"
CATEGORY_SQL = "CASE WHEN dst_port <= 1023 THEN 'well_known' WHEN dst_port <= 49151 THEN 'registered' ELSE 'ephemeral' END"


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev WHERE day = DATE '{DAY}'")
def scan_day(spark: SparkSession, sf: str) -> DataFrame:
    return lake.scan_day(fx.event_logs(spark, sf), DAY).drop("event_id")


@query(f"WITH {ITEM_SQL} SELECT {LOGS} FROM li WHERE day BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'")
def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    return lake.scan_range(fx.item_logs(spark, sf), "1996-03-01", "1996-08-31")


@query(f"WITH {EVENT_SQL} SELECT DISTINCT {ip_sql('dst_ip')} AS ip, {ip_sql('dst_ip')} AS signed_ip, dst_ip AS back FROM ev")
def ip_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.event_logs(spark, sf).select("dst_ip").distinct()
    text = net.ip_text(F.col("dst_ip"))
    return d.select(text.alias("ip"), net.ip_text(F.col("dst_ip") - (1 << 32)).alias("signed_ip"), net.ip_value(text).alias("back"))


@query(f"WITH {EVENT_SQL} SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM ev GROUP BY 1")
def port_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.event_logs(spark, sf).groupBy(net.port_category(F.col("dst_port")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENT_SQL} SELECT {SERVICE_SQL} AS service, count(*) AS n FROM ev GROUP BY 1")
def service_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.event_logs(spark, sf).groupBy(F.col("dst_port").alias("port")).agg(F.count(F.lit(1)).alias("c"))
    named = counts.join(net.service_table(spark), "port", "left")
    return named.groupBy(F.coalesce("service", F.lit("")).alias("service")).agg(F.sum("c").alias("n"))


@query(f"WITH {EVENT_SQL} SELECT ts - ts % 3600 AS hour, count(*) AS n FROM ev GROUP BY 1")
def logs_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return fx.event_logs(spark, sf).groupBy(net.epoch_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def _search(spark: SparkSession, sf: str, **given) -> DataFrame:
    return s.search(fx.event_logs(spark, sf), s.Search(DAY, **given)).drop("event_id")


def _sql(where: str) -> str:
    return f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev WHERE day = DATE '{DAY}' AND {where}"


@query(_sql(f"nat_ip = {NAT_BASE + 1} AND ts BETWEEN {DAY_START + 30000} AND {DAY_START + 60000}"))
def search_nat_window(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, nat_ip=NAT_BASE + 1, ts_from=DAY_START + 30000, ts_to=DAY_START + 60000)


@query(_sql(f"src_ip = {SRC_BASE + 7}"))
def search_src_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, src_ip=SRC_BASE + 7)


@query(_sql("dst_port = 443"))
def search_dst_port(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, dst_port=443)


@query(_sql("proto = 'UDP'"))
def search_proto(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, proto="UDP")


BUSY_DAY, BUSY_START = "2024-01-04", 1704326400


@query(
    f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev WHERE day = DATE '{BUSY_DAY}' AND nat_ip = {NAT_BASE + 2} AND dst_port = 53 AND proto = 'TCP' "
    f"AND ts >= {BUSY_START} AND ts < {BUSY_START + 86400} AND src_ip = {SRC_BASE + 10}"
)
def search_all_filters(spark: SparkSession, sf: str) -> DataFrame:
    q = s.Search(BUSY_DAY, nat_ip=NAT_BASE + 2, dst_port=53, proto="TCP", ts_from=BUSY_START, ts_to=BUSY_START + 86399, src_ip=SRC_BASE + 10)
    return s.search(fx.event_logs(spark, sf), q).drop("event_id")


@query(_sql("nat_ip = 1"))
def search_unknown_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, nat_ip=1)


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev WHERE day = DATE '{DAY}' ORDER BY {ORDER} LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return s.page(fx.event_logs(spark, sf), s.Search(DAY, page=2, per_page=20)).drop("event_id")


@query(f"WITH {EVENT_SQL} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM ev WHERE day = DATE '{DAY}' AND dst_port = 443")
def search_total(spark: SparkSession, sf: str) -> DataFrame:
    return s.total(fx.event_logs(spark, sf), s.Search(DAY, dst_port=443, per_page=20))


@query(
    f"WITH {EVENT_SQL} SELECT {LOGS}, {ip_sql('src_ip')} AS src_ip_text, {ip_sql('dst_ip')} AS dst_ip_text, {ip_sql('nat_ip')} AS nat_ip_text, "
    f"{SERVICE_SQL} AS service FROM ev WHERE day = DATE '{DAY}'"
)
def search_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return s.enrich(_search(spark, sf))


REQUEST_SQL = (
    "rq AS (SELECT event_id AS request_id, nat_ip AS want_ip, CASE WHEN event_id % 40 = 0 THEN nat_port END AS want_port, ts - 150 AS t0, ts + 150 AS t1 "
    "FROM ev WHERE event_id % 20 = 0)"
)


@query(
    f"WITH {EVENT_SQL}, {REQUEST_SQL}, hit AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY {ORDER}) AS nth, {LOGS} "
    "FROM ev JOIN rq ON nat_ip = want_ip AND ts BETWEEN t0 AND t1 AND (want_port IS NULL OR want_port = nat_port)) "
    f"SELECT request_id, CAST(nth AS INTEGER) AS nth, {LOGS} FROM hit WHERE nth <= 100"
)
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Requests: every event whose id is divisible by 20, looked up in all rows."""
    logs = fx.event_logs(spark, sf)
    requests = logs.where("event_id % 20 = 0").select(
        F.col("event_id").alias("request_id"), "nat_ip", F.when(F.col("event_id") % 40 == 0, F.col("nat_port")).alias("nat_port"),
        (F.col("ts") - 150).alias("t0"), (F.col("ts") + 150).alias("t1"),
    )
    return s.search_batch(logs.drop("event_id"), requests, 100)


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev WHERE src_ip = {SRC_BASE + 7} AND ts BETWEEN {DAY_START - 500000} AND {DAY_START + 500000}")
def search_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """A source's rows of some days from the files of a clustered lake that its index doesn't rule out."""
    path, logs = lake.scratch(spark, "clustered"), fx.event_logs(spark, sf)
    versions.append(logs.drop("event_id"), path, ("day",))
    clustered.cluster(spark, path, lake.days_in(spark, path), files=64)
    return clustered.search(spark, path, {"src_ip": SRC_BASE + 7}, DAY_START - 500000, DAY_START + 500000)


@query(f"WITH {EVENT_SQL} SELECT count(*) AS n, true AS under_a_tenth FROM ev WHERE day = DATE '{DAY}' AND nat_ip = {NAT_BASE + 1} AND ts BETWEEN {DAY_START + 30000} AND {DAY_START + 33000}")
def search_files_read(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a point search in a clustered lake, and whether it opened under a tenth of the files."""
    path, logs = lake.scratch(spark, "clustered"), fx.event_logs(spark, sf)
    versions.append(logs.drop("event_id"), path, ("day",))
    clustered.cluster(spark, path, lake.days_in(spark, path), files=64)
    wanted = {"nat_ip": NAT_BASE + 1}, DAY_START + 30000, DAY_START + 33000
    files, total = clustered.files_for(spark, path, *wanted)
    return clustered.search(spark, path, *wanted).agg(F.count(F.lit(1)).alias("n")).withColumn("under_a_tenth", F.lit(len(files) * 10 < total))


_SPANS = (9, 21_600, 1_800_000)  # seconds, hours, weeks


@query(
    f"WITH {EVENT_SQL}, rq AS (SELECT event_id AS request_id, nat_ip AS want_ip, CASE WHEN event_id % 3 = 0 THEN nat_port END AS want_port, ts - {_SPANS[0]} AS t0, "
    f"ts + CASE event_id % 3 WHEN 0 THEN {_SPANS[0]} WHEN 1 THEN {_SPANS[1]} ELSE {_SPANS[2]} END AS t1 FROM ev WHERE event_id % 20 = 0), "
    f"hit AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY {ORDER}) AS nth, {LOGS} "
    "FROM ev JOIN rq ON nat_ip = want_ip AND ts BETWEEN t0 AND t1 AND (want_port IS NULL OR want_port = nat_port)) "
    f"SELECT request_id, CAST(nth AS INTEGER) AS nth, {LOGS} FROM hit WHERE nth <= 20"
)
def search_batch_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of seconds, hours and weeks in one batch, the first 20 rows of each (the report's own limit)."""
    logs = fx.event_logs(spark, sf)
    span = F.element_at(F.array(*[F.lit(x) for x in _SPANS]), (F.col("event_id") % 3 + 1).cast("int"))
    requests = logs.where("event_id % 20 = 0").select(
        F.col("event_id").alias("request_id"), "nat_ip", F.when(F.col("event_id") % 3 == 0, F.col("nat_port")).alias("nat_port"), (F.col("ts") - _SPANS[0]).alias("t0"), (F.col("ts") + span).alias("t1"),
    )
    return s.search_batch(logs.drop("event_id"), requests, 20)


_REQUEST_IP = "CASE event_id % 6 WHEN 0 THEN '300.1.1.1' WHEN 1 THEN '' WHEN 2 THEN '01.2.3.4' ELSE concat(' ', {ip}, ' ') END"


@query(
    f"""WITH {EVENT_SQL}, r AS (
      SELECT event_id AS id, {_REQUEST_IP.format(ip=ip_sql('nat_ip'))} AS nat_ip,
        CASE event_id % 5 WHEN 0 THEN 'icmp' WHEN 1 THEN ' udp' WHEN 2 THEN '' ELSE 'TCP' END AS proto,
        CASE WHEN event_id % 7 = 0 THEN 70000 ELSE dst_port END AS port, CAST(event_id % 11 AS INTEGER) AS page, CAST(event_id % 1300 AS INTEGER) AS per_page,
        CASE WHEN event_id % 6 > 2 THEN nat_ip END AS ip, CASE event_id % 5 WHEN 0 THEN 'ICMP' WHEN 1 THEN 'UDP' WHEN 2 THEN NULL ELSE 'TCP' END AS proto_name
      FROM ev)
    SELECT *, CASE WHEN id % 6 IN (0, 2) THEN 'bad address' WHEN proto_name = 'ICMP' THEN 'bad protocol' WHEN port > 65535 THEN 'bad port'
      WHEN page < 1 THEN 'bad page' WHEN per_page NOT BETWEEN 1 AND 1000 THEN 'bad page size' END AS reason FROM r"""
)
def requests_validated(spark: SparkSession, sf: str) -> DataFrame:
    logs = fx.event_logs(spark, sf).withColumn("text", net.ip_text(F.col("nat_ip")))
    return s.validate_requests(
        logs.select(
            F.col("event_id").alias("id"), F.expr(_REQUEST_IP.format(ip="text")).alias("nat_ip"),
            F.expr("CASE event_id % 5 WHEN 0 THEN 'icmp' WHEN 1 THEN ' udp' WHEN 2 THEN '' ELSE 'TCP' END").alias("proto"),
            F.expr("IF(event_id % 7 = 0, 70000, dst_port)").alias("port"), F.expr("CAST(event_id % 11 AS INT)").alias("page"), F.expr("CAST(event_id % 1300 AS INT)").alias("per_page"),
        )
    )


_KEY = f"md5(concat_ws('|', 42, {ORDER}))"


@query(
    f"WITH {EVENT_SQL}, rq AS (SELECT {_KEY} AS request_id, nat_ip AS want_ip, nat_port AS want_port, ts - 150 AS t0, ts + 150 AS t1 FROM ev WHERE nat_ip IS NOT NULL ORDER BY 1, {ORDER} LIMIT 30), "
    f"hit AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY {ORDER}) AS nth, {LOGS} "
    "FROM ev JOIN rq ON nat_ip = want_ip AND ts BETWEEN t0 AND t1 AND (want_port IS NULL OR want_port = nat_port)) "
    f"SELECT request_id, CAST(nth AS INTEGER) AS nth, {LOGS} FROM hit WHERE nth <= 100"
)
def probe_sample(spark: SparkSession, sf: str) -> DataFrame:
    """30 probes picked by a seeded hash (the sampling operator), each with its matches."""
    logs = fx.event_logs(spark, sf).drop("event_id")
    return s.search_batch(logs, s.probe_sample(logs, 30), 100)


_CSV = ["CAST(ts AS VARCHAR)", ip_sql("src_ip"), "src_port", ip_sql("dst_ip"), "dst_port", ip_sql("nat_ip"), "nat_port", "proto", "in_iface", "out_iface", "conn_state",
        "CASE WHEN has_snat THEN 'True' ELSE 'False' END", "pkt_len", "coalesce(tcp_flags, '')", "log_type"]


@query(f"WITH {EVENT_SQL}, x AS (SELECT * FROM ev ORDER BY {ORDER} LIMIT 100000) SELECT concat({', chr(44), '.join(_CSV)}) AS line FROM x")
def export_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The export, whose own limit is 100,000 rows."""
    return s.csv_lines(fx.event_logs(spark, sf))

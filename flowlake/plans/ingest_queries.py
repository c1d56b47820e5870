"""Parsing, the address registry, dictionaries, legacy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import parse, registry
from ..sources import lake, legacy
from . import fixtures as fx
from .fixtures import DST_BASE, EVENT_SQL, LOGS, SRC_BASE, ip_sql
from .registered import query

NOW = 1706745600  # 2024-02-01 00:00:00
FORMATS = "ABDEC"
JUNK = {7: "2024-01-01 00:00:00 system,info user logged in", 11: "2024-01-01 00:00:00 dhcp,info lease", 13: "no time here"}


def _rendered(logs: DataFrame, formats: str) -> F.Column:
    n = len(formats)
    text = parse.render(logs, formats[-1], mac=True)
    for k, f in enumerate(formats[:-1]):
        text = F.when(F.col("event_id") % n == k, parse.render(logs, f, mac=f == "D")).otherwise(text)
    return text


def raw_lines(spark: SparkSession, sf: str, formats: str = "ABDE", broken: bool = True, junk: bool = True) -> DataFrame:
    """``(file, pos, value)``: event logs as lines, every tenth cut in two after an address, with junk lines between."""
    logs = fx.event_logs(spark, sf)
    text = _rendered(logs, formats)
    cut = r"^(.*?->\d+\.\d+\.\d+\.\d+)(:.*)$"
    two = (F.col("event_id") % 10 == 0) if broken else F.lit(False)
    parts = F.when(two, F.array(F.regexp_extract("text", cut, 1), F.concat(F.lit("  "), F.regexp_extract("text", cut, 2)))).otherwise(F.array("text"))
    if junk:
        for k, (every, line) in enumerate(JUNK.items()):
            extra = F.when(F.col("event_id") % every == k, F.array(F.lit(line))).otherwise(F.array().cast("array<string>"))
            parts = F.concat(parts, extra)
    file = F.concat(F.lit("f"), F.date_format("day", "yyyy-MM-dd"))
    rows = logs.withColumn("text", text).select(file.alias("file"), "event_id", F.posexplode(parts).alias("k", "value"))
    return rows.select("file", (F.col("event_id") * 8 + F.col("k")).alias("pos"), "value")


def parsed_lines(lines: DataFrame) -> DataFrame:
    return parse.parse(parse.join_continuations(lines), F.lit(NOW))


def _parsed(spark: SparkSession, sf: str, formats: str = "ABDE") -> DataFrame:
    return parsed_lines(lake.written(raw_lines(spark, sf, formats), "lines"))  # the text is made once; reassembly reads it twice


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev")
def parse_nat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return parse.accepted(_parsed(spark, sf))


_JUNK_SQL = " UNION ALL ".join(f"SELECT {k} AS k, day, event_id FROM ev WHERE event_id % {every} = {k}" for k, every in enumerate(JUNK))


@query(
    f"""WITH {EVENT_SQL}, j AS ({_JUNK_SQL}), x AS (
      SELECT substr('{FORMATS}', CAST(event_id % 5 + 1 AS INTEGER), 1) AS format FROM ev UNION ALL SELECT CASE WHEN k < 2 THEN 'A' END FROM j)
    SELECT format, count(*) AS n FROM x GROUP BY format"""
)
def parse_format_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = parse.join_continuations(lake.written(raw_lines(spark, sf, FORMATS), "lines"))
    return parse.split_time(lines).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENT_SQL} SELECT event_id * 8 AS pos, substr('{FORMATS}', CAST(event_id % 5 + 1 AS INTEGER), 1) AS format, CASE WHEN event_id % 5 = 4 THEN {NOW} + ts % 86400 ELSE ts END AS ts FROM ev")
def parse_ts_formats(spark: SparkSession, sf: str) -> DataFrame:
    lines = parse.split_time(raw_lines(spark, sf, FORMATS, broken=False, junk=False), "value")
    return lines.select("pos", "format", parse.parse_time(F.col("ts_text"), F.col("format"), F.lit(NOW)).alias("ts"))


@query(f"WITH {EVENT_SQL}, j AS ({_JUNK_SQL}), x AS (SELECT 'nat' AS log_type FROM ev UNION ALL SELECT CASE k WHEN 0 THEN 'system' ELSE 'other' END FROM j) SELECT log_type, count(*) AS n FROM x GROUP BY 1")
def parse_log_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = parse.normalise(parse.split_time(parse.join_continuations(lake.written(raw_lines(spark, sf), "lines"))))
    return lines.groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENT_SQL}, j AS ({_JUNK_SQL}) SELECT concat('f', CAST(day AS VARCHAR)) AS file, CASE k WHEN 0 THEN 'not nat: system' WHEN 1 THEN 'not nat: other' ELSE 'no time' END AS reason, count(*) AS n FROM j GROUP BY ALL")
def parse_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return parse.rejected(_parsed(spark, sf), "file").groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EVENT_SQL}, j AS ({_JUNK_SQL}), x AS (SELECT day, 1 AS ok FROM ev UNION ALL SELECT day, 0 FROM j)
    SELECT concat('f', CAST(day AS VARCHAR)) AS file, count(*) FILTER (WHERE ok = 1) AS parsed, count(*) FILTER (WHERE ok = 0) AS rejected FROM x GROUP BY day"""
)
def parse_quality(spark: SparkSession, sf: str) -> DataFrame:
    return parse.quality(_parsed(spark, sf))


_LINE = (
    f"concat(strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S '), 'firewall,info forward: in:', in_iface, ' out:', out_iface, ',connection-state:', conn_state, "
    f"CASE WHEN has_snat THEN ',snat' ELSE '' END, ' src-mac 00:11:22:33:44:55, proto ', proto, CASE WHEN tcp_flags IS NULL THEN '' ELSE concat(' (', tcp_flags, ')') END, ', ', {ip_sql('src_ip')}, ':', src_port, '->', "
    f"{ip_sql('dst_ip')}, ':', dst_port, ', NAT (', {ip_sql('src_ip')}, ':', src_port, '->', {ip_sql('nat_ip')}, ':', nat_port, ')->', {ip_sql('dst_ip')}, ':', dst_port, ', len ', pkt_len)"
)


@query(f"WITH {EVENT_SQL} SELECT concat('f', CAST(day AS VARCHAR)) AS file, event_id * 8 AS pos, {_LINE} AS line FROM ev")
def join_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return parse.join_continuations(lake.written(raw_lines(spark, sf, "A", junk=False), "lines"))


# registry

ROLES_SQL = "oc AS (SELECT src_ip AS ip, ts FROM ev UNION ALL SELECT dst_ip, ts FROM ev UNION ALL SELECT nat_ip, ts FROM ev)"
DIM_SQL = f"{ROLES_SQL}, di AS (SELECT ip, count(*) AS total_hits, min(ts) AS first_seen, max(ts) AS last_seen FROM oc GROUP BY ip)"


def _dim(spark: SparkSession, sf: str) -> DataFrame:
    return registry.dim_ip(fx.event_logs(spark, sf))


@query(f"WITH {EVENT_SQL}, {DIM_SQL} SELECT * FROM di")
def dim_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _dim(spark, sf)


@query(f"WITH {EVENT_SQL}, {DIM_SQL} SELECT count(*) AS ips, CAST(sum(total_hits) AS BIGINT) AS hits FROM di")
def dim_ip_totals(spark: SparkSession, sf: str) -> DataFrame:
    return registry.totals(_dim(spark, sf))


@query(
    f"""WITH {EVENT_SQL}, {DIM_SQL}, old AS (SELECT DISTINCT src_ip AS ip, src_ip - {SRC_BASE} + 1 AS ip_id FROM ev)
    SELECT ip, ip_id FROM old UNION ALL
    SELECT ip, (SELECT max(ip_id) FROM old) + row_number() OVER (ORDER BY first_seen, ip) FROM di WHERE ip NOT IN (SELECT ip FROM old)"""
)
def dim_ip_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Sources have ids already; destinations and NAT addresses get the next ones."""
    old = fx.event_logs(spark, sf).select(F.col("src_ip").alias("ip")).distinct().withColumn("ip_id", F.col("ip") - SRC_BASE + 1)
    return registry.assign_ids(_dim(spark, sf), old)


@query(f"WITH {EVENT_SQL}, {DIM_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY total_hits DESC, ip) AS rn FROM di) SELECT ip, total_hits, first_seen, last_seen, rn <= 20 AS is_hot FROM r")
def dim_ip_hot(spark: SparkSession, sf: str) -> DataFrame:
    return registry.mark_hot(_dim(spark, sf), 20)


@query(f"WITH {EVENT_SQL}, {DIM_SQL} SELECT {ip_sql('di.ip')} AS ip, total_hits, first_seen, last_seen FROM di ORDER BY total_hits DESC, di.ip LIMIT 50")
def top_ips(spark: SparkSession, sf: str) -> DataFrame:
    return registry.top_ips(_dim(spark, sf), 50)


@query(f"WITH {EVENT_SQL}, {ROLES_SQL} SELECT DISTINCT ip FROM oc")
def distinct_ips(spark: SparkSession, sf: str) -> DataFrame:
    return registry.distinct_ips(fx.event_logs(spark, sf))


@query(
    f"""WITH {EVENT_SQL}, nm AS (
      SELECT day, 'interfaces' AS kind, in_iface AS name, ts FROM ev UNION ALL SELECT day, 'interfaces', out_iface, ts FROM ev
      UNION ALL SELECT day, 'protocols', proto, ts FROM ev UNION ALL SELECT day, 'conn_states', conn_state, ts FROM ev),
    f AS (SELECT day, kind, name, min(ts) AS first FROM nm GROUP BY ALL)
    SELECT day, kind, CAST(row_number() OVER (PARTITION BY day, kind ORDER BY first, name) AS INTEGER) AS id, name FROM f"""
)
def dict_ids(spark: SparkSession, sf: str) -> DataFrame:
    return registry.dict_ids(fx.event_logs(spark, sf))


@query(f"WITH {EVENT_SQL} SELECT {LOGS} FROM ev")
def decode_dicts(spark: SparkSession, sf: str) -> DataFrame:
    logs = fx.event_logs(spark, sf).drop("event_id")
    dims = lake.written(registry.dict_ids(logs), "dicts")  # a few rows a day, used twice
    return registry.decode(registry.encode(logs, dims), dims).select(*logs.columns)


@query(
    f"""WITH {EVENT_SQL}, nm AS (
      SELECT day, 'interfaces' AS kind, in_iface AS name, ts, event_id FROM ev UNION ALL SELECT day, 'interfaces', out_iface, ts, event_id FROM ev
      UNION ALL SELECT day, 'protocols', proto, ts, event_id FROM ev UNION ALL SELECT day, 'conn_states', conn_state, ts, event_id FROM ev),
    f AS (SELECT day, kind, name, min(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END) AS batch, min(ts) FILTER (WHERE event_id % 10 = 0) AS early, min(ts) FILTER (WHERE event_id % 10 <> 0) AS late FROM nm GROUP BY ALL)
    SELECT day, kind, CAST(row_number() OVER (PARTITION BY day, kind ORDER BY batch, CASE batch WHEN 0 THEN early ELSE late END, name) AS INTEGER) AS id, name FROM f"""
)
def dict_ids_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A stored dictionary that a tenth of the rows fills first and the rest then, though many of those are older."""
    path, logs = lake.scratch(spark, "dicts"), fx.event_logs(spark, sf)
    for batch in (logs.where("event_id % 10 = 0"), logs.where("event_id % 10 <> 0"), logs):
        registry.store_dicts(spark, path, batch)
    return registry.read_dicts(spark, path)


# legacy layouts, made from the event logs

_IFACES = [(k, f"VLAN{k}") for k in range(8)] + [(100 + k, f"ether{k}") for k in range(1, 5)]
_PROTOS, _STATES = [(6, "TCP"), (17, "UDP")], [(1, "new"), (2, "established"), (3, "invalid")]


def _dims(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.createDataFrame(x, "id int, name string") for x in (_IFACES, _PROTOS, _STATES))


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    return fx.event_logs(spark, sf).withColumns(
        {
            "in_iface_id": F.expr("CAST(substring(in_iface, 5) AS INT)"), "out_iface_id": F.expr("100 + CAST(substring(out_iface, 6) AS INT)"),
            "proto_id": F.expr("IF(proto = 'UDP', 17, 6)"), "conn_state_id": F.expr("CASE conn_state WHEN 'new' THEN 1 WHEN 'established' THEN 2 ELSE 3 END"),
        }
    )


_SIGNED = "CASE WHEN {0} > 2147483647 THEN {0} - 4294967296 ELSE {0} END"
_KNOWN = "(dst_ip - {0}) % 10 <> 0".format(DST_BASE)


@query(f"WITH {EVENT_SQL} SELECT * REPLACE (CASE WHEN {_KNOWN} THEN dst_ip ELSE 0 END AS dst_ip) FROM (SELECT {LOGS} FROM ev)")
def legacy_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth destination is missing from the address dictionary."""
    logs = _coded(spark, sf)
    known = registry.distinct_ips(logs).where(f"ip < {DST_BASE} OR ip >= {SRC_BASE} OR (ip - {DST_BASE}) % 10 <> 0")
    addresses = known.select(F.col("ip").alias("id"), net.ip_text(F.col("ip")).alias("ip"))
    old = logs.withColumnsRenamed({"src_ip": "src_ip_id", "dst_ip": "dst_ip_id", "nat_ip": "nat_ip_id"}).withColumn("log_type", F.lit(None).cast("string"))
    old = old.withColumn("has_snat", F.when(F.col("has_snat"), F.lit(1)).otherwise(F.lit(None).cast("int")))
    return legacy.normalise_v2(old.drop("in_iface", "out_iface", "proto", "conn_state"), addresses, *_dims(spark))


@query(f"WITH {EVENT_SQL} SELECT * REPLACE (false AS has_snat, CAST(NULL AS INTEGER) AS pkt_len, CAST(NULL AS VARCHAR) AS tcp_flags) FROM (SELECT {LOGS} FROM ev)")
def legacy_b(spark: SparkSession, sf: str) -> DataFrame:
    d = _coded(spark, sf)
    old = d.select(
        F.col("ts").alias("timestamp"), F.col("in_iface_id").alias("interface_in_id"), F.col("out_iface_id").alias("interface_out_id"), F.col("proto_id").alias("protocol_id"),
        F.col("conn_state_id").alias("state_id"), F.col("src_ip").alias("src_ip_priv"), F.col("src_port").alias("src_port_priv"), "dst_ip", "dst_port",
        F.expr(_SIGNED.format("nat_ip")).alias("nat_ip_pub"), F.col("nat_port").alias("nat_port_pub"),
    )
    return legacy.normalise_b(old, *_dims(spark))


@query(f"WITH {EVENT_SQL} SELECT * REPLACE (CASE WHEN proto = 'TCP' THEN nat_ip END AS nat_ip) FROM (SELECT {LOGS} FROM ev)")
def legacy_c(spark: SparkSession, sf: str) -> DataFrame:
    """Signed addresses; UDP rows have no NAT address, spelled 0."""
    d = _coded(spark, sf).withColumn("nat_ip", F.expr("CASE WHEN proto = 'TCP' THEN " + _SIGNED.format("nat_ip") + " ELSE 0 END"))
    return legacy.normalise_c(d.drop("in_iface", "out_iface", "proto", "conn_state"), *_dims(spark))


@query(
    f"""WITH {EVENT_SQL} SELECT * REPLACE (CASE WHEN bad THEN 0 ELSE ts END AS ts, CASE WHEN bad THEN DATE '1970-01-01' ELSE day END AS day, CAST(NULL AS VARCHAR) AS conn_state,
      false AS has_snat, CAST(NULL AS INTEGER) AS pkt_len, CAST(NULL AS VARCHAR) AS tcp_flags) FROM (SELECT {LOGS}, event_id % 9 = 4 AS bad FROM ev)""".replace(") FROM (SELECT", ") FROM (SELECT", 1).replace("SELECT * REPLACE", "SELECT * EXCLUDE (bad) REPLACE")
)
def legacy_a(spark: SparkSession, sf: str) -> DataFrame:
    """Texts; a ninth of the times is unreadable, a third is ISO 8601."""
    d = fx.event_logs(spark, sf)
    at = F.timestamp_seconds("ts")
    time = F.when(F.col("event_id") % 9 == 4, F.lit("soon")).when(F.col("event_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(at, " yyyy-MM-dd HH:mm:ss "))
    old = d.select(
        time.alias("timestamp"), F.col("in_iface").alias("interface_in"), F.col("out_iface").alias("interface_out"), "proto", net.ip_text(F.col("src_ip")).alias("src_ip_priv"),
        F.col("src_port").alias("src_port_priv"), net.ip_text(F.col("dst_ip")).alias("dst_ip"), "dst_port", net.ip_text(F.col("nat_ip")).alias("nat_ip_pub"), F.col("nat_port").alias("nat_port_pub"),
    )
    return legacy.normalise_a(old)

"""Day profiles, anomalies, classes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import anomaly, classify, profile, report
from ..sources import lake, versions
from . import fixtures as fx
from .fixtures import EVENT_SQL, MONTH_SQL
from .registered import query
from .search_queries import CATEGORY_SQL, SERVICE_SQL

TCP_ONLY = ", ".join(map(str, net.TCP_ONLY_PORTS))
MAIL = ", ".join(map(str, net.MAIL_PORTS))


def _logs(spark: SparkSession, sf: str, monthly: bool = True) -> DataFrame:
    return fx.months(fx.item_logs(spark, sf)) if monthly else fx.event_logs(spark, sf)


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.flows(_logs(spark, sf))


def _ranked(sql: str, order: str, k: int) -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY {order}) AS INTEGER) AS rank FROM ({sql})) WHERE rank <= {k}"


def globals_sql(t: str) -> str:
    return f"""SELECT day, count(*) AS total, count(*) FILTER (WHERE dst_port BETWEEN 0 AND 1023) AS well_known,
      count(*) FILTER (WHERE dst_port BETWEEN 1024 AND 49151) AS registered, count(*) FILTER (WHERE dst_port >= 49152) AS ephemeral,
      count(*) FILTER (WHERE dst_port = 53) AS dns, count(*) FILTER (WHERE dst_port IN (80, 443)) AS http, count(*) FILTER (WHERE dst_port = 123) AS ntp,
      count(*) FILTER (WHERE dst_port = 22) AS ssh, count(*) FILTER (WHERE dst_port = 3389) AS rdp, count(*) FILTER (WHERE dst_port IN ({MAIL})) AS email,
      count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_ip) AS unique_dst, count(DISTINCT dst_port) AS unique_dst_ports FROM {t} GROUP BY day"""


@query(f"WITH {MONTH_SQL} {globals_sql('mo')}")
def day_globals(spark: SparkSession, sf: str) -> DataFrame:
    return profile.globals_of(_logs(spark, sf))


def sources_sql(t: str) -> str:
    return f"""SELECT day, src_ip, count(*) AS connections, count(DISTINCT dst_ip) AS dst_ips, count(DISTINCT dst_port) AS dst_ports,
      count(*) FILTER (WHERE dst_port BETWEEN 0 AND 1023) * 100.0::DOUBLE / count(*) AS well_known_pct,
      count(*) FILTER (WHERE dst_port >= 49152) * 100.0::DOUBLE / count(*) AS ephemeral_pct FROM {t} GROUP BY day, src_ip"""


SOURCE_COLUMNS = "day, src_ip, connections, dst_ips, dst_ports, well_known_pct, ephemeral_pct"


@query(f"WITH {EVENT_SQL} SELECT {SOURCE_COLUMNS}, rank FROM {_ranked(sources_sql('ev'), 'connections DESC, src_ip', 10)}")
def top_src_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_sources(_logs(spark, sf, False))


@query(
    f"""WITH {MONTH_SQL} SELECT {SOURCE_COLUMNS}, CASE WHEN dst_ports >= 8 AND dst_ips >= 8 THEN 'distributed'
      WHEN dst_ports <= 4 AND dst_ips <= 4 THEN 'concentrated' ELSE 'mixed' END AS profile FROM {_ranked(sources_sql('mo'), 'connections DESC, src_ip', 1)}"""
)
def talker_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.talker_profile(_logs(spark, sf), wide=8, narrow=4)


_PORTS = "SELECT day, dst_port, count(*) AS n FROM mo GROUP BY day, dst_port"


@query(f"WITH {MONTH_SQL} SELECT day, rank, dst_port, n, {CATEGORY_SQL} AS category, {SERVICE_SQL} AS service FROM {_ranked(_PORTS, 'n DESC, dst_port', 10)}")
def top_dst_ports(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_ports(_logs(spark, sf))


@query(f"WITH {EVENT_SQL} SELECT day, rank, dst_ip, n FROM {_ranked('SELECT day, dst_ip, count(*) AS n FROM ev GROUP BY day, dst_ip', 'n DESC, dst_ip', 10)}")
def top_dst_ips(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_destinations(_logs(spark, sf, False))


_PER_SOURCE = "SELECT day, src_ip, count(DISTINCT dst_port) AS ports FROM mo GROUP BY day, src_ip"


@query(f"WITH {MONTH_SQL} SELECT day, count(*) FILTER (WHERE ports > 5) AS suspects FROM ({_PER_SOURCE}) GROUP BY day")
def p2p_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return profile.port_spread(_logs(spark, sf), over=5).select("day", "suspects")


@query(f"WITH {MONTH_SQL} SELECT day, avg(ports) AS avg_ports FROM ({_PER_SOURCE}) GROUP BY day")
def avg_ports_per_src(spark: SparkSession, sf: str) -> DataFrame:
    return profile.port_spread(_logs(spark, sf)).select("day", "avg_ports")


def _detail(port: int, gate: int) -> str:
    return (
        f"WITH {EVENT_SQL} SELECT day, count(DISTINCT src_ip) AS clients, count(DISTINCT dst_ip) AS servers FROM ev WHERE dst_port = {port} "
        f"GROUP BY day HAVING count(*) >= {gate}"
    )


@query(_detail(123, 20))
def ntp_detail(spark: SparkSession, sf: str) -> DataFrame:
    return profile.port_detail(_logs(spark, sf, False), 123, 20)


@query(_detail(53, 50))
def dns_detail(spark: SparkSession, sf: str) -> DataFrame:
    return profile.port_detail(_logs(spark, sf, False), 53, 50)


_FLOWS = "SELECT day, src_ip, dst_ip, dst_port, proto, count(*) AS n FROM mo GROUP BY ALL"


@query(f"WITH {MONTH_SQL} SELECT day, rank, src_ip, dst_ip, dst_port, proto, n, {SERVICE_SQL} AS service FROM {_ranked(_FLOWS, 'n DESC, src_ip, dst_ip, dst_port, proto', 5)}")
def top_flows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_flows(_flows(spark, sf))


@query(f"WITH {MONTH_SQL} SELECT day, rank, src_ip, dst_ip, dst_port, proto, n, {SERVICE_SQL} AS service FROM {_ranked(_FLOWS, 'n DESC, src_ip, dst_ip, dst_port, proto', 5)}")
def top_flows_heavy(spark: SparkSession, sf: str) -> DataFrame:
    """The same flows, counted one by one only where a bucket of them can hold one of the first."""
    return profile.top_flows_of(_logs(spark, sf))


@query(
    f"WITH {EVENT_SQL}, x AS (SELECT count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_ip) AS unique_dst, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT nat_ip) AS unique_nat "
    "FROM ev WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') "
    "SELECT kind, exact, true AS within_5_pct FROM x UNPIVOT (exact FOR kind IN (unique_src, unique_dst, unique_dst_ports, unique_nat))"
)
def distinct_of_period(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts of a period from its days' stored sketches, checked against the exact ones."""
    path, logs = lake.scratch(spark, "sketches"), fx.event_logs(spark, sf)
    profile.store_sketches(path, logs)
    days = F.col("day").between(F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-20")))
    found = profile.distinct_of_period(versions.read(spark, path, profile.SKETCHES).where(days))
    exact = logs.where(days).agg(*[F.count_distinct(c).alias(name) for name, c in profile.SKETCHED.items()])
    rows = lambda df, v: df.unpivot([], list(profile.SKETCHED), "kind", v)
    both = rows(exact, "exact").join(rows(found, "estimate"), "kind")
    return both.select("kind", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_pct"))


@query(f"WITH {MONTH_SQL} SELECT day, max(n) AS max_flow FROM ({_FLOWS}) GROUP BY day")
def max_flow(spark: SparkSession, sf: str) -> DataFrame:
    return profile.max_flow(_flows(spark, sf))


@query(f"WITH {EVENT_SQL} SELECT day, dst_port, count(*) AS n FROM ev WHERE proto = 'UDP' AND dst_port IN ({TCP_ONLY}) GROUP BY day, dst_port")
def udp_on_tcp_ports(spark: SparkSession, sf: str) -> DataFrame:
    return profile.udp_on_tcp(_logs(spark, sf, False))


@query("SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS log_count FROM lineitem GROUP BY 1")
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.daily_counts(fx.item_logs(spark, sf))


@query(f"WITH {EVENT_SQL} SELECT src_ip, count(*) AS n FROM ev WHERE day = DATE '2024-01-10' GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def top_src_day(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_sources_of_day(fx.event_logs(spark, sf), "2024-01-10")


@query(f"WITH {fx.ITEM_SQL} SELECT src_ip, count(*) AS n, count(DISTINCT nat_ip) AS nat_ips FROM li GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def top_src_period(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_sources_of_period(fx.item_logs(spark, sf))


# anomalies

DAILY_SQL = "dc AS (SELECT day, count(*) AS log_count FROM ev GROUP BY day)"


def anomaly_sql(ratio: float, least: int, t: str = "dc") -> str:
    return f"""an AS (SELECT day, log_count, expected_count, log_count / expected_count AS ratio FROM (
      SELECT day, log_count, count(*) OVER w AS before, avg(CASE WHEN log_count > 0 THEN log_count END) OVER w AS expected_count FROM {t}
      WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
      WHERE log_count >= {least} AND before >= 3 AND expected_count >= {least} / 10.0 AND log_count / expected_count >= {ratio})"""


ITEM_DAILY_SQL = "dc AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS log_count FROM lineitem GROUP BY 1)"


@query(f"WITH {ITEM_DAILY_SQL}, {anomaly_sql(1.5, 10)} SELECT * FROM an")
def anomaly_days(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.anomaly_days(profile.daily_counts(fx.item_logs(spark, sf)), ratio=1.5, min_count=10)


#: Alerts that exist already: the days over 1.05 times their baseline.
ALERT_RATIO = 1.05


def event_daily(spark: SparkSession, sf: str) -> DataFrame:
    return profile.daily_counts(fx.event_logs(spark, sf))


@query(
    f"""WITH {EVENT_SQL}, {DAILY_SQL}, {anomaly_sql(1.02, 5)} SELECT * FROM an WHERE ratio < {ALERT_RATIO} AND day <= DATE '2024-01-25'"""
)
def anomaly_new_only(spark: SparkSession, sf: str) -> DataFrame:
    daily = event_daily(spark, sf)
    found = anomaly.anomaly_days(daily, ratio=1.02, min_count=5)
    alerts = anomaly.anomaly_days(daily, ratio=ALERT_RATIO, min_count=5)
    catalog = daily.where("day <= DATE '2024-01-25'").select("day")
    return anomaly.new_only(found, alerts, catalog)


# classes: the rules' volumes scaled to the tables' size

SCALE = classify.Scale(volume=1000, spread=20)
GATES = {"ntp_gate": 20, "dns_gate": 50, "suspect_ports": 5}


def _round(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n} + 0.5::DOUBLE) / {10**n}.0::DOUBLE"


def stats_sql(t: str) -> str:
    """Common-table expressions that end in ``st``: a row of statistics per day."""
    detail = lambda name, port, gate: (
        f"{name} AS (SELECT day, count(DISTINCT src_ip) AS {name}_clients, count(DISTINCT dst_ip) AS {name}_servers FROM {t} WHERE dst_port = {port} GROUP BY day HAVING count(*) >= {gate})"
    )
    ports = "greatest(well_known + registered + ephemeral, 1)"
    return f"""g AS ({globals_sql(t)}), src AS ({sources_sql(t)}), tt AS (SELECT * FROM {_ranked('SELECT * FROM src', 'connections DESC, src_ip', 1)}),
    sp AS (SELECT day, count(*) FILTER (WHERE dst_ports > {GATES['suspect_ports']}) AS suspects, {_round('avg(dst_ports)', 1)} AS avg_ports FROM src GROUP BY day),
    {detail('ntp', 123, GATES['ntp_gate'])}, {detail('dns', 53, GATES['dns_gate'])},
    ut AS (SELECT day, count(*) AS udp_on_tcp FROM {t} WHERE proto = 'UDP' AND dst_port IN ({TCP_ONLY}) GROUP BY day),
    mf AS (SELECT day, max(n) AS max_flow FROM (SELECT day, count(*) AS n FROM {t} GROUP BY day, src_ip, dst_ip, dst_port, proto) GROUP BY day),
    s0 AS (SELECT g.day, total, unique_src, unique_dst, unique_dst_ports, suspects, avg_ports, {_round('connections / total * 100', 1)} AS tt_pct,
      {_round(f'well_known / {ports}', 3)} AS wk_pct, {_round(f'registered / {ports}', 3)} AS reg_pct, {_round(f'ephemeral / {ports}', 3)} AS eph_pct,
      g.dns, {_round('g.dns / total', 4)} AS dns_pct, {_round('g.http / total', 4)} AS http_pct, g.ntp, {_round('g.ntp / total', 4)} AS ntp_pct,
      tt.dst_ports AS tt_ports, tt.dst_ips AS tt_ips, {_round('tt.well_known_pct', 1)} AS tt_wk_pct, coalesce(ntp_clients, 0) AS ntp_clients, coalesce(ntp_servers, 0) AS ntp_servers,
      coalesce(dns_clients, 0) AS dns_clients, coalesce(dns_servers, 0) AS dns_servers, coalesce(max_flow, 0) AS max_flow, coalesce(udp_on_tcp, 0) AS udp_on_tcp,
      {_round('coalesce(udp_on_tcp, 0) / total', 4)} AS udp_pct
      FROM g LEFT JOIN tt ON g.day = tt.day LEFT JOIN sp ON g.day = sp.day LEFT JOIN ntp ON g.day = ntp.day LEFT JOIN dns ON g.day = dns.day
      LEFT JOIN ut ON g.day = ut.day LEFT JOIN mf ON g.day = mf.day),
    st AS (SELECT *, {_round('tt_pct / 100', 3)} AS top_pct FROM s0)"""


def _points(*cases: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {x}::DOUBLE" for c, x in cases) + " ELSE 0::DOUBLE END"


def _less(score: str, condition: str, x: float) -> str:
    return f"CASE WHEN {condition} THEN greatest({score} - {x}::DOUBLE, 0::DOUBLE) ELSE {score} END"


# Written apart from the engine's rules: volumes are a thousandth, distinct counts a twentieth of the classes' own thresholds.
_CANDIDATE = "CASE WHEN {0} >= 0.30 THEN least({0}, 1::DOUBLE) ELSE 0::DOUBLE END"
SCORES_SQL = f"""q AS (SELECT *,
    {_points(('tt_ports >= 100 AND tt_ips >= 100', 0.30), ('tt_ports >= 25 AND tt_ips >= 25', 0.15))} AS p1,
    p1 + {_points(('suspects >= 1 AND avg_ports >= 5', 0.30), ('suspects >= 0.25 AND avg_ports >= 2.5', 0.15))} AS p2,
    p2 + {_points(('eph_pct >= 0.30 AND unique_dst_ports >= 150', 0.20), ('reg_pct + eph_pct >= 0.70 AND unique_dst_ports >= 75', 0.10))} AS p3,
    p3 + {_points(('unique_dst >= 500', 0.15), ('unique_dst >= 150 AND p3 >= 0.15', 0.08))} AS p4,
    p4 + {_points(('http_pct < 0.10 AND dns_pct < 0.20 AND p4 >= 0.15', 0.10))} AS p5,
    {_less('p5', 'http_pct >= 0.50', 0.20)} AS p6, {_less('p6', 'wk_pct >= 0.70', 0.15)} AS p7, {_less('p7', 'max_flow >= 5', 0.20)} AS p8,
    ntp >= 100 AND ntp_pct >= 0.02 AS n0,
    {_points(('n0 AND ntp_clients <= 3', 0.70), ('n0 AND ntp_clients <= 10', 0.50))} AS n1, n1 + {_points(('n0 AND ntp_servers >= 2.5', 0.15))} AS n2,
    dns >= 500 AND dns_pct >= 0.15 AS d0,
    {_points(('d0 AND dns_clients <= 5', 0.60), ('d0 AND dns_servers <= 3 AND dns_clients >= 1', 0.55))} AS d1,
    d1 + {_points(('d0 AND dns_servers >= 5 AND dns_clients <= 5', 0.15))} AS d2,
    {_points(('top_pct >= 0.80 AND unique_dst <= 10', 0.55), ('top_pct >= 0.60 AND unique_dst <= 20', 0.35))} AS o1,
    o1 + {_points(('unique_src <= 5 AND unique_dst <= 5', 0.25))} AS o2, o2 + {_points(('unique_dst_ports <= 5 AND o2 >= 0.25', 0.15))} AS o3,
    {_less('o3', 'unique_dst >= 50', 0.30)} AS o4, {_less('o4', 'suspects >= 0.5', 0.15)} AS o5,
    {_points(('unique_src <= 10 AND unique_dst_ports >= 50', 0.55), ('unique_src <= 5 AND unique_dst_ports >= 25', 0.40))} AS v1,
    v1 + {_points(('unique_dst >= 25 AND unique_src <= 10', 0.20))} AS v2, {_less('v2', 'unique_src >= 1.5', 0.25)} AS v3,
    {_points(('unique_src >= 1.5 AND unique_dst <= 10 AND unique_dst_ports <= 5', 0.70), ('unique_src >= 1 AND unique_dst <= 15 AND unique_dst_ports <= 8', 0.45))} AS b1,
    b1 + {_points(('unique_src >= 1.5 AND top_pct <= 0.15', 0.15))} AS b2, b2 + {_points(('udp_on_tcp >= 5 AND b2 >= 0.20', 0.15))} AS b3,
    top_pct >= 0.50 AND {_CANDIDATE.format('p8')} < 0.40 AND {_CANDIDATE.format('o5')} < 0.35 AS w0,
    {_points(('w0 AND tt_wk_pct >= 30 AND tt_ports < 25', 0.50), ('w0 AND unique_src >= 3', 0.35))} AS w1,
    {_points(('max_flow >= 500', 0.90), ('max_flow >= 100', 0.80), ('max_flow >= 10', 0.65), ('max_flow >= 1', 0.45))} AS f1,
    {_points(('udp_on_tcp >= 10 AND udp_pct >= 0.01', 0.60), ('udp_on_tcp >= 1', 0.40))} AS m1, m1 + {_points(('m1 >= 0.30 AND f1 >= 0.30', 0.20))} AS m2
  FROM st),
  sc AS (""" + " UNION ALL ".join(
    f"SELECT day, '{name}' AS category, {_CANDIDATE.format(last)} AS score, {k} AS place FROM q"
    for k, (last, name) in enumerate((
        ("p8", "P2P/Torrent"), ("n2", "Abuso de Protocolo (NTP)"), ("d2", "Abuso de Protocolo (DNS)"), ("o5", "Ataque/DoS"), ("v3", "Varredura de Portas"),
        ("b3", "Botnet/C2"), ("w1", "Abuso de Banda"), ("f1", "Flood/Loop/Tráfego Automatizado"), ("m2", "Malware/Comportamento Anômalo"),
    ))
) + ")"
BEST_SQL = """be AS (SELECT day, CASE WHEN score > 0.30 THEN category ELSE 'Alto Volume (Indeterminado)' END AS category,
  floor(greatest(score, 0.30::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, place) AS rn FROM sc) WHERE rn = 1)"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = report.day_stats(fx.months(fx.item_logs(spark, sf)), **GATES)
    return stats.select("day", *classify.STATS)


@query(f"WITH {MONTH_SQL}, {stats_sql('mo')}, {SCORES_SQL} SELECT day, category, score FROM sc")
def classify_scores(spark: SparkSession, sf: str) -> DataFrame:
    return classify.long_scores(classify.scores(_stats(spark, sf), SCALE))


@query(f"WITH {MONTH_SQL}, {stats_sql('mo')}, {SCORES_SQL}, {BEST_SQL} SELECT * FROM be")
def classify_best(spark: SparkSession, sf: str) -> DataFrame:
    return classify.best(classify.scores(_stats(spark, sf), SCALE)).select("day", "category", "score")


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return report.classified(report.day_report(fx.event_logs(spark, sf), **GATES), SCALE)


@query()
def day_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.day_report(fx.event_logs(spark, sf), **GATES)


_E_FLOWS = "SELECT day, src_ip, dst_ip, dst_port, proto, count(*) AS n FROM ev GROUP BY ALL"


def _list_sql(name: str, ranked: str, subject: str, n: str, digits: int | None) -> str:
    share = _round(f"{n} / total * 100", digits) if digits else "CAST(NULL AS DOUBLE)"
    return f"SELECT day, '{name}' AS list, rank, {subject} AS subject, {n} AS n, {share} AS pct FROM (SELECT x.*, g.total FROM (SELECT * FROM {ranked}) x JOIN g ON x.day = g.day)"


@query(
    f"WITH {EVENT_SQL}, g AS (SELECT day, count(*) AS total FROM ev GROUP BY day), " + "src AS (" + sources_sql("ev") + ") "
    + " UNION ALL ".join((
        _list_sql("top_sources", _ranked("SELECT * FROM src", "connections DESC, src_ip", 10), fx.ip_sql("src_ip"), "connections", 1),
        _list_sql("top_ports", _ranked("SELECT day, dst_port, count(*) AS n FROM ev GROUP BY day, dst_port", "n DESC, dst_port", 10), "CAST(dst_port AS VARCHAR)", "n", 2),
        _list_sql("top_destinations", _ranked("SELECT day, dst_ip, count(*) AS n FROM ev GROUP BY day, dst_ip", "n DESC, dst_ip", 10), fx.ip_sql("dst_ip"), "n", 2),
        _list_sql("top_flows", _ranked(_E_FLOWS, "n DESC, src_ip, dst_ip, dst_port, proto", 5), f"concat({fx.ip_sql('src_ip')}, '>', {fx.ip_sql('dst_ip')}, ':', dst_port, ' ', proto)", "n", None),
        _list_sql("affected_ports", _ranked(f"SELECT day, dst_port, count(*) AS n FROM ev WHERE proto = 'UDP' AND dst_port IN ({TCP_ONLY}) GROUP BY day, dst_port", "n DESC, dst_port", 10), "CAST(dst_port AS VARCHAR)", "n", None),
    ))
)
def day_report_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every list of the day reports as rows, with the shares."""
    r = report.day_report(fx.event_logs(spark, sf), **GATES)
    subject = {
        "top_sources": ("x.ip", "x.connections", "x.pct"), "top_ports": ("CAST(x.dst_port AS STRING)", "x.n", "x.pct"), "top_destinations": ("x.ip", "x.n", "x.pct"),
        "top_flows": ("concat(x.src, '>', x.dst, ':', x.dst_port, ' ', x.proto)", "x.n", "CAST(NULL AS DOUBLE)"), "affected_ports": ("CAST(x.dst_port AS STRING)", "x.n", "CAST(NULL AS DOUBLE)"),
    }
    parts = [
        f"transform({c}, (x, i) -> struct('{c}' AS list, i + 1 AS rank, {s} AS subject, {n} AS n, {p} AS pct))" for c, (s, n, p) in subject.items()
    ]
    return r.select("day", F.inline(F.flatten(F.array_compact(F.array(*map(F.expr, parts))))))


@query()
def alert_details_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.details_json(_report(spark, sf))


@query(
    f"""WITH {EVENT_SQL}, {stats_sql('ev')}, {SCORES_SQL}, {BEST_SQL}, ls AS (SELECT day, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_port) AS ports FROM ev GROUP BY day)
    SELECT st.day, category, score, total, unique_src, dns, ntp, wk_pct, eph_pct, tt_pct, max_flow, least(sources, 10) AS sources_listed, least(ports, 10) AS ports_listed
    FROM st JOIN be ON st.day = be.day JOIN ls ON st.day = ls.day"""
)
def alert_details_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read back from the JSON texts."""
    fields = "category string, score double, total long, unique_src long, dns long, ntp long, wk_pct double, eph_pct double, tt_pct double, max_flow long"
    d = report.details_json(_report(spark, sf)).withColumn("x", F.from_json("details", f"{fields}, top_sources array<string>, top_ports array<string>"))
    return d.select("day", *[f"x.{c.split()[0]}" for c in fields.split(", ")], F.size("x.top_sources").cast("long").alias("sources_listed"), F.size("x.top_ports").cast("long").alias("ports_listed"))


_PROTO = {"dns": "dst_port = 53", "http": "dst_port IN (80, 443)", "ntp": "dst_port = 123", "ssh": "dst_port = 22", "rdp": "dst_port = 3389", "email": f"dst_port IN ({MAIL})"}


@query(
    f"WITH {EVENT_SQL}, p AS (" + " UNION ALL ".join(f"SELECT day, 'traffic' AS kind, '{p}' AS protocol, count(*) FILTER (WHERE {w}) AS n FROM ev GROUP BY day" for p, w in _PROTO.items())
    + ") SELECT * FROM p WHERE n > 0"
)
def alert_protocol_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.protocol_rows(report.details_json(report.day_stats(fx.event_logs(spark, sf), **GATES)))


@query()
def alert_narrative(spark: SparkSession, sf: str) -> DataFrame:
    return report.narrative(_report(spark, sf), flow_least=2, udp_least=5)


@query(
    f"""WITH {EVENT_SQL}, {stats_sql('ev')}, {SCORES_SQL}, {BEST_SQL}
    SELECT day, concat(format('{{:,}}', total), ' connections were logged.') AS line FROM st
    UNION ALL SELECT st.day, concat('The busiest source, ', {fx.ip_sql('src_ip')}, ', made ', format('{{:,}}', connections), ' connections, ', printf('%.1f%%', tt_pct), ' of all, to ', format('{{:,}}', dst_ips), ' addresses and ', format('{{:,}}', dst_ports), ' ports (',
      CASE WHEN dst_ports >= 500 AND dst_ips >= 500 THEN 'distributed' WHEN dst_ports <= 20 AND dst_ips <= 20 THEN 'concentrated' ELSE 'mixed' END, ').') FROM st JOIN tt ON st.day = tt.day
    UNION ALL SELECT day, concat('Judged as ', category, ', certainty ', printf('%.0f%%', score * 100), '.') FROM be"""
)
def alert_narrative_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The texts' lines on the volume, the busiest source and the class."""
    lines = report.narrative(_report(spark, sf), flow_least=2, udp_least=5).select("day", F.explode(F.split("analysis", "\n")).alias("line"))
    return lines.where(F.col("line").startswith("The busiest source") | F.col("line").startswith("Judged as") | F.col("line").endswith("connections were logged."))


@query()
def alerts_generate(spark: SparkSession, sf: str) -> DataFrame:
    logs, daily = fx.event_logs(spark, sf), event_daily(spark, sf)
    old = anomaly.anomaly_days(daily, ratio=1.10, min_count=5)
    return report.generate_alerts(logs, daily, old, daily.select("day"), ratio=1.02, min_count=5, scale=SCALE, ntp_gate=20, dns_gate=50, suspect_ports=5)


@query(
    f"""WITH {EVENT_SQL}, {DAILY_SQL}, {anomaly_sql(1.02, 5)}, {stats_sql('ev')}, {SCORES_SQL}, {BEST_SQL}
    SELECT an.day, log_count, expected_count, ratio, category AS classification, score FROM an JOIN be ON an.day = be.day WHERE ratio < 1.10"""
)
def alerts_generated(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts without their texts."""
    return alerts_generate(spark, sf).drop("analysis", "details")

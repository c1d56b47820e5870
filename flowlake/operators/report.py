"""Day reports: the profile queries assembled per day, as statistics, nested rows, JSON and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..sources import lake
from . import anomaly, classify, profile


def rounded(c: Column, n: int) -> Column:
    """Half up, in plain double arithmetic that any SQL engine repeats."""
    return F.floor(c * 10**n + F.lit(0.5)) / F.lit(float(10**n))


def by_day(parts: list[DataFrame]) -> DataFrame:
    """Parts with one row per day each, side by side: one aggregation in place of a join for each."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("day").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != "day"])


def stored_parts(logs: DataFrame, flows: DataFrame) -> list[DataFrame]:
    """What a report's parts follow from, written: each day's counts by value, the profile of every source, and what is wanted of the flows."""
    return lake.written_together({"values": profile.day_values(logs), "sources": profile.source_profiles(logs), "flows": flows})


def _stat_parts(values: DataFrame, sources: DataFrame, ntp_gate: int, dns_gate: int, suspect_ports: int) -> list[DataFrame]:
    best = profile.top_k(sources, 1, [F.desc("connections"), "src_ip"])
    talker = profile.first_source(best).select(
        "day", F.col("src_ip").alias("tt_ip"), F.col("connections").alias("tt_connections"), F.col("dst_ports").alias("tt_ports"), F.col("dst_ips").alias("tt_ips"),
        rounded(F.col("well_known_pct"), 1).alias("tt_wk_pct"), rounded(F.col("ephemeral_pct"), 1).alias("tt_eph_pct"), F.col("profile").alias("tt_profile"),
    )
    details = profile.details_from(values, {123: ("ntp", ntp_gate), 53: ("dns", dns_gate)})
    udp = profile.udp_from(values).groupBy("day").agg(F.sum("n").alias("udp_on_tcp"))
    return [profile.globals_from(values), profile.spread_of(sources, suspect_ports), talker, details, udp]


def _shares(days: DataFrame) -> DataFrame:
    """Fills what a day lacks and adds the shares, rounded as in the report."""
    counts = ["suspects", "tt_ports", "tt_ips", "ntp_clients", "ntp_servers", "dns_clients", "dns_servers", "udp_on_tcp", "max_flow"]
    ports = F.greatest(F.col("well_known") + F.col("registered") + F.col("ephemeral"), F.lit(1))
    of = lambda c, n=4: rounded(F.col(c) / F.col("total"), n)
    return days.na.fill(0, counts).withColumns(
        {
            "avg_ports": rounded(F.coalesce("avg_ports", F.lit(0.0)), 1),
            "tt_wk_pct": F.coalesce("tt_wk_pct", F.lit(0.0)),
            "tt_pct": F.coalesce(rounded(F.col("tt_connections") / F.col("total") * 100, 1), F.lit(0.0)),
            "wk_pct": rounded(F.col("well_known") / ports, 3), "reg_pct": rounded(F.col("registered") / ports, 3), "eph_pct": rounded(F.col("ephemeral") / ports, 3),
            "dns_pct": of("dns"), "http_pct": of("http"), "ntp_pct": of("ntp"), "ssh_pct": of("ssh"), "udp_pct": of("udp_on_tcp"),
        }
    ).withColumn("top_pct", rounded(F.col("tt_pct") / 100, 3))


def day_stats(logs: DataFrame, ntp_gate: int = 50_000, dns_gate: int = 200_000, suspect_ports: int = 50) -> DataFrame:
    """One flat row per day with the columns in ``classify.STATS``; shares are rounded as in the report."""
    values, sources, flow = stored_parts(logs, profile.max_flow(profile.flows(logs)))
    return _shares(by_day([*_stat_parts(values, sources, ntp_gate, dns_gate, suspect_ports), flow]))


def _listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
    """The ranked rows of each day as an array; at most k per day."""
    items = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return df.groupBy("day").agg(F.transform(items, lambda x: x.dropFields("rank")).alias(name))


def day_report(logs: DataFrame, ntp_gate: int = 50_000, dns_gate: int = 200_000, suspect_ports: int = 50, k: int = 10, days: DataFrame | None = None) -> DataFrame:
    """The whole report, one nested row per day: statistics and the top lists.

    The logs are read three times, each time aggregated before they are shuffled: by value, by source and by flow.
    The three are written by jobs at the same time.
    """
    if days is not None:
        logs = logs.join(days.select("day").distinct(), "day", "left_semi")
    values, sources, flows = stored_parts(logs, profile.top_flows(profile.flows(logs), 5))
    text = lambda c: net.ip_text(F.col(c))
    best = profile.top_k(sources, k, [F.desc("connections"), "src_ip"]).withColumn("ip", text("src_ip"))
    udp = profile.udp_from(values).withColumn("service", net.service_name(F.col("dst_port")))
    udp = profile.top_k(udp, len(net.TCP_ONLY_PORTS), [F.desc("n"), "dst_port"])
    flows = flows.withColumns({"src": text("src_ip"), "dst": text("dst_ip")})
    lists = [
        _listed(best, "top_sources", "ip", "connections", "dst_ips", "dst_ports", "well_known_pct", "ephemeral_pct"),
        _listed(profile.ports_from(values, k), "top_ports", "dst_port", "n", "category", "service"),
        _listed(profile.destinations_from(values, k).withColumn("ip", text("dst_ip")), "top_destinations", "ip", "n"),
        _listed(flows, "top_flows", "src", "dst", "dst_port", "proto", "n", "service"),
        _listed(udp, "affected_ports", "dst_port", "n", "service"),
    ]
    days_ = by_day([*_stat_parts(values, sources, ntp_gate, dns_gate, suspect_ports), *lists]).withColumn("max_flow", F.get("top_flows", F.lit(0))["n"])
    share = lambda name, count, n: F.transform(name, lambda x: x.withField("pct", rounded(x[count] / F.col("total") * 100, n)))
    return _shares(days_).withColumns(
        {"top_sources": share("top_sources", "connections", 1), "top_ports": share("top_ports", "n", 2), "top_destinations": share("top_destinations", "n", 2)}
    )


def classified(report: DataFrame, scale: classify.Scale = classify.Scale()) -> DataFrame:
    """The report with code, category, score, the reasons that its numbers give for the class, and causes."""
    return classify.best(classify.scores(report, scale)).select(*report.columns, "code", "category", "score", "reasons", "causes")


def details_json(report: DataFrame) -> DataFrame:
    """``(day, details)``: every column of the report as one JSON text."""
    return report.select("day", F.to_json(F.struct(*[c for c in report.columns if c != "day"])).alias("details"))


PROTOCOLS = ("dns", "http", "ntp", "ssh", "rdp", "email")


def protocol_rows(details: DataFrame) -> DataFrame:
    """``(day, protocol, n, kind)`` read back from the JSON: protocols with connections, and whether it is a traffic alert."""
    schema = ", ".join(f"{p} long" for p in PROTOCOLS)
    d = details.withColumn("d", F.from_json("details", schema)).withColumn(
        "kind", F.when(F.get_json_object("details", "$.wk_pct").isNotNull(), "traffic").otherwise("watchdog")
    )
    rows = F.array(*[F.struct(F.lit(p).alias("protocol"), F.col(f"d.{p}").alias("n")) for p in PROTOCOLS])
    return d.select("day", "kind", F.inline(rows)).where("n > 0")


def _count(c: Column) -> Column:
    return F.format_number(c, 0)


def narrative(report: DataFrame, flow_least: int = 1000, udp_least: int = 100) -> DataFrame:
    """``(day, analysis)``: the report as text; paragraphs without a cause are left out.

    Reads log_count, expected_count and ratio where the report has them.
    """
    c = F.col
    have = {"log_count", "expected_count", "ratio"} <= set(report.columns)
    plain = F.format_string("%s connections were logged.", _count(c("total")))
    volume = F.when(
        (c("ratio") > 0) & (c("expected_count") > 0),
        F.format_string("%s lines were logged where %s are usual: a factor of %.1f.", _count(c("log_count")), _count(c("expected_count")), c("ratio")),
    ).otherwise(plain) if have else plain
    pct = lambda x, n=0: F.format_string(f"%.{n}f%%", c(x) * 100)
    ports = F.concat(F.lit("Destination ports below 1024 take "), pct("wk_pct"), F.lit(", those up to 49151 "), pct("reg_pct"), F.lit(", higher ones "), pct("eph_pct"), F.lit("."))
    named = [("NTP", "ntp", 0.005), ("DNS", "dns", 0.01), ("web", "http", 0.01), ("SSH", "ssh", 0.005)]
    shown = F.concat_ws(", ", *[F.when(c(f"{p}_pct") >= least, F.concat(F.lit(f"{n} "), pct(f"{p}_pct", 1), F.lit(" of all ("), _count(c(p)), F.lit(")"))) for n, p, least in named])
    first = F.get("top_flows", F.lit(0))
    service = F.when(first["service"] != "", F.concat(F.lit(" = "), first["service"])).otherwise("")
    flow = F.when(
        c("max_flow") >= flow_least,
        F.concat(F.lit("One flow came "), _count(c("max_flow")), F.lit(" times: "), first["proto"], F.lit(" from "), first["src"], F.lit(" to "), first["dst"], F.lit(", port "), first["dst_port"].cast("string"), service, F.lit(".")),
    )
    some = F.array_join(F.transform(F.slice("affected_ports", 1, 5), lambda p: F.concat(p["dst_port"].cast("string"), F.lit(" "), F.coalesce(F.nullif(p["service"], F.lit("")), F.lit("?")))), ", ")
    udp = F.when(c("udp_on_tcp") >= udp_least, F.concat(F.lit("Ports that only TCP serves got "), _count(c("udp_on_tcp")), F.lit(" UDP connections, "), pct("udp_pct", 2), F.lit(" of all: "), some, F.lit(".")))
    talker = F.concat(
        F.lit("The busiest source, "), net.ip_text(c("tt_ip")), F.lit(", made "), _count(c("tt_connections")), F.lit(" connections, "), F.format_string("%.1f%%", c("tt_pct")),
        F.lit(" of all, to "), _count(c("tt_ips")), F.lit(" addresses and "), _count(c("tt_ports")), F.lit(" ports ("), c("tt_profile"), F.lit(")."),
    )
    verdict = F.concat(F.lit("Judged as "), c("category"), F.lit(", certainty "), F.format_string("%.0f%%", c("score") * 100), F.lit("."))
    items = lambda column, mark: F.nullif(F.array_join(F.transform(column, lambda x: F.concat(F.lit(mark), x)), "\n"), F.lit(""))
    why = items(c("reasons"), "  + ")
    causes = F.concat(F.lit("What may stand behind it:\n"), items(F.slice("causes", 1, 3), "  - "))
    protocols = F.when(shown != "", F.concat(F.lit("Services: "), shown, F.lit(".")))
    return report.select("day", F.concat_ws("\n", volume, ports, protocols, flow, udp, talker, verdict, why, causes).alias("analysis"))


def generate_alerts(
    logs: DataFrame, daily: DataFrame, alerts: DataFrame, catalog: DataFrame, ratio: float = 3.0, min_count: int = 100_000, force: bool = False,
    only_day: str | None = None, scale: classify.Scale = classify.Scale(), ntp_gate: int = 50_000, dns_gate: int = 200_000, suspect_ports: int = 50,
) -> DataFrame:
    """Candidates, reports, classes and alerts of all candidate days in one plan.

    The logs are cut to the candidate days by a semi join before anything is aggregated.
    """
    found = anomaly.forced_day(daily, only_day) if only_day else anomaly.anomaly_days(daily, ratio=ratio, min_count=min_count)
    found = anomaly.new_only(found, alerts, catalog, force or only_day is not None)
    found = lake.written(found, "candidates")  # one row per candidate day
    report = lake.written(classified(day_report(logs, ntp_gate, dns_gate, suspect_ports, days=found), scale).join(found, "day"), "report")
    return (
        report.select("day", "log_count", "expected_count", "ratio", F.col("category").alias("classification"), "score")
        .join(narrative(report), "day")
        .join(details_json(report), "day")
    )

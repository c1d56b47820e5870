"""Legacy tables in four layouts, normalised to the canonical columns.

Tables come as DataFrames from any Spark source. Names stay text, an address is its own key, and
signed 32-bit addresses are masked wherever they are met.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..schemas import LOG_COLUMNS
from . import lake


# The tables that tell the layouts apart. The table and column names below are those of the layouts too.
V2_TABLE, B_TABLES, C_TABLES = "ip_addresses", {"d_interfaces", "d_protocols"}, {"db_meta", "interfaces", "protocols", "conn_states"}


def layout(tables: set[str]) -> str:
    """v2, b, c or a, from the table names; any other set of tables is read as a."""
    if V2_TABLE in tables:
        return "v2"
    if B_TABLES & tables:
        return "b"
    return "c" if C_TABLES <= tables else "a"


#: Tables that each layout's normaliser takes, in order.
NEEDS = {
    "v2": ("logs", "ip_addresses", "interfaces", "protocols", "conn_states"), "b": ("logs", "d_interfaces", "d_protocols", "d_states"),
    "c": ("logs", "interfaces", "protocols", "conn_states"), "a": ("logs",),
}


#: Names the source of a row where tables of several sources stand together.
SOURCE = "_source"


def normalise(tables: dict[str, DataFrame], kind: str | None = None) -> DataFrame:
    """Canonical rows of a legacy source's tables, whatever its layout; of several sources' if all tables name them in SOURCE."""
    kind = kind or layout(set(tables))
    if lost := [t for t in NEEDS[kind] if t not in tables]:
        raise ValueError(f"a source in layout {kind} lacks {', '.join(lost)}")
    return {"v2": normalise_v2, "b": normalise_b, "c": normalise_c, "a": normalise_a}[kind](*(tables[t] for t in NEEDS[kind]))


def import_sources(spark: SparkSession, sources: dict[str, dict[str, DataFrame]], path: str, overwrite: bool = False) -> DataFrame:
    """Imports legacy sources, name -> tables, into the lake; returns a summary ``(source, layout, day, rows, state)``.

    The name holds the day, as those of the files do, and all of a source's rows belong to it. A day
    that the lake has is skipped (state ``skipped``, no rows) unless ``overwrite``; a source without a
    day in its name or without its layout's tables has the state ``failed`` and changes nothing. All
    that is imported is one job; several sources of one day are added together. The sources' tables of one layout are put
    together before they are joined, by source, so there are no more joins for a thousand sources than for one.
    """
    have = set() if overwrite else set(lake.days_in(spark, path))
    ready: dict[str, list[dict[str, DataFrame]]] = {}
    summary = []
    for name, tables in sources.items():
        found, kind = re.search(r"\d{4}-\d{2}-\d{2}", name), layout(set(tables))
        day = found[0] if found else None
        if day is None or any(t not in tables for t in NEEDS[kind]):
            summary.append((name, kind, day, None, "failed"))
        elif day in have:
            summary.append((name, kind, day, None, "skipped"))
        else:
            ready.setdefault(kind, []).append({t: tables[t].withColumn(SOURCE, F.lit(name)) for t in NEEDS[kind]})
            summary.append((name, kind, day, None, "imported"))
    out = spark.createDataFrame(summary, "source string, layout string, day string, rows long, state string").withColumn("day", F.to_date("day"))
    if not ready:
        return out
    together = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole = [normalise({t: together([x[t] for x in own]) for t in NEEDS[kind]}, kind) for kind, own in ready.items()]
    days = spark.createDataFrame([(n, d) for n, _, d, _, state in summary if state == "imported"], "source string, d string")
    rows = reduce(DataFrame.unionByName, whole).withColumnRenamed(SOURCE, "source").drop("day").join(days, "source").withColumn("day", F.to_date("d"))
    rows = lake.written(rows.select(*LOG_COLUMNS, "source"), "legacy")
    lake.import_days(rows.drop("source"), path, overwrite)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("state") == "imported", F.coalesce("n", F.lit(0).cast("long")))
    return out.join(counts, "source", "left").withColumn("rows", n).drop("n")


def masked(c: Column) -> Column:
    return c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _of(d: DataFrame) -> list[str]:
    return [SOURCE] if SOURCE in d.columns else []


def _named(rows: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(dim.select(*_of(dim), F.col("id").alias(key), F.col("name").alias(name)), [*_of(dim), key], "left")


def _canonical(d: DataFrame, **columns: Column) -> DataFrame:
    d = d.withColumns(columns)
    return d.withColumn("day", net.epoch_day(F.col("ts"))).select(*LOG_COLUMNS, *_of(d))


def normalise_v2(logs: DataFrame, ip_addresses: DataFrame, interfaces: DataFrame, protocols: DataFrame, states: DataFrame) -> DataFrame:
    """Own address dictionary: three left joins; unknown source and destination become 0, an unknown NAT address null."""
    ips = ip_addresses.select(*_of(ip_addresses), "id", net.ip_value(F.col("ip")).alias("name"))
    d = logs
    for role in ("src", "dst", "nat"):
        d = _named(d, ips, f"{role}_ip_id", f"{role}_ip")
    d = _named(_named(d, interfaces, "in_iface_id", "in_iface"), interfaces, "out_iface_id", "out_iface")
    d = _named(_named(d, protocols, "proto_id", "proto"), states, "conn_state_id", "conn_state")
    zero = F.lit(0).cast("long")
    return _canonical(
        d, ts=F.col("ts").cast("long"), has_snat=F.coalesce(F.col("has_snat").cast("boolean"), F.lit(False)), src_ip=F.coalesce("src_ip", zero),
        dst_ip=F.coalesce("dst_ip", zero), log_type=F.coalesce("log_type", F.lit("nat")),
        **{c: F.col(c).cast("int") for c in ("src_port", "dst_port", "nat_port", "pkt_len")},
    )


def normalise_b(logs: DataFrame, interfaces: DataFrame, protocols: DataFrame, states: DataFrame) -> DataFrame:
    """Inline integer addresses and other column names; no flags, lengths or translation flag."""
    d = logs.select(
        *_of(logs), F.col("timestamp").cast("long").alias("ts"), F.col("interface_in_id").alias("in_iface_id"), F.col("interface_out_id").alias("out_iface_id"),
        F.col("protocol_id").alias("proto_id"), F.col("state_id").alias("conn_state_id"), "src_ip_priv", "src_port_priv", "dst_ip", "dst_port", "nat_ip_pub", "nat_port_pub",
    )
    d = _named(_named(d, interfaces, "in_iface_id", "in_iface"), interfaces, "out_iface_id", "out_iface")
    d = _named(_named(d, protocols, "proto_id", "proto"), states, "conn_state_id", "conn_state")
    zero = F.lit(0).cast("long")
    return _canonical(
        d, has_snat=F.lit(False), src_ip=F.coalesce(masked(F.col("src_ip_priv")), zero), src_port=F.col("src_port_priv").cast("int"),
        dst_ip=F.coalesce(masked(F.col("dst_ip")), zero), dst_port=F.col("dst_port").cast("int"), nat_ip=masked(F.col("nat_ip_pub")),
        nat_port=F.col("nat_port_pub").cast("int"), pkt_len=F.lit(None).cast("int"), tcp_flags=F.lit(None).cast("string"), log_type=F.lit("nat"),
    )


def normalise_c(logs: DataFrame, interfaces: DataFrame, protocols: DataFrame, states: DataFrame) -> DataFrame:
    """Inline integer addresses, 0 for none: an address of 0 stays 0 as source or destination and is no NAT address."""
    d = _named(_named(logs, interfaces, "in_iface_id", "in_iface"), interfaces, "out_iface_id", "out_iface")
    d = _named(_named(d, protocols, "proto_id", "proto"), states, "conn_state_id", "conn_state")
    zero = F.lit(0).cast("long")
    return _canonical(
        d, ts=F.col("ts").cast("long"), has_snat=F.coalesce(F.col("has_snat").cast("boolean"), F.lit(False)),
        src_ip=F.coalesce(masked(F.col("src_ip")), zero), dst_ip=F.coalesce(masked(F.col("dst_ip")), zero),
        nat_ip=F.nullif(masked(F.col("nat_ip")), zero), log_type=F.coalesce("log_type", F.lit("nat")),
        **{c: F.col(c).cast("int") for c in ("src_port", "dst_port", "nat_port", "pkt_len")},
    )


def text_time(c: Column) -> Column:
    """A time text as UTC, else as ISO 8601, else 0."""
    t = F.trim(c)
    return F.coalesce(
        F.unix_seconds(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t), F.lit("yyyy-MM-dd HH:mm:ss"))),
        F.unix_seconds(F.try_to_timestamp(t)), F.lit(0),
    ).cast("long")


def normalise_a(logs: DataFrame) -> DataFrame:
    """Text everywhere: times, addresses and names in each row; blank names are none."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    zero = F.lit(0).cast("long")
    return _canonical(
        logs, ts=text_time(F.col("timestamp")), in_iface=blank("interface_in"), out_iface=blank("interface_out"), proto=blank("proto"),
        conn_state=F.lit(None).cast("string"), has_snat=F.lit(False), src_ip=F.coalesce(net.ip_value(F.col("src_ip_priv")), zero),
        src_port=F.col("src_port_priv").cast("int"), dst_ip=F.coalesce(net.ip_value(F.col("dst_ip")), zero), dst_port=F.col("dst_port").cast("int"),
        nat_ip=F.nullif(net.ip_value(F.col("nat_ip_pub")), zero), nat_port=F.col("nat_port_pub").cast("int"), pkt_len=F.lit(None).cast("int"),
        tcp_flags=F.lit(None).cast("string"), log_type=F.lit("nat"),
    )

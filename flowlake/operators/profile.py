"""Day profiles: every operator takes logs of any number of days and groups by ``day``.

Each takes log rows, or ``flows`` (rows counted by day, src, dst, port, proto), and reads its input
once. Distinct counts are two partially aggregated steps over (group, kind, value) rows, so neither a
day nor a source is ever one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from ..sources import lake, versions


def flows(logs: DataFrame) -> DataFrame:
    """``(day, src_ip, dst_ip, dst_port, proto, n)``."""
    return logs.groupBy("day", "src_ip", "dst_ip", "dst_port", "proto").agg(F.count(F.lit(1)).alias("n"))


def _weight(rows: DataFrame) -> Column:
    """Connections that a row stands for: a log row is one, a flow has ``n``."""
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("long")


def _values(rows: DataFrame, keys: list[str], columns: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``(keys..., kind, value, n, sums...)``: connections, and sums of other numbers, by each value of the columns; kind is the column's place.

    Grouping sets: rows are multiplied inside the generated code, without an array for each.
    """
    more = {"n": _weight(rows), **(sums or {})}
    slim = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(columns)], *[v.alias(c) for c, v in more.items()])
    keys_, values = [f"_{k}" for k in keys], [f"v{i}" for i in range(len(columns))]
    found = slim.groupingSets([[*keys_, v] for v in values], *keys_, *values).agg(*[F.sum(c).alias(c) for c in more], *[F.grouping(v).alias(f"no_{v}") for v in values])
    kind = reduce(lambda out, i: F.when(F.col(f"no_v{i}") == 0, i).otherwise(out), range(len(columns) - 1), F.lit(len(columns) - 1))
    return found.select(*[F.col(f"_{k}").alias(k) for k in keys], kind.alias("kind"), F.coalesce(*values).alias("value"), *more)


def _different(kind: int, name: str) -> Column:
    return F.count_if((F.col("kind") == kind) & F.col("value").isNotNull()).alias(name)


def _sum_if(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)


def globals_of(rows: DataFrame) -> DataFrame:
    """Totals, distinct counts, port ranges and protocol counts of each day."""
    return globals_from(_values(rows, ["day"], ["src_ip", "dst_ip", "dst_port"]))


#: Ports whose clients and servers are counted apart, and the columns of ``day_values`` with the connections to each.
DETAILED = {123: "to_123", 53: "to_53"}


def day_values(rows: DataFrame) -> DataFrame:
    """``(day, kind, value, n, udp, to_123, to_53)``: connections, those over UDP and those to some ports, by each source (kind 0), destination (1) and port (2).

    One read of the rows, from which ``globals_from``, ``ports_from``, ``destinations_from``, ``details_from`` and ``udp_from`` all follow.
    """
    n = _weight(rows)
    some = lambda condition: F.when(condition, n).otherwise(F.lit(0))
    return _values(rows, ["day"], ["src_ip", "dst_ip", "dst_port"], {"udp": some(F.col("proto") == "UDP"), **{c: some(F.col("dst_port") == p) for p, c in DETAILED.items()}})


def globals_from(values: DataFrame) -> DataFrame:
    port = F.col("kind") == 2
    p = F.when(port, F.col("value"))
    return values.groupBy("day").agg(
        _sum_if(port, "total"),
        _sum_if(p.between(0, 1023), "well_known"), _sum_if(p.between(1024, 49151), "registered"), _sum_if(p >= 49152, "ephemeral"),
        _sum_if(p == 53, "dns"), _sum_if(p.isin(80, 443), "http"), _sum_if(p == 123, "ntp"), _sum_if(p == 22, "ssh"), _sum_if(p == 3389, "rdp"),
        _sum_if(p.isin(*net.MAIL_PORTS), "email"),
        _different(0, "unique_src"), _different(1, "unique_dst"), _different(2, "unique_dst_ports"),
    )


def top_k(counts: DataFrame, k: int, order: list, keys: list[str] = ["day"]) -> DataFrame:  # noqa: B006
    """The first ``k`` rows of each day. The rank filter is pushed below the shuffle, so k rows a task are moved."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def source_profiles(rows: DataFrame) -> DataFrame:
    """Per day and source: connections, distinct destinations and ports, shares of low and high ports."""
    port = F.col("kind") == 1
    p = F.when(port, F.col("value"))
    counts = _values(rows.where("src_ip is not null"), ["day", "src_ip"], ["dst_ip", "dst_port"]).groupBy("day", "src_ip").agg(
        _sum_if(port, "connections"), _different(0, "dst_ips"), _different(1, "dst_ports"), _sum_if(p.between(0, 1023), "wk"), _sum_if(p >= 49152, "eph"),
    )
    share = lambda c: F.col(c) * 100.0 / F.col("connections")
    return counts.select("day", "src_ip", "connections", "dst_ips", "dst_ports", share("wk").alias("well_known_pct"), share("eph").alias("ephemeral_pct"))


def top_sources(rows: DataFrame, k: int = 10) -> DataFrame:
    """The day's top sources. Only the winners are profiled: the ranking needs their counts alone."""
    counts = rows.where("src_ip is not null").groupBy("day", "src_ip").agg(F.sum(_weight(rows)).alias("c"))
    best = top_k(counts, k, [F.desc("c"), "src_ip"]).select("day", "src_ip", "rank")
    return source_profiles(rows.join(best.drop("rank"), ["day", "src_ip"], "left_semi")).join(best, ["day", "src_ip"])


def first_source(sources: DataFrame, wide: int = 500, narrow: int = 20) -> DataFrame:
    """Each day's first row of ``source_profiles``, with its profile."""
    profile = (
        F.when((F.col("dst_ports") >= wide) & (F.col("dst_ips") >= wide), "distributed")
        .when((F.col("dst_ports") <= narrow) & (F.col("dst_ips") <= narrow), "concentrated")
        .otherwise("mixed")
    )
    return sources.withColumn("profile", profile)


def talker_profile(rows: DataFrame, wide: int = 500, narrow: int = 20) -> DataFrame:
    """The day's first source and its profile."""
    return first_source(top_sources(rows, 1).drop("rank"), wide, narrow)


def top_ports(rows: DataFrame, k: int = 10) -> DataFrame:
    counts = rows.where("dst_port is not null").groupBy("day", "dst_port").agg(F.sum(_weight(rows)).alias("n"))
    return top_k(counts, k, [F.desc("n"), "dst_port"]).select(
        "day", "rank", "dst_port", "n", net.port_category(F.col("dst_port")).alias("category"), net.service_name(F.col("dst_port")).alias("service")
    )


def top_destinations(rows: DataFrame, k: int = 10) -> DataFrame:
    counts = rows.where("dst_ip is not null").groupBy("day", "dst_ip").agg(F.sum(_weight(rows)).alias("n"))
    return top_k(counts, k, [F.desc("n"), "dst_ip"]).select("day", "rank", "dst_ip", "n")


def ports_from(values: DataFrame, k: int = 10) -> DataFrame:
    """``top_ports`` from ``day_values``."""
    counts = values.where("kind = 2 and value is not null").select("day", F.col("value").cast("int").alias("dst_port"), "n")
    return top_k(counts, k, [F.desc("n"), "dst_port"]).select(
        "day", "rank", "dst_port", "n", net.port_category(F.col("dst_port")).alias("category"), net.service_name(F.col("dst_port")).alias("service")
    )


def destinations_from(values: DataFrame, k: int = 10) -> DataFrame:
    """``top_destinations`` from ``day_values``."""
    counts = values.where("kind = 1 and value is not null").select("day", F.col("value").alias("dst_ip"), "n")
    return top_k(counts, k, [F.desc("n"), "dst_ip"]).select("day", "rank", "dst_ip", "n")


def details_from(values: DataFrame, gates: dict[int, tuple[str, int]]) -> DataFrame:
    """``(day, NAME_clients, NAME_servers, ...)`` of DETAILED ports, null on days under the port's gate; ``gates``: port -> (name, gate)."""
    out = []
    for port, (name, gate) in gates.items():
        to = F.col(DETAILED[port])
        enough = F.sum(F.when(F.col("kind") == 0, to)) >= gate
        different = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull() & (to > 0))  # noqa: B023, E731
        out += [F.when(enough, different(kind)).alias(f"{name}_{what}") for kind, what in ((0, "clients"), (1, "servers"))]
    return values.groupBy("day").agg(*out)


def udp_from(values: DataFrame) -> DataFrame:
    """``udp_on_tcp`` from ``day_values``."""
    return values.where((F.col("kind") == 2) & F.col("value").isin(*net.TCP_ONLY_PORTS) & (F.col("udp") > 0)).select("day", F.col("value").cast("int").alias("dst_port"), F.col("udp").alias("n"))


def ports_per_source(rows: DataFrame) -> DataFrame:
    """``(day, src_ip, dst_ports)``: distinct destination ports of every source."""
    f = rows.where("src_ip is not null")
    return f.groupBy("day", "src_ip", "dst_port").agg(F.lit(1).alias("one")).groupBy("day", "src_ip").agg(F.count("dst_port").alias("dst_ports"))


def spread_of(sources: DataFrame, over: int = 50) -> DataFrame:
    """``(day, suspects, avg_ports)``: sources with more than ``over`` ports, and the mean over all, from (day, src_ip, dst_ports)."""
    return sources.groupBy("day").agg(F.count_if(F.col("dst_ports") > over).alias("suspects"), F.avg("dst_ports").alias("avg_ports"))


def port_spread(rows: DataFrame, over: int = 50) -> DataFrame:
    return spread_of(ports_per_source(rows), over)


def port_detail(rows: DataFrame, port: int, gate: int) -> DataFrame:
    """``(day, clients, servers)`` of a port, on days with at least ``gate`` connections to it."""
    return port_details(rows, {port: gate}).select("day", "clients", "servers")


def port_details(rows: DataFrame, gates: dict[int, int]) -> DataFrame:
    """``(day, dst_port, clients, servers)`` of several ports, on days with at least the port's gate of connections to it."""
    f = rows.where(F.col("dst_port").isin(*gates))
    gate = F.element_at(F.create_map(*[F.lit(x) for kv in gates.items() for x in kv]), F.col("dst_port"))
    found = _values(f, ["day", "dst_port"], ["src_ip", "dst_ip"]).groupBy("day", "dst_port").agg(
        _sum_if(F.col("kind") == 0, "c"), _different(0, "clients"), _different(1, "servers")
    )
    return found.where(F.col("c") >= gate).drop("c")


def top_flows(fl: DataFrame, k: int = 5) -> DataFrame:
    f = fl.where("src_ip is not null and dst_ip is not null")
    best = top_k(f, k, [F.desc("n"), "src_ip", "dst_ip", "dst_port", "proto"])
    return best.select("day", "rank", "src_ip", "dst_ip", "dst_port", "proto", "n", net.service_name(F.col("dst_port")).alias("service"))


#: Hashed buckets of a day in the first pass of ``heavy``, and the most of them that are sent to all tasks (some 10 MB).
BUCKETS, SENT = 1 << 16, 1 << 18


def heavy(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``(day, keys..., n)`` of all keys that can be among a day's ``k`` most frequent, ties included, with exact counts.

    A first pass counts hashed buckets of keys. The keys of a day's ``k`` fullest buckets are then counted, and the k-th of their
    counts is a bound: no key is among the first with less, nor one whose bucket holds less. So a last pass counts, and
    shuffles, only keys of the buckets that reach it. Where these are too many to send to all tasks (even counts), every key
    is counted. Rows may be log rows or flows with ``n``; other columns are ignored.
    """
    slim = rows.select("day", *keys, _weight(rows).alias("n"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"))
    counted = lambda some: some.groupBy("day", *keys).agg(F.sum("n").alias("n"))
    buckets, path = lake.table(slim.groupBy("day", "bucket").agg(F.sum("n").alias("c")), "buckets")
    fullest = top_k(buckets, k, [F.desc("c"), "bucket"], ["day"]).select("day", "bucket")
    first = counted(slim.join(fullest, ["day", "bucket"], "left_semi"))
    bound = top_k(first, k, [F.desc("n")], ["day"]).groupBy("day").agg(F.min("n").alias("bound"))  # fewer than k keys: all buckets are among the fullest
    reach, kept = lake.table(buckets.join(bound, "day").where("c >= bound").select("day", "bucket"), "reach")
    lake.drop(rows.sparkSession, path)
    few = reach.limit(SENT + 1).count() <= SENT
    if not few:
        lake.drop(rows.sparkSession, kept)
        return counted(slim)
    return counted(slim.join(F.broadcast(reach), ["day", "bucket"], "left_semi"))


def top_flows_of(logs: DataFrame, k: int = 5) -> DataFrame:
    """``top_flows`` from log rows: only flows that can be among the first are counted one by one."""
    named = logs.where("src_ip is not null and dst_ip is not null")
    return top_flows(heavy(named, ["src_ip", "dst_ip", "dst_port", "proto"], k), k)


#: Distinct counts that sketches hold, and the accuracy of each: 2^12 registers, a standard error of 1.6 %.
SKETCHED, ACCURACY = {"unique_src": "src_ip", "unique_dst": "dst_ip", "unique_dst_ports": "dst_port", "unique_nat": "nat_ip"}, 12
SKETCHES = T.StructType([T.StructField("day", T.DateType()), *[T.StructField(c, T.BinaryType()) for c in SKETCHED]])


def day_sketches(logs: DataFrame) -> DataFrame:
    """Mergeable sketches of each day's distinct addresses and ports; a few KB a day, from one partially aggregated pass."""
    return logs.groupBy("day").agg(*[F.hll_sketch_agg(F.col(c).cast("long"), F.lit(ACCURACY)).alias(name) for name, c in SKETCHED.items()])


def store_sketches(path: str, logs: DataFrame) -> versions.Snapshot:
    """The stored sketches with those of the days of ``logs`` in place of older ones; give all rows of such a day."""
    new = lake.written(day_sketches(logs), "sketches")
    change = lambda old: old.join(new.select("day"), "day", "left_anti").select(*SKETCHES.fieldNames()).unionByName(new)
    return versions.update(logs.sparkSession, path, SKETCHES, change)


def distinct_of_period(sketches: DataFrame) -> DataFrame:
    """One row of distinct counts of all the days given, from their sketches alone: within 5 % at three standard errors."""
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long")).alias(c)
    return sketches.agg(*[estimate(c) for c in SKETCHED])


def max_flow(fl: DataFrame) -> DataFrame:
    return fl.where("src_ip is not null and dst_ip is not null").groupBy("day").agg(F.max("n").alias("max_flow"))


def udp_on_tcp(rows: DataFrame) -> DataFrame:
    """UDP connections by day to ports that are TCP only."""
    f = rows.where((F.col("proto") == "UDP") & F.col("dst_port").isin(*net.TCP_ONLY_PORTS))
    return f.groupBy("day", "dst_port").agg(F.sum(_weight(f)).alias("n"))


def daily_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("day").agg(F.count(F.lit(1)).alias("log_count"))


def top_sources_of_day(logs: DataFrame, day: str, k: int = 10) -> DataFrame:
    counts = logs.where(F.col("day") == F.to_date(F.lit(day))).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "src_ip").limit(k)


def top_sources_of_period(logs: DataFrame, k: int = 10) -> DataFrame:
    """Top sources over all days, with the number of distinct NAT addresses of the winners."""
    pairs = logs.groupBy("src_ip", "nat_ip").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("src_ip").agg(F.sum("n").alias("n"), F.count("nat_ip").alias("nat_ips"))
    return out.orderBy(F.desc("n"), "src_ip").limit(k)

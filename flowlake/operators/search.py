"""Forensic search: who held an address and port at a time. One request, a page, or a table of requests."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net
from ..schemas import LOG_COLUMNS
from ..sources import clustered, lake, versions

#: A total order of log rows: the first key is the time, the rest break ties.
ORDER = ["ts", "src_ip", "src_port", "dst_ip", "dst_port", "nat_ip", "nat_port", "proto", "pkt_len"]
# The export's columns.
EXPORT_COLUMNS = ["ts", "src_ip", "src_port", "dst_ip", "dst_port", "nat_ip", "nat_port", "proto", "in_iface", "out_iface", "conn_state", "has_snat", "pkt_len", "tcp_flags", "log_type"]


@dataclass(frozen=True)
class Search:
    """A search request. The day is mandatory, it prunes partitions; every other field is an optional equality or bound."""

    day: str
    ts_from: int | None = None
    ts_to: int | None = None
    src_ip: int | None = None
    dst_ip: int | None = None
    nat_ip: int | None = None
    src_port: int | None = None
    dst_port: int | None = None
    nat_port: int | None = None
    proto: str | None = None
    page: int = 1
    per_page: int = 100

    def predicate(self) -> Column:
        given = {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}
        terms = [F.col("day") == F.to_date(F.lit(self.day))]
        for name, value in given.items():
            if name == "ts_from":
                terms.append(F.col("ts") >= value)
            elif name == "ts_to":
                terms.append(F.col("ts") <= value)
            elif name not in ("day", "page", "per_page"):
                terms.append(F.col(name) == value)
        return reduce(lambda a, b: a & b, terms)


def search(logs: DataFrame, q: Search) -> DataFrame:
    """All rows that match. An address that no row has gives an empty result: the address itself is the key."""
    return logs.where(q.predicate())


class UnknownDay(LookupError):
    """No partition has the day that is asked for."""


def search_lake(spark: SparkSession, hot: str, cold: str, q: Search) -> DataFrame:
    """``search`` in the tier that holds the day; an unknown day is an error, not an empty result.

    Tiers with versions are read together: late rows of a cold day may still be hot. A day that one clustered tier
    has is read through its file index.
    """
    having = [p for p in (hot, cold) if q.day in lake.days_in(spark, p)]
    if not having:
        raise UnknownDay(f"no partition for {q.day}")
    path = having[0]
    if len(having) == 1 and clustered.indexed(spark, path):
        equal = {c: v for c in clustered.BOUNDED if c != "ts" and (v := getattr(q, c)) is not None}
        return search(clustered.search(spark, path, equal, q.ts_from, q.ts_to, [q.day]), q)
    if versions.versioned(spark, hot) and versions.versioned(spark, cold):
        return search(lake.read_tiers(spark, hot, cold), q)
    return search(lake.read_lake(spark, path), q)


def page(logs: DataFrame, q: Search) -> DataFrame:
    """One page in time order: a top-k plan, no full sort."""
    return search(logs, q).orderBy(*ORDER).offset((q.page - 1) * q.per_page).limit(q.per_page)


def page_after(logs: DataFrame, q: Search, last: dict) -> DataFrame:
    """The page after the row ``last``: deep paging without an offset."""
    key = [F.coalesce(F.col(c), F.lit("" if c == "proto" else -1)) for c in ORDER]
    seen = [F.lit("" if c == "proto" else -1) if last.get(c) is None else F.lit(last[c]) for c in ORDER]
    after, same = F.lit(False), F.lit(True)
    for k, s in zip(key, seen):
        after, same = after | (same & (k > s)), same & (k == s)
    return search(logs, q).where(after).orderBy(*ORDER).limit(q.per_page)


def total(logs: DataFrame, q: Search) -> DataFrame:
    """``(total, pages)`` of a search; an empty one has one page."""
    n = F.count(F.lit(1))
    return search(logs, q).agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / q.per_page)).cast("long").alias("pages"))


def enrich(rows: DataFrame) -> DataFrame:
    """Adds address texts and the service; the day and the address value are all that this needs, no join."""
    texts = {f"{c}_text": net.ip_text(F.col(c)) for c in ("src_ip", "dst_ip", "nat_ip")}
    return rows.withColumns(texts | {"service": net.service_name(F.col("dst_port"))})


def validate_requests(requests: DataFrame) -> DataFrame:
    """Checks a table of requests ``(id, nat_ip, proto, port, page, per_page)`` of texts and numbers.

    Blank texts are absent. Adds ip (value), proto_name and reason (null for a good request).
    """
    ip, proto = F.nullif(F.trim("nat_ip"), F.lit("")), F.nullif(F.upper(F.trim("proto")), F.lit(""))
    r = requests.withColumn("ip", net.ip_value(ip)).withColumn("proto_name", proto)
    reason = (
        F.when(ip.isNotNull() & F.col("ip").isNull(), "bad address")
        .when(proto.isNotNull() & ~proto.isin("TCP", "UDP"), "bad protocol")
        .when(F.col("port").isNotNull() & ~F.col("port").between(0, 65535), "bad port")
        .when(F.col("page") < 1, "bad page")
        .when(~F.col("per_page").between(1, 1000), "bad page size")
    )
    return r.withColumn("reason", reason)


#: Days (1970 to 2199) by which partitions are pruned; days outside are read whenever a window reaches beyond either end.
FIRST_DAY, LAST_DAY = 0, 84_005
#: Ranges of days that a scan is pruned to. If there are more, those with the least between them become one: more is read, nothing is lost.
RANGES = 64


def bad_windows(requests: DataFrame) -> DataFrame:
    """``(request_id, reason)`` of the requests that ``search_batch`` doesn't answer."""
    span = F.col("t1") - F.col("t0")
    reason = F.when(span.isNull(), "no window").when(span < 0, "window ends before it begins")
    return requests.select("request_id", reason.alias("reason")).where("reason is not null")


#: Bits from one level of aligned intervals to the next, and the most intervals of requests that are sent to the tasks that read the logs.
STEP, SENT = 3, 100_000


def _reach(requests: DataFrame) -> tuple[int | None, int | None, bool, Column]:
    """The highest levels of windows without and with a port, whether few intervals are asked for, and a condition on ``day`` that every row of any window meets."""
    day = lambda t: F.greatest(F.lit(FIRST_DAY), F.least(F.lit(LAST_DAY), F.floor(F.col(t) / 86_400)))
    seen = requests.groupBy("top", "any_port", day("t0").alias("d0"), day("t1").alias("d1")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.count(F.lit(1)).alias("n"))
    seen = seen.select("*", F.explode(F.sequence("d0", "d1")).alias("d"))
    most = lambda which: F.max(F.when(which, F.col("top")))
    intervals = F.sum(F.when(F.col("d") == F.col("d0"), F.col("n") * (F.col("top") + 1) * (1 << STEP)))
    one = seen.agg(most(F.col("any_port")), most(~F.col("any_port")), intervals, F.collect_set("d"), F.min("lo"), F.max("hi")).first()  # numbers of days
    bare, port, count, numbers, lo, hi = one
    if not numbers:
        return None, None, True, F.lit(False)
    numbers.sort()
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(numbers, numbers[1:])) if b - a > 1), reverse=True)[: RANGES - 1]
    ends = [-1, *sorted(i for _, i in gaps), len(numbers) - 1]
    day_at = lambda n: F.lit(date(1970, 1, 1) + timedelta(n))
    found = F.lit(False)
    for i, j in zip(ends, ends[1:]):
        found = found | F.col("day").between(day_at(numbers[i + 1]), day_at(numbers[j]))
    if lo < 0:
        found = found | (F.col("day") < day_at(FIRST_DAY))
    if hi >= (LAST_DAY + 1) * 86_400:
        found = found | (F.col("day") > day_at(LAST_DAY))
    return bare, port, count <= SENT, found


def _intervals(requests: DataFrame) -> DataFrame:
    """``requests`` with a row for each aligned interval (level, slot) of a window's cover; every one begins inside the window.

    From the window's first second, intervals of a level follow each other up to where one of the next level
    begins; at the level ``top``, they go on until the window's end. The last one may reach beyond it.
    """
    e = F.expr
    r = requests.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    r = r.withColumn("bits", F.col("level") * STEP)
    r = r.withColumn("a", e("-shiftright(-t0, bits)")).withColumn("z", e("shiftright(t1, bits)"))
    r = r.withColumn("z", F.when(F.col("level") == F.col("top"), F.col("z")).otherwise(F.least("z", e(f"shiftleft(-shiftright(-t0, bits + {STEP}), {STEP}) - 1"))))
    return r.where("a <= z").withColumn("slot", F.explode(F.sequence("a", "z"))).drop("a", "z", "bits", "top")


def search_batch(logs: DataFrame, requests: DataFrame, limit: int = 100) -> DataFrame:
    """Many lookups ``requests(request_id, nat_ip, nat_port, t0, t1)`` at once, the first ``limit`` rows of each.

    A window is covered by aligned intervals that begin inside it (see ``_intervals``), some 7 of each level
    of three bits, whatever its length. Of an interval's rows in time order, a window has the first ones, all of them or
    up to its end; so ``limit`` rows of each interval and address (and port, where requests name one) are enough,
    and a request meets so many rows of each of its intervals, however many its window holds. There is one scan, pruned to
    the windows' days; a row has a key for each level that some window uses; the first rows are ranked in the tasks before
    they are shuffled, and one equality join on (address, port, level, interval) follows. Windows that make no sense are in
    ``bad_windows``. A null port matches every port. A row's day must be that of its time. A group of the last ranking
    holds the intervals' first rows of one request.
    """
    keys = ["nat_ip", "any_port", "port", "level", "slot"]
    r = requests.where("t1 >= t0 and nat_ip is not null").select(
        "request_id", F.col("nat_ip").cast("long").alias("nat_ip"), F.col("nat_port").isNull().alias("any_port"), F.coalesce(F.col("nat_port").cast("long"), F.lit(0)).alias("port"),
        F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"),
    )
    r = r.withColumn("top", F.ceil(F.greatest(F.length(F.bin(F.col("t1") - F.col("t0"))) - STEP, F.lit(0)) / STEP).cast("int"))  # at most 9 intervals of that level
    bare, port, few, days = _reach(r)
    r = _intervals(r)

    def key(any_port: bool, level: int) -> Column:
        number = F.lit(0).cast("long") if any_port else F.col("nat_port").cast("long")
        return F.struct(F.lit(any_port).alias("any_port"), number.alias("port"), F.lit(level).alias("level"), F.expr(f"shiftright(ts, {STEP * level})").alias("slot"))

    levels = [(any_port, k) for any_port, top in ((True, bare), (False, port)) if top is not None for k in range(top + 1)]
    l = logs.where(days & F.col("nat_ip").isNotNull()).select(*LOG_COLUMNS)
    l = l.withColumn("key", F.explode(F.array(*[key(*x) for x in levels or [(True, 0)]]))).select(*LOG_COLUMNS, "key.*").where("port is not null")
    if few:  # checked: rows of intervals that nobody asks for aren't ranked
        l = l.join(F.broadcast(r.select(*keys).distinct()), keys, "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))
    l = l.withColumn("first", first).where(F.col("first") <= limit).drop("first")
    hit = l.join(r, keys).where("ts <= t1")
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy(*ORDER))
    return hit.select("request_id", *LOG_COLUMNS).withColumn("nth", nth).where(F.col("nth") <= limit).select("request_id", "nth", *LOG_COLUMNS)


def probe_sample(logs: DataFrame, n: int, seed: int = 42, spread: int = 150) -> DataFrame:
    """``n`` lookups around rows picked by a seeded hash: (request_id, nat_ip, nat_port, t0, t1). A sampling operator."""
    key = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in ORDER]).cast("binary"))
    picked = logs.where("nat_ip is not null").orderBy(key, *ORDER).limit(n)
    return picked.select(
        key.alias("request_id"), "nat_ip", F.col("nat_port"), (F.col("ts") - spread).alias("t0"), (F.col("ts") + spread).alias("t1")
    )


def csv_lines(rows: DataFrame, cap: int = 100_000) -> DataFrame:
    """``(line)``: the export's rows in time order, at most ``cap`` (the export's own limit), commas in values as spaces."""
    r = enrich(rows.orderBy(*ORDER).limit(cap)).withColumns({c: F.col(f"{c}_text") for c in ("src_ip", "dst_ip", "nat_ip")})
    values = [
        F.coalesce(F.regexp_replace(F.initcap(F.col(c).cast("string")) if c == "has_snat" else F.col(c).cast("string"), ",", " "), F.lit(""))
        for c in EXPORT_COLUMNS
    ]
    return r.select(F.concat_ws(",", *values).alias("line"))


def write_csv(rows: DataFrame, path: str, cap: int = 100_000) -> None:
    """One CSV file with its header. The cap bounds what its single task holds."""
    header = rows.sparkSession.createDataFrame([(",".join(EXPORT_COLUMNS),)], "line string")
    lines = csv_lines(rows, cap)
    header.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)

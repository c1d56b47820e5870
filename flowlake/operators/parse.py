"""Router syslog lines to log rows: reassembly of broken lines, five time formats, one NAT pattern.

Everything is one projection of built-in expressions; only the reassembly shuffles, by ranges of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import net
from ..schemas import LOG_COLUMNS

# The line formats that must be recognised, continuations, prefixes and the NAT line.
FORMATS = {
    "E": r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+\S+\s+(.+)$",
    "A": r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(.+)$",
    "B": r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+(?:\s+<\d+>(?:\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+)?\s+(.+)$",
    "C": r"^\s*(\d{2}:\d{2}:\d{2})\s+(.+)$",
    "D": r"^<\d+>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(.+)$",
}
CONTINUATION = r"^\s*(\d{1,3})?:\d+[,\s\)]"
_PREFIX = r"^(?:[A-Z][A-Z0-9_\-]+[:\s]+)+"
_FORWARD = r"(?i)^(?:(?:[\w\-]+:)\s*)?(?:firewall,\w+(?:,\w+)?\s+)?(forward:\s+.+)$"
_SYSTEM = r"(?i)^system,(\w+(?:,\w+)*)\s+(.+)$"
NAT = (
    r"(?i)forward:\s+in:(.+?)\s+out:([^,]+),(?:\s*connection-mark:(\S+))?\s*connection-state:([^,\s]+)(,snat)?(?:\s+src-mac\s+([0-9a-fA-F:]{11,17}))?,?\s*proto\s+(\w+)(?:\s+\(([^)]+)\))?,\s*(\d+\.\d+\.\d+\.\d+):(\d+)->(\d+\.\d+\.\d+\.\d+):(\d+),\s*NAT\s+\((\d+\.\d+\.\d+\.\d+):(\d+)->(\d+\.\d+\.\d+\.\d+):(\d+)\)->(\d+\.\d+\.\d+\.\d+):(\d+),\s*len\s+(\d+)"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HOUR = 3600


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a generator, over which no filter is pushed and no projection merged.

    Each regular expression is then evaluated once a row, however often later columns refer to it.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


#: Values of a plain ``pos`` that one range of a file spans.
RANGE = 1 << 16
MARK = "\x01"


def range_of(lines: DataFrame) -> Column:
    """The part of a file in which a line lies: its split of the file, or a range of plain positions."""
    kind = lines.schema["pos"].dataType
    return F.col("pos.block").cast("long") if isinstance(kind, StructType) and "block" in kind.names else F.floor(F.col("pos") / RANGE).cast("long")


def join_continuations(lines: DataFrame) -> DataFrame:
    """``(file, pos, line)`` from ``lines(file, pos, value)``: broken lines joined to the line that they continue.

    A line that continues nothing (the first of a file, or after a blank line) stands alone. Blank
    lines are dropped. Windows hold one range of a file; what a range begins with and the range before
    it began is put together over one row per range, so a large file is many tasks.
    """
    value = F.regexp_replace("value", r"[\r\n]+$", "")
    l = lines.select("file", range_of(lines).alias("range"), "pos", value.alias("value")).withColumn("head", ~F.coalesce(F.col("value").rlike(CONTINUATION), F.lit(True)))
    heads = l.groupBy("file", "range").agg(F.count_if("head").alias("heads"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    last = F.last(F.when(F.col("heads") > 0, F.struct("range", F.col("heads").alias("nth"))), ignorenulls=True).over(before)
    held = heads.select("file", "range", last.alias("held"))
    # a line belongs to the last line before it that continues none; those that begin a file, to each other
    inside = Window.partitionBy("file", "range").orderBy("pos")
    nth = F.count_if("head").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    l = l.withColumns({"nth": nth, "alone": F.col("head") & F.coalesce(F.lead("head").over(inside), F.lit(False))})
    none = F.struct(F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("nth"))
    group = F.when(F.col("nth") > 0, F.struct("range", "nth")).otherwise(F.coalesce("held", none))
    # most lines are followed by one that continues nothing: only the others, and a range's last, are put together
    some = l.where("not alone").join(held, ["file", "range"]).select("file", group.alias("group"), "pos", "value")
    # a blank line holds nothing: what follows it begins anew, with its leading blanks
    parts = F.filter(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"] != "")
    whole = some.groupBy("file", "group").agg(parts.alias("parts")).where(F.size("parts") > 0)
    rest = F.transform(F.slice("parts", 2, F.size("parts")), lambda p: F.regexp_replace(p["value"], r"^\s+", ""))
    joined = whole.select("file", F.col("parts")[0]["pos"].alias("pos"), F.concat(F.col("parts")[0]["value"], F.array_join(rest, "")).alias("line"))
    return joined.unionByName(l.where("alone and value <> ''").select("file", "pos", F.col("value").alias("line")))


def _matched(text: Column, pattern: str, groups: int) -> Column:
    """One match per text: the pattern's groups in one text, each behind a character that no line has; else the text itself."""
    return F.regexp_replace(text, pattern, MARK + MARK.join(f"${k}" for k in range(1, groups + 1)))


def _groups(matched: Column, text: Column) -> Column:
    """The groups as an array; null without a match."""
    return F.when(matched.startswith(MARK) & ~text.startswith(MARK), F.split(F.substr(matched, F.lit(2)), MARK))


def split_time(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds format (letter, or null), ts_text and body; a line without a time has none of them.

    A line's first characters leave one format that it can have, so one pattern is tried on it.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(line), r"^\s+", ""), r"\s+$", "")
    d = evaluated(lines, {"_t": text})
    t = F.col("_t")
    can = (
        F.when(t.startswith("<"), "D").when(F.substring(t, 3, 1) == ":", "C")
        .when(F.substring(t, 5, 1) == "-", F.when(F.substring(t, 11, 1) == "T", "E").otherwise("A")).otherwise("B")
    )
    d = evaluated(d, {"_can": can})
    found = F.lit("")
    for letter, pattern in FORMATS.items():
        found = F.when(F.col("_can") == letter, _matched(t, pattern, 2)).otherwise(found)
    d = evaluated(d, {"_m": found})
    d = evaluated(d, {"_g": _groups(F.col("_m"), t)})
    g = F.col("_g")
    return evaluated(d, {"format": F.when(g.isNotNull(), F.col("_can")), "ts_text": g[0], "body": F.trim(g[1])}).drop("_t", "_can", "_m", "_g")


def parse_time(ts_text: Column, fmt: Column, now: Column) -> Column:
    """Epoch seconds of a time text, null if it can't be read.

    E honours its offset; A is local; B and D take the year of ``now``, or the one before if that
    lies more than 25 hours ahead; C takes the day of ``now``. Local is the session's time zone.
    """
    seconds = lambda text: F.unix_seconds(text.try_cast("timestamp"))
    clock = F.substring(ts_text, -8, 8)
    iso = F.regexp_replace(F.translate(ts_text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    # three letters and a comma a month: its number from its place
    place = F.instr(F.lit(",".join(MONTHS)), F.lower(F.substring(ts_text, 1, 3)))
    month = F.when((place > 0) & (place % 4 == 1), F.lpad(((place + 3) / 4).cast("int").cast("string"), 2, "0"))
    day = F.lpad(F.trim(F.translate(F.substring(ts_text, 4, 100), "\t\n\x0b\f\r", "     ")).substr(1, 2), 2, "0")
    year = F.year(F.timestamp_seconds(now))

    def in_year(y: Column) -> Column:
        return seconds(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), month, F.lit("-"), F.trim(day), F.lit(" "), clock))

    named = in_year(year)
    today = F.concat(F.date_format(F.timestamp_seconds(now), "yyyy-MM-dd"), F.lit(" "), ts_text)
    return (
        F.when(fmt == "E", seconds(iso))
        .when(fmt == "A", seconds(F.concat(F.substring(ts_text, 1, 10), F.lit(" "), clock)))
        .when(fmt.isin("B", "D"), F.when(named - now > 25 * HOUR, in_year(year - 1)).otherwise(named))
        .when(fmt == "C", seconds(today))
    )


def normalise(lines: DataFrame) -> DataFrame:
    """Adds log_type (nat, system, other) and nat_body, the body from ``forward:`` on without its prefixes."""
    d = evaluated(lines, {"_b": F.regexp_replace("body", _PREFIX, "")})
    d = evaluated(d, {"_f": F.regexp_extract("_b", _FORWARD, 1)})
    plain = F.lower("_b").startswith("forward:")
    nat = F.when(F.col("_f") != "", F.col("_f")).when(plain, F.col("_b"))
    kind = F.when(nat.isNotNull(), "nat").when(F.col("_b").rlike(_SYSTEM), "system").otherwise("other")
    return evaluated(d, {"nat_body": nat, "log_type": kind}).drop("_b", "_f")


def parse(lines: DataFrame, now: Column, line: str = "line") -> DataFrame:
    """All columns of ``lines`` plus the fields of a NAT line, ``ok`` and ``reason`` (why a line isn't one).

    Beside the stored columns: conn_mark, src_mac, the addresses before translation and behind it,
    and ts_inferred (the time couldn't be read, so it is ``now``, in epoch seconds).
    """
    d = normalise(split_time(lines, line))
    d = evaluated(d, {"_m": _matched(F.col("nat_body"), "(?s)^.*?" + NAT.replace("(?i)", "(?i:", 1) + ").*$", 19)})
    d = evaluated(d, {"g": _groups(F.col("_m"), F.col("nat_body")), "_stamp": parse_time(F.col("ts_text"), F.col("format"), now)}).drop("_m")
    hit = F.col("g").isNotNull()
    g = lambda k: F.col("g")[k - 1]
    number = lambda k: F.expr(f"try_cast(g[{k - 1}] AS INT)")
    opt = lambda k: F.nullif(g(k), F.lit(""))
    stamp = F.col("_stamp")
    # what decides whether a line is accepted is worked out once; the other fields, only if they are asked for
    d = evaluated(
        d,
        {
            "src_ip": net.ip_value(g(9)), "src_port": number(10), "dst_ip": net.ip_value(g(11)), "dst_port": number(12),
            "nat_ip": net.ip_value(g(15)), "nat_port": number(16), "pkt_len": number(19),
        },
    )
    d = d.withColumns(
        {
            "ts": F.when(hit, F.coalesce(stamp, now)).cast("long"), "ts_inferred": F.when(hit, stamp.isNull()),
            "in_iface": F.trim(g(1)), "out_iface": F.trim(g(2)), "conn_mark": opt(3), "conn_state": F.lower(g(4)), "has_snat": g(5) != "",
            "src_mac": opt(6), "proto": F.upper(g(7)), "tcp_flags": opt(8),
            "orig_ip": net.ip_value(g(13)), "orig_port": number(14), "final_ip": net.ip_value(g(17)), "final_port": number(18),
        }
    )
    ports = [F.col(c) for c in ("src_port", "dst_port", "nat_port", "pkt_len")]
    bad_port = F.lit(False)
    for p in ports:
        bad_port = bad_port | ~F.coalesce(p.between(0, 65535), F.lit(False))
    reason = (
        F.when(F.col("format").isNull(), "no time")
        .when(F.col("log_type") != "nat", F.concat(F.lit("not nat: "), F.col("log_type")))
        .when(F.col("g").isNull(), "no nat fields")
        .when(F.col("src_ip").isNull() | F.col("dst_ip").isNull() | F.col("nat_ip").isNull(), "bad address")
        .when(bad_port, "bad port")
    )
    d = evaluated(d, {"reason": reason})
    return d.withColumn("ok", F.col("reason").isNull()).withColumn("day", net.epoch_day(F.col("ts"))).drop("g", "_stamp")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("ok").select(*LOG_COLUMNS)


def rejected(parsed: DataFrame, *keep: str) -> DataFrame:
    """The quarantine: lines that are no log row, with the reason."""
    return parsed.where("not ok").select(*keep, "reason")


def quality(parsed: DataFrame) -> DataFrame:
    """``(file, parsed, rejected)``."""
    return parsed.groupBy("file").agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("rejected"))


def render(logs: DataFrame, fmt: str = "A", mac: bool = False) -> Column:
    """A log row as a router's line, in time format ``fmt``: the inverse of ``parse``."""
    at = F.timestamp_seconds("ts")
    time = {
        "A": F.date_format(at, "yyyy-MM-dd HH:mm:ss "), "B": F.date_format(at, "MMM dd HH:mm:ss 'gw LOG_NAT: '"),
        "C": F.date_format(at, "HH:mm:ss 'CGNAT: '"), "D": F.date_format(at, "'<30>'MMM dd HH:mm:ss 'gw '"),
        "E": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00 gw LOG_NAT: LOG_NAT '"),
    }[fmt]
    src, dst, nat = (net.ip_text(F.col(c)) for c in ("src_ip", "dst_ip", "nat_ip"))
    flags = F.coalesce(F.concat(F.lit(" ("), F.col("tcp_flags"), F.lit(")")), F.lit(""))
    return F.concat(
        time, F.lit("firewall,info " if fmt == "A" else ""), F.lit("forward: in:"), F.col("in_iface"), F.lit(" out:"), F.col("out_iface"),
        F.lit(",connection-state:"), F.col("conn_state"), F.when(F.col("has_snat"), ",snat").otherwise(""), F.lit(" src-mac 00:11:22:33:44:55" if mac else ""),
        F.lit(", proto "), F.col("proto"), flags, F.lit(", "), src, F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), dst, F.lit(":"),
        F.col("dst_port").cast("string"), F.lit(", NAT ("), src, F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), nat, F.lit(":"),
        F.col("nat_port").cast("string"), F.lit(")->"), dst, F.lit(":"), F.col("dst_port").cast("string"), F.lit(", len "), F.col("pkt_len").cast("string"),
    )

"""Addresses, ports and times of connection logs, as Column expressions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Service names by port, and ports on which UDP makes no sense.
SERVICES = {
    20: "FTP-data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 80: "HTTP", 110: "POP3",
    123: "NTP", 143: "IMAP", 161: "SNMP", 179: "BGP", 443: "HTTPS", 465: "SMTPS", 587: "SMTP/Sub", 993: "IMAPS",
    995: "POP3S", 3389: "RDP", 5060: "SIP", 6881: "BitTorrent", 8080: "HTTP-alt", 8443: "HTTPS-alt",
}
TCP_ONLY_PORTS = (21, 22, 23, 25, 110, 143, 465, 587, 993, 995)
MAIL_PORTS = (25, 465, 587, 993, 995)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ip_value(text: Column) -> Column:
    """IPv4 text to its unsigned value; null for anything that isn't four octets 0-255 without leading zeros."""
    two, three = F.substring_index(text, ".", 2), F.substring_index(text, ".", 3)
    octets = [F.substring_index(t, ".", n).cast("long") for t, n in ((text, 1), (two, -1), (three, -1), (text, -1))]
    value = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    return F.when(text.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"), value)


def ip_text(value: Column) -> Column:
    """Unsigned or signed 32-bit value to IPv4 text."""
    v = value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    octets = [F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(value.isNotNull(), F.concat_ws(".", *octets))


def port_category(port: Column) -> Column:
    return F.when(port <= 1023, "well_known").when(port <= 49151, "registered").when(port.isNotNull(), "ephemeral")


def service_table(spark: SparkSession) -> DataFrame:
    """(port, service): the fixed 23 rows, small enough to broadcast always."""
    return F.broadcast(spark.createDataFrame(list(SERVICES.items()), "port int, service string"))


def service_name(port: Column) -> Column:
    """Service of a port, '' if it has none."""
    pairs = [F.lit(x) for kv in SERVICES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), port.cast("int")), F.lit(""))


def epoch_day(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))


def epoch_hour(ts: Column) -> Column:
    """Start of the hour, in epoch seconds."""
    return (ts - F.pmod(ts, F.lit(3600))).cast("long")


def finalised(hour: str, now: float) -> bool:
    """Whether an hour ``YYYY-MM-DD-HH`` (UTC) has passed; False for a text that isn't one."""
    try:
        begin = datetime.strptime(hour, "%Y-%m-%d-%H").replace(tzinfo=timezone.utc)
    except ValueError:
        return False
    return now >= begin.timestamp() + 3600


def window_epoch(day: Column, clock: Column) -> Column:
    """A day and a clock time HH:MM[:SS] to epoch seconds, in the session's time zone; null if either is malformed."""
    full = F.when(clock.rlike(r"^\d{2}:\d{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.unix_seconds(F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), full), F.lit("yyyy-MM-dd HH:mm:ss")))


def display_name(name: Column, number: Column) -> Column:
    """A dictionary name, or ``id=N`` for an id without one; null stays null."""
    return F.coalesce(name, F.concat(F.lit("id="), number.cast("string")))

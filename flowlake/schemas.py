"""Schemas of the connection-log tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fact table. Names stay text (Parquet dictionary-encodes them); an IPv4 address is its unsigned value.
CONN_LOGS = T.StructType(
    [
        T.StructField("ts", T.LongType(), False),
        T.StructField("day", T.DateType(), False),
        T.StructField("in_iface", T.StringType()),
        T.StructField("out_iface", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("conn_state", T.StringType()),
        T.StructField("has_snat", T.BooleanType()),
        T.StructField("src_ip", T.LongType(), False),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.LongType(), False),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("nat_ip", T.LongType()),
        T.StructField("nat_port", T.IntegerType()),
        T.StructField("pkt_len", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("log_type", T.StringType()),
    ]
)
LOG_COLUMNS = CONN_LOGS.fieldNames()

#: The address registry's counters.
REGISTRY = T.StructType([T.StructField(c, T.LongType()) for c in ("ip", "total_hits", "first_seen", "last_seen")])

AUDIT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
)

#: Daily statistics; ``listing`` tells whether a day's files are still those that were counted.
STATS = T.StructType([T.StructField("day", T.DateType()), *[T.StructField(c, T.LongType()) for c in ("log_count", "size_bytes", "listing", "updated_at")]])

#: A stored alert.
ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("log_count", T.LongType()), T.StructField("size_bytes", T.LongType()),
        T.StructField("ratio", T.DoubleType()), T.StructField("category", T.StringType()), T.StructField("analysis", T.StringType()), T.StructField("details", T.StringType()),
        T.StructField("acknowledged", T.BooleanType()), T.StructField("acknowledged_by", T.StringType()), T.StructField("acknowledged_at", T.LongType()),
    ]
)

#: A batch of a stream.
PROGRESS = T.StructType(
    [T.StructField("source", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("batch", "ts", "rows")], T.StructField("metrics", T.StringType())]
)

#: Dictionary sidecar of a cold day: {table: {id: name}}.
SIDECAR = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))

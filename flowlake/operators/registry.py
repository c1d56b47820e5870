"""The address registry and the day dictionaries, derived by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from ..sources import lake, versions


def occurrences(logs: DataFrame) -> DataFrame:
    """``(ip, ts)``: every address of every row, in its three roles."""
    return logs.select(F.explode(F.array("src_ip", "dst_ip", "nat_ip")).alias("ip"), "ts").where("ip is not null")


def dim_ip(logs: DataFrame) -> DataFrame:
    """``(ip, total_hits, first_seen, last_seen)``: one partially aggregated pass."""
    return occurrences(logs).groupBy("ip").agg(F.count(F.lit(1)).alias("total_hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def distinct_ips(logs: DataFrame) -> DataFrame:
    return occurrences(logs).select("ip").distinct()


def totals(dim: DataFrame) -> DataFrame:
    return dim.agg(F.count(F.lit(1)).alias("ips"), F.coalesce(F.sum("total_hits"), F.lit(0)).alias("hits"))


def assign_ids(dim: DataFrame, existing: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(ip, ip_id)``: existing ids stay, new addresses get the next ones in order of first_seen, ip.

    New addresses are cut into ranges of about equal numbers by (first_seen, ip), the ranges are
    counted, and a row's number is its range's base plus its place there. However many appear at one
    time, no window holds them all. ``ranges`` defaults to the shuffle partitions.
    """
    spark = dim.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = dim.join(existing.select("ip"), "ip", "left_anti").select("ip", "first_seen")
    parts = new.repartitionByRange(n, "first_seen", "ip").withColumn("range", F.spark_partition_id())
    parts = lake.written(parts, "new-addresses")  # the ranges come from a sample: they must not be drawn twice
    counts = parts.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    start = existing.agg(F.coalesce(F.max("ip_id"), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("first_seen", "ip"))
    numbered = parts.join(base, "range").join(F.broadcast(start)).select("ip", (F.col("start") + F.col("base") + nth).cast("long").alias("ip_id"))
    return existing.select("ip", "ip_id").unionByName(numbered)


def top_ips(dim: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` (1 to 1000) addresses with most hits."""
    k = min(max(n, 1), 1000)
    return dim.orderBy(F.desc("total_hits"), "ip").limit(k).select(net.ip_text(F.col("ip")).alias("ip"), "total_hits", "first_seen", "last_seen")


def mark_hot(dim: DataFrame, n: int) -> DataFrame:
    """The registry with is_hot set for its ``n`` top addresses and reset for the others."""
    hot = dim.orderBy(F.desc("total_hits"), "ip").limit(n).select("ip", F.lit(True).alias("hot"))
    return dim.join(hot, "ip", "left").withColumn("is_hot", F.coalesce("hot", F.lit(False))).drop("hot")


#: A stored dictionary: one row per name of a day and kind.
DICTS = T.StructType([T.StructField("day", T.DateType()), T.StructField("kind", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
#: Coded columns: name, dictionary, id.
CODED = (("in_iface", "interfaces", "in_iface_id"), ("out_iface", "interfaces", "out_iface_id"), ("proto", "protocols", "proto_id"), ("conn_state", "conn_states", "conn_state_id"))


def _names(logs: DataFrame) -> DataFrame:
    """``(day, kind, name, first)``: each day's names and when they appear first."""
    named = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for c, kind, _ in CODED]))
    return logs.select("day", "ts", named.alias("x")).where("x.name is not null").groupBy("day", "x.kind", "x.name").agg(F.min("ts").alias("first"))


def dict_ids(logs: DataFrame) -> DataFrame:
    """``(day, kind, id, name)``: dense ids of each day's names by first appearance, then by name.

    In and out interfaces share one dictionary. A day's distinct names are few, the logs are only aggregated.
    """
    rank = F.row_number().over(Window.partitionBy("day", "kind").orderBy("first", "name"))
    return _names(logs).select("day", "kind", rank.alias("id"), "name")


def extend_dicts(known: DataFrame, logs: DataFrame) -> DataFrame:
    """The dictionary ``known(day, kind, id, name)`` with the names that are new in ``logs``.

    Known names keep their ids, whatever their times: rows that are coded already decode as before. New ones
    get the next ids of their day and kind, by first appearance in these logs, then by name.
    """
    new = _names(logs).join(known, ["day", "kind", "name"], "left_anti")
    last = known.groupBy("day", "kind").agg(F.max("id").alias("last"))
    rank = F.row_number().over(Window.partitionBy("day", "kind").orderBy("first", "name"))
    numbered = new.withColumn("rank", rank).join(last, ["day", "kind"], "left")
    return known.select(*DICTS.fieldNames()).unionByName(numbered.select("day", "kind", (F.coalesce("last", F.lit(0)) + F.col("rank")).cast("int").alias("id"), "name"))


def store_dicts(spark: SparkSession, path: str, logs: DataFrame) -> versions.Snapshot:
    """``extend_dicts`` on a stored dictionary. Of two writers one starts again from the other's ids, so no id is given twice."""
    return versions.update(spark, path, DICTS, lambda known: extend_dicts(known, logs))


def read_dicts(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, DICTS)


def _by_day(dims: DataFrame, key: str, value: str) -> DataFrame:
    """One row a day with a map for each kind: ``(day, interfaces, protocols, conn_states)``."""
    one = dims.groupBy("day", "kind", F.col(key).alias("k")).agg(F.min(value).alias("v"))
    entry = F.struct("k", "v")
    kinds = dict.fromkeys(kind for _, kind, _ in CODED)
    return one.groupBy("day").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, entry))).alias(f"_{k}") for k in kinds])


def encode(logs: DataFrame, dims: DataFrame) -> DataFrame:
    """Log rows with dictionary ids in place of names: one join with a day's maps. A name without an id has none."""
    d = logs.join(_by_day(dims, "name", "id"), "day", "left")
    d = d.withColumns({number: F.try_element_at(f"_{kind}", F.col(column)) for column, kind, number in CODED})
    return d.drop(*[c for c, _, _ in CODED], *{f"_{k}" for _, k, _ in CODED})


def decode(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """Ids back to names; an id without a name is shown as ``id=N``, but protocols 1 and 2 fall back to TCP and UDP.

    A day's dictionaries are one row of maps, so rows are joined once; Spark broadcasts the days while they are few.
    """
    d = rows.join(_by_day(dims, "id", "name"), "day", "left")
    names = {}
    for column, kind, number in CODED:
        known = F.when(F.col(number) == 1, "TCP").when(F.col(number) == 2, "UDP") if column == "proto" else F.lit(None).cast("string")
        names[column] = net.display_name(F.coalesce(F.try_element_at(f"_{kind}", F.col(number)), known), F.col(number))
    return d.withColumns(names).drop(*{f"_{k}" for _, k, _ in CODED})

import pytest
from pyspark.sql import functions as F

from flowlake.schemas import LOG_COLUMNS
from flowlake.sources import clustered, lake
from flowlake.sources import versions as vs

START = 1704844800  # 2024-01-10


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "lake")
    e = F.expr
    rows = spark.range(40_000).select(
        (START + e("id * 7919 % 172800")).alias("ts"), e("CAST('2024-01-10' AS DATE) + CAST(id * 7919 % 172800 DIV 86400 AS INT)").alias("day"), F.lit("a").alias("in_iface"), F.lit("b").alias("out_iface"),
        F.lit("TCP").alias("proto"), F.lit("new").alias("conn_state"), F.lit(True).alias("has_snat"), e("1681915904 + pmod(xxhash64(id), 9000)").alias("src_ip"),
        e("CAST(1024 + id % 60000 AS INT)").alias("src_port"), e("134744072 + pmod(xxhash64(id, 1), 500)").alias("dst_ip"), F.lit(443).alias("dst_port"),
        e("IF(id % 3 = 0, 7, 2868227961 + pmod(xxhash64(id, 2), 200))").alias("nat_ip"), e("CAST(1024 + id % 60000 AS INT)").alias("nat_port"), F.lit(60).alias("pkt_len"), F.lit(None).cast("string").alias("tcp_flags"), F.lit("nat").alias("log_type"),
    )
    rows = rows.withColumn("nat_ip", F.when(F.col("src_port") % 50 > 0, F.col("nat_ip"))).select(*LOG_COLUMNS)
    vs.append(rows, path, ("day",))
    clustered.cluster(spark, path, ["2024-01-10", "2024-01-11"], files=128)
    return path, lake.written(rows, "rows")


CASES = [
    ({"src_ip": 1681915904 + 77}, None, None, 0.1), ({"nat_ip": 2868227961 + 5}, START + 4000, START + 4300, 0.1), ({"src_ip": 1681915904 + 78, "dst_port": 443}, START, START + 90_000, 0.1),
    ({"nat_ip": 7}, START + 100, START + 200, 0.2), ({"src_ip": 5}, None, None, 0.01), ({}, START + 86_400, None, 0.7), ({"src_port": 1500}, None, None, 1.0),
]


@pytest.mark.parametrize("equal, a, b, share", CASES)
def test_searches_read_few_files_and_lose_nothing(spark, stored, equal, a, b, share):
    path, rows = stored
    want = rows
    for c, v in equal.items():
        want = want.where(F.col(c) == v)
    want = want.where(F.col("ts") >= a) if a else want
    want = want.where(F.col("ts") <= b) if b else want
    files, total = clustered.files_for(spark, path, equal, a, b)
    got = clustered.search(spark, path, equal, a, b)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert total >= 100 and len(files) <= share * total, (len(files), total)


def test_a_lake_is_searched_through_its_index(spark, stored):
    from flowlake.operators import search as s

    path, rows = stored
    q = s.Search("2024-01-11", src_ip=1681915904 + 77, ts_from=START, proto="TCP")
    got = s.search_lake(spark, path, path + ".none", q)
    want = s.search(rows, q)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0
    with pytest.raises(s.UnknownDay):
        s.search_lake(spark, path, path + ".none", s.Search("2024-01-12"))


def test_rows_that_are_not_indexed_are_found(spark, stored, tmp_path):
    path, rows = str(tmp_path / "lake"), stored[1].where("src_ip < 1681916000")
    half = lambda k: rows.where(F.col("src_port") % 2 == k)
    vs.append(half(0), path, ("day",))
    clustered.cluster(spark, path, ["2024-01-10"], files=8)
    vs.append(half(1), path, ("day",))
    assert clustered.search(spark, path, {}).count() == rows.count() and lake.read_lake(spark, path).count() == rows.count()
    ip = rows.first()["src_ip"]
    for days in (None, ["2024-01-10"]):
        want = rows.where(F.col("src_ip") == ip)
        want = want.where("day = DATE'2024-01-10'") if days else want
        assert clustered.search(spark, path, {"src_ip": ip}, days=days).exceptAll(want).isEmpty() and clustered.search(spark, path, {"src_ip": ip}, days=days).count() == want.count()
    clustered.cluster(spark, path, ["2024-01-10", "2024-01-11"], files=8)
    assert clustered.search(spark, path, {"src_ip": ip}).count() == rows.where(F.col("src_ip") == ip).count()
    with pytest.raises(ValueError):
        clustered.search(spark, path, {"pkt_len": 1})
    assert clustered.search(spark, str(tmp_path / "none"), {"src_ip": 1}).isEmpty()

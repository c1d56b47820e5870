import pytest
from pyspark.sql import functions as F

from flowlake.operators import profile
from flowlake.sources import versions as vs


@pytest.fixture(scope="module")
def skewed(spark):
    """Ten days on which a few flows have most rows; two of them tie for the last place."""
    e = F.expr
    rows = spark.range(60_000).select(
        e("CAST('2024-01-01' AS DATE) + CAST(id % 10 AS INT)").alias("day"), e("IF(id % 4 = 0, id, pmod(xxhash64(id), 4))").alias("src_ip"), e("IF(id % 4 = 0, id * 3, 5)").alias("dst_ip"), F.lit(443).alias("dst_port"), F.lit("TCP").alias("proto"), F.lit(1).alias("nat_ip"),
    )
    tie = spark.range(7000).select(e("CAST('2024-01-03' AS DATE)").alias("day"), e("100 + id % 7").alias("src_ip"), F.lit(9).cast("long").alias("dst_ip"), F.lit(80).alias("dst_port"), F.lit("UDP").alias("proto"), F.lit(2).alias("nat_ip"))
    return rows.unionByName(tie).cache()


@pytest.mark.parametrize("k", [1, 3, 5, 8])
def test_heavy_hitters_are_exact(skewed, k):
    want = profile.top_flows(profile.flows(skewed), k)
    got = profile.top_flows_of(skewed, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 10 * 3 * (k > 2)


def test_few_flows_are_counted_on_skewed_logs(skewed):
    named = ["src_ip", "dst_ip", "dst_port", "proto"]
    few, every = profile.heavy(skewed, named, 3).count(), profile.flows(skewed).count()
    assert every > 15_000 and few < 0.1 * every, (few, every)


def test_even_counts_and_small_days(spark, skewed, monkeypatch):
    named = ["src_ip", "dst_ip", "dst_port", "proto"]
    even = skewed.where("src_ip > 200")
    assert profile.heavy(even, named, 5).count() == profile.flows(even).count()
    monkeypatch.setattr(profile, "SENT", 10)
    assert sorted(map(tuple, profile.top_flows_of(even, 4).collect())) == sorted(map(tuple, profile.top_flows(profile.flows(even), 4).collect()))
    one = skewed.limit(2)
    assert profile.top_flows_of(one, 9).count() == profile.flows(one).count()
    assert profile.top_flows_of(skewed.limit(0), 3).isEmpty()


def test_sketches_of_days_are_merged(spark, tmp_path):
    path = str(tmp_path / "sketches")
    e = F.expr
    rows = spark.range(200_000).select(
        e("CAST('2024-01-01' AS DATE) + CAST(id % 5 AS INT)").alias("day"), e("id % 90000").alias("src_ip"), e("id % 700").alias("dst_ip"), e("CAST(id % 50000 AS INT)").alias("dst_port"), e("IF(id < 0, 1, NULL)").cast("long").alias("nat_ip")
    )
    profile.store_sketches(path, rows.where("day < DATE'2024-01-04'").limit(100))
    profile.store_sketches(path, rows)
    stored = vs.read(spark, path, profile.SKETCHES)
    assert stored.count() == 5
    for some in ("day <= DATE'2024-01-05'", "day = DATE'2024-01-02'", "day between DATE'2024-01-02' and DATE'2024-01-03'"):
        got = profile.distinct_of_period(stored.where(some)).first()
        want = rows.where(some).agg(*[F.count_distinct(c).alias(n) for n, c in profile.SKETCHED.items()]).first()
        for c in profile.SKETCHED:
            assert abs(got[c] - want[c]) <= 0.05 * want[c], (some, c, got[c], want[c])
    assert tuple(profile.distinct_of_period(stored.where("day > DATE'2025-01-01'")).first()) == (0, 0, 0, 0)


def test_values_with_nulls_follow_the_rows(spark):
    """Totals, distinct counts and details of a day whose rows lack addresses or ports, against plain Python."""
    rows = [(1, 2, 53, "UDP"), (1, None, 53, "TCP"), (None, 2, 53, "UDP"), (None, None, None, None), (3, 4, 123, "UDP"), (3, 5, 123, None), (1, 2, 25, "UDP"), (1, 2, 25, "UDP"), (9, None, 60000, "TCP")]
    logs = spark.createDataFrame(rows, "src_ip long, dst_ip long, dst_port int, proto string").withColumn("day", F.lit("2024-01-01").cast("date"))
    logs = logs.withColumn("kind", F.lit("a column of the logs' own"))
    values = profile.day_values(logs)
    got = profile.globals_from(values).first()
    different = lambda k, some=rows: len({r[k] for r in some} - {None})
    assert (got.total, got.unique_src, got.unique_dst, got.unique_dst_ports) == (len(rows), different(0), different(1), different(2))
    assert (got.well_known, got.registered, got.ephemeral, got.dns, got.ntp, got.email) == (7, 0, 1, 3, 2, 2)
    assert got.asDict() == profile.globals_of(logs).first().asDict()
    details = profile.details_from(values, {53: ("dns", 3), 123: ("ntp", 3)}).first()
    to = lambda port: [r for r in rows if r[2] == port]
    assert (details.dns_clients, details.dns_servers, details.ntp_clients, details.ntp_servers) == (different(0, to(53)), different(1, to(53)), None, None)
    assert [(r.dst_port, r.n) for r in profile.udp_from(values).collect()] == [(25, 2)]
    assert profile.globals_of(logs.limit(0)).count() == 0 and profile.source_profiles(logs).where("src_ip = 1").first().dst_ips == 1

import pytest

from flowlake.operators import anomaly, classify

BASE = dict(
    total=1_000_000, unique_src=100, unique_dst=100, unique_dst_ports=100, suspects=0, avg_ports=10.0, top_pct=0.05, wk_pct=0.5, reg_pct=0.4, eph_pct=0.1,
    dns=50_000, dns_pct=0.05, http_pct=0.30, ntp=0, ntp_pct=0.0, tt_ports=50, tt_ips=50, tt_wk_pct=30.0, ntp_clients=0, ntp_servers=0, dns_clients=0,
    dns_servers=0, max_flow=0, udp_on_tcp=0, udp_pct=0.0,
)
P2P = dict(tt_ports=5000, tt_ips=5000, suspects=30, avg_ports=200.0, unique_dst=15_000, unique_dst_ports=8_000, eph_pct=0.65, http_pct=0.05, dns_pct=0.02)
CASES = [
    ("unknown", {}, 0.30, True), ("p2p", P2P, 0.7, False), ("ntp", dict(ntp=500_000, ntp_pct=0.5, ntp_clients=1, ntp_servers=1), 0.7, False),
    ("dns", dict(dns=1_000_000, dns_pct=0.4, dns_clients=2, dns_servers=5), 0.6, False), ("dos", dict(top_pct=0.85, unique_src=3, unique_dst=2, unique_dst_ports=1), 0.7, False),
    ("scan", dict(unique_src=2, unique_dst_ports=5000, unique_dst=800), 0.5, False), ("botnet", dict(unique_src=80, unique_dst=3, unique_dst_ports=2, udp_on_tcp=8000), 0.7, False),
    ("bandwidth", dict(top_pct=0.65, tt_wk_pct=80.0, unique_dst=100, http_pct=0.55), 0.3, False), ("flood", dict(max_flow=600_000), 0.9, False),
    ("malware", dict(udp_on_tcp=50_000, udp_pct=0.05), 0.6, False),
]


@pytest.mark.parametrize("code, given, least, exact", CASES)
def test_cases(spark, code, given, least, exact):
    row = BASE | given
    df = spark.createDataFrame([("d", *row.values())], ["day", *row])
    scored = classify.scores(df)
    r = classify.best(scored).first()
    assert r["code"] == code and (r["score"] == least if exact else r["score"] >= least)
    assert r["causes"] == classify.CAUSES[code] and r["reasons"] and None not in r["reasons"]
    assert (r["reasons"] == ["The numbers fit no class"]) == (code == "unknown")
    assert classify.long_scores(scored).count() == len(classify.NAMES)


def test_web_traffic_holds_p2p_down(spark):
    row = BASE | P2P | dict(http_pct=0.60, wk_pct=0.75, max_flow=10_000)
    assert classify.best(classify.scores(spark.createDataFrame([("d", *row.values())], ["day", *row]))).first()["code"] != "p2p"


def daily(spark, counts):
    return spark.createDataFrame([(f"2024-01-{k + 1:02d}", n) for k, n in enumerate(counts)], "day string, log_count long").selectExpr("CAST(day AS DATE) AS day", "log_count")


@pytest.mark.parametrize(
    "counts, least, want",
    [
        ([1_000_000] * 7 + [5_000_000], 100_000, [5.0]), ([100_000] * 7 + [1_000_000], 100_000, [10.0]), ([1_000_000] * 7 + [2_000_000], 100_000, []),
        ([1_000_000, 5_000_000], 100_000, []), ([], 100_000, []), ([0, 0, 0, 900_000], 100_000, []), ([100_000, 0, 100_000, 400_000], 100_000, [4.0]), ([10] * 7 + [90], 100, []),
    ],
)
def test_baseline(spark, counts, least, want):
    assert [r["ratio"] for r in anomaly.anomaly_days(daily(spark, counts), min_count=least).collect()] == want

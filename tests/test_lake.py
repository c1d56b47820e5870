import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from flowlake.functions import net
from flowlake.operators import registry, report, search
from flowlake.plans import fixtures as fx
from flowlake.sources import lake, legacy, raw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return fx.event_logs(spark, SF).drop("event_id").cache()


def days(spark, *names):
    return spark.createDataFrame([(date.fromisoformat(n),) for n in names], "day date")


def test_addresses(spark):
    texts = {"0.0.0.0": 0, "8.8.8.8": 134744072, "255.255.255.255": 4294967295, "1.2.3.256": None, "01.2.3.4": None, "1.2.3": None, "": None, "a.b.c.d": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", net.ip_value(F.col("t")))
    assert {r["t"]: r["v"] for r in df.collect()} == texts
    back = spark.createDataFrame([(-1,), (134744072,), (None,)], "v long").select(net.ip_text(F.col("v")).alias("t"))
    assert [r["t"] for r in back.collect()] == ["255.255.255.255", "8.8.8.8", None]
    w = spark.createDataFrame([("2024-01-10", "12:30"), ("2024-01-10", "x")], "d string, c string")
    assert [r[0] for r in w.select(net.window_epoch(F.col("d"), F.col("c"))).collect()] == [1704889800, None]


def test_import_archive_and_retention(spark, logs, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    lake.import_days(logs, hot)
    n = logs.count()
    lake.import_days(logs, hot)  # all days are known
    assert lake.read_lake(spark, hot).count() == n
    lake.import_days(lake.scan_day(logs, "2024-01-03"), hot, overwrite=True)  # replaces that day only
    assert lake.read_lake(spark, hot).count() == n
    cat = lake.catalog(spark, hot, "hot")
    old = lake.days_to_archive(cat, "2024-01-31", 20)
    assert {r["day"] for r in old.collect()} == {date(2024, 1, d) for d in range(1, 11)}
    old = days(spark, *[str(r["day"]) for r in old.collect()])
    lake.archive_days(spark, hot, cold, old)
    lake.archive_days(spark, hot, cold, old)  # nothing left to do
    both = lake.precedence(lake.catalog(spark, hot, "hot"), lake.catalog(spark, cold, "cold"))
    assert both.count() == 30
    rows = lake.read_lake(spark, hot).unionByName(lake.read_lake(spark, cold))
    assert rows.exceptAll(logs).isEmpty() and logs.exceptAll(rows).isEmpty()
    assert lake.drop_days(spark, cold, days(spark, "2024-01-01", "2024-02-01")) == 1
    assert lake.read_lake(spark, cold).where("day = DATE'2024-01-01'").isEmpty()
    assert lake.days_expired(lake.catalog(spark, cold, "cold"), "2026-01-01", 0).isEmpty()


def test_search_reads_one_partition_with_pushed_filters(spark, logs, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_archive(logs, path)
    plan = search.page(lake.read_lake(spark, path), search.Search("2024-01-10", nat_ip=2868227962))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(nat_ip,2868227962)" in plan and "TakeOrderedAndProject" in plan


def test_pages_by_key_equal_pages_by_offset(logs):
    q = search.Search("2024-01-10", per_page=7)
    first = search.page(logs, q).collect()
    second = search.page(logs, search.Search("2024-01-10", page=2, per_page=7)).collect()
    assert search.page_after(logs, q, first[-1].asDict()).collect() == second and second


def test_csv_file(spark, logs, tmp_path):
    out = str(tmp_path / "csv")
    search.write_csv(lake.scan_day(logs, "2024-01-10").withColumn("in_iface", F.lit("a,b")), out)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert ",".join(search.EXPORT_COLUMNS) in lines and len(lines) == lake.scan_day(logs, "2024-01-10").count() + 1
    assert all(len(x.split(",")) == 15 for x in lines) and any(",a b," in x for x in lines)


def test_sidecars(spark, tmp_path):
    (tmp_path / "2024-01-02.dicts.json").write_text(json.dumps({"interfaces": {"1": "VLAN P2P"}, "protocols": {"1": "UDP"}}))
    got = sorted(tuple(r) for r in lake.read_sidecars(spark, str(tmp_path)).collect())
    assert got == [(date(2024, 1, 2), "interfaces", 1, "VLAN P2P"), (date(2024, 1, 2), "protocols", 1, "UDP")]
    empty = tmp_path / "none"
    empty.mkdir()
    assert lake.read_sidecars(spark, str(empty)).isEmpty()
    lake.write_dicts(lake.read_sidecars(spark, str(tmp_path)), str(tmp_path / "dims"))
    assert spark.read.parquet(str(tmp_path / "dims")).count() == 2


def test_raw_files(spark, tmp_path):
    from flowlake.operators import parse

    line = "2026-03-17 16:44:49 firewall,info forward: in:VLAN1 out:e1, connection-state:new proto UDP, 100.64.1.2:4{:04d}->8.8.8.8"
    tail = ":443, NAT (100.64.1.2:40000->170.245.175.121:1024)->8.8.8.8:443, len 60"
    (tmp_path / "2026-03-17-16.raw").write_bytes(b"\n".join(f"{line.format(k)}\n {tail}".encode() for k in range(500)) + b"\njunk \xff\n")
    (tmp_path / "other.raw").write_text("x\n")
    (tmp_path / "skip.txt").write_text("x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many splits of one file
    try:
        lines = raw.read_raw(spark, [str(tmp_path), str(tmp_path)])
        rows, quality = raw.import_raw(lines)
        assert rows.count() == 500 and {r["src_port"] for r in rows.collect()} == {40000 + k for k in range(500)}
        assert sorted((r["file"].rsplit("/", 1)[1], r["parsed"], r["rejected"]) for r in quality.collect()) == [("2026-03-17-16.raw", 500, 1), ("other.raw", 0, 1)]
        assert [r["file"].rsplit("/", 1)[1] for r in raw.undated(lines).collect()] == ["other.raw"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_layouts():
    assert legacy.layout({"logs", "ip_addresses", "interfaces"}) == "v2" and legacy.layout({"logs", "d_interfaces", "d_protocols"}) == "b"
    assert legacy.layout({"logs", "interfaces", "protocols", "conn_states", "db_meta"}) == "c" and legacy.layout({"logs"}) == "a"
    assert legacy.layout({"logs", "d_protocols"}) == "b" and legacy.layout({"d_interfaces", "db_meta", "interfaces", "protocols", "conn_states"}) == "b"
    assert legacy.layout({"logs", "db_meta"}) == legacy.layout({"interfaces", "protocols", "conn_states"}) == legacy.layout({"x"}) == "a"


def test_legacy_import(spark, tmp_path):
    names = "timestamp string, interface_in string, interface_out string, proto string, src_ip_priv string, src_port_priv int, dst_ip string, dst_port int, nat_ip_pub string, nat_port_pub int"
    rows = lambda n, day: spark.createDataFrame([(f"{day} 01:02:03", "", "e1", "TCP", "100.64.1.2", k, "8.8.8.8", 443, "170.245.175.121", 1) for k in range(n)], names)
    c = spark.createDataFrame([(1704070861, 1, 1, 6, 1, 0, 1681916162, 5, 134744072, 80, -1426739335, 7, 60, None, None)],
                              "ts long, in_iface_id int, out_iface_id int, proto_id int, conn_state_id int, has_snat int, src_ip long, src_port int, dst_ip long, dst_port int, nat_ip long, nat_port int, pkt_len int, tcp_flags string, log_type string")
    dim = lambda *n: spark.createDataFrame(list(n), "id int, name string")
    c_tables = {"db_meta": dim((1, "x")), "logs": c, "interfaces": dim((1, "VLAN1")), "protocols": dim((6, "TCP")), "conn_states": dim((1, "new"))}
    path = str(tmp_path / "lake")
    sources = {"logs_2024-01-05.db": {"logs": rows(3, "2024-01-05")}, "logs_2024-01-01.db": c_tables, "undated.db": {"logs": rows(1, "2024-01-09")}, "2024-01-07.db": {"d_protocols": dim((1, "x")), "logs": rows(1, "2024-01-07")}}
    got = {r["source"]: (r["layout"], str(r["day"]), r["rows"], r["state"]) for r in legacy.import_sources(spark, sources, path).collect()}
    assert got == {
        "logs_2024-01-05.db": ("a", "2024-01-05", 3, "imported"), "logs_2024-01-01.db": ("c", "2024-01-01", 1, "imported"),
        "undated.db": ("a", "None", None, "failed"), "2024-01-07.db": ("b", "2024-01-07", None, "failed"),
    }
    lake_rows = lake.read_lake(spark, path)
    assert lake_rows.count() == 4 and lake_rows.where("day = DATE'2024-01-01'").first()["nat_ip"] == 2868227961
    more = {"logs_2024-01-05.db": {"logs": rows(9, "2024-01-05")}, "logs_2024-01-06.db": {"logs": rows(2, "2024-01-06")}}
    assert {r["source"]: (r["rows"], r["state"]) for r in legacy.import_sources(spark, more, path).collect()} == {"logs_2024-01-05.db": (None, "skipped"), "logs_2024-01-06.db": (2, "imported")}
    assert lake.read_lake(spark, path).count() == 6
    legacy.import_sources(spark, more, path, overwrite=True)
    assert lake.read_lake(spark, path).count() == 12
    assert legacy.import_sources(spark, {}, path).isEmpty()


def test_many_legacy_sources_are_joined_once(spark, tmp_path, monkeypatch):
    dim = lambda *n: spark.createDataFrame(list(n), "id int, name string")
    sources = {}
    for k in range(6):  # each source has dictionaries of its own
        c = spark.createDataFrame([(1704070861 + k, 1, 2, 6, 1, 0, k, 5, k, 80, k, 7, 60, None, None)],
                                  "ts long, in_iface_id int, out_iface_id int, proto_id int, conn_state_id int, has_snat int, src_ip long, src_port int, dst_ip long, dst_port int, nat_ip long, nat_port int, pkt_len int, tcp_flags string, log_type string")
        sources[f"logs_2024-02-0{k + 1}.db"] = {"db_meta": dim((1, "x")), "logs": c, "interfaces": dim((1, f"VLAN{k}"), (2, f"e{k}")), "protocols": dim((6, "TCP")), "conn_states": dim((1, f"s{k}"))}
    plans, real = [], lake.written
    monkeypatch.setattr(lake, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    got = legacy.import_sources(spark, sources, str(tmp_path / "lake"))
    assert {r["state"] for r in got.collect()} == {"imported"} and plans[0].count("Join ") <= 5
    rows = {str(r["day"]): r for r in lake.read_lake(spark, str(tmp_path / "lake")).collect()}
    assert all(rows[f"2024-02-0{k + 1}"][c] == f"{n}{k}" for k in range(6) for c, n in (("in_iface", "VLAN"), ("out_iface", "e"), ("conn_state", "s")))


def test_catalog_has_the_files_sizes(spark, logs, tmp_path):
    path = tmp_path / "lake"
    lake.write_archive(logs, str(path), files=3)
    want = {}
    for f in path.glob("day=*/*.parquet"):
        n, size = want.get(f.parent.name[4:], (0, 0))
        want[f.parent.name[4:]] = (n + 1, size + f.stat().st_size)
    assert {str(r["day"]): (r["files"], r["size_bytes"]) for r in lake.catalog(spark, str(path), "cold").collect()} == want


def test_days_that_are_not_there(spark, logs, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    lake.import_days(lake.scan_range(logs, "2024-01-01", "2024-01-03"), hot)
    lake.archive_days(spark, hot, cold, days(spark, "2024-01-02", "2024-05-05"))
    assert lake.days_in(spark, hot) == ["2024-01-01", "2024-01-03"] and lake.days_in(spark, cold) == ["2024-01-02"]
    assert [p.name for p in tmp_path.iterdir() if "stage" in p.name] == []
    cat = {str(r["day"]): r["files"] for r in lake.catalog(spark, hot, "hot").collect()}
    assert set(cat) == {"2024-01-01", "2024-01-03"} and min(cat.values()) >= 1
    for day in ("2024-01-02", "2024-01-03"):
        assert search.search_lake(spark, hot, cold, search.Search(day)).count() == lake.scan_day(logs, day).count() > 0
    assert search.search_lake(spark, hot, cold, search.Search("2024-01-03", nat_ip=1)).isEmpty()
    with pytest.raises(search.UnknownDay):
        search.search_lake(spark, hot, cold, search.Search("2024-01-04"))


def test_a_cluster_must_name_its_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://x:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lake.scratch(Session(), "x")


def test_long_windows_and_bad_ones(spark, logs):
    first = logs.agg(F.min("ts")).first()[0]
    wanted = [(1, None, 0, 12 * 86400), (2, 5, 100, 100), (3, None, 0, 7 * 3600), (4, None, 10, 5), (5, None, 0, 20 * 366 * 86400), (6, None, None, 5)]
    nat = logs.first()["nat_ip"]
    r = spark.createDataFrame([(i, nat, p, None if a is None else first + a, first + b) for i, p, a, b in wanted], "request_id int, nat_ip long, nat_port int, t0 long, t1 long")
    got = {x["request_id"]: x["n"] for x in search.search_batch(logs, r, 10**6).groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, span in ((1, 12 * 86400), (3, 7 * 3600), (5, 20 * 366 * 86400)):
        assert got.get(i, 0) == logs.where((F.col("nat_ip") == nat) & F.col("ts").between(first, first + span)).count()
    assert got[1] > 0 and set(got) <= {1, 2, 3, 5}
    assert {x["request_id"]: x["reason"] for x in search.bad_windows(r).collect()} == {4: "window ends before it begins", 6: "no window"}


def test_windows_of_every_length(spark, logs):
    import random

    rng = random.Random(6)
    first, nats = logs.agg(F.min("ts")).first()[0], [r["nat_ip"] for r in logs.select("nat_ip").distinct().collect()]
    wanted = [(i, rng.choice([*nats, 1]), rng.choice([None, None, 1500]), a := first + rng.randint(-(10**5), 2_400_000), a + rng.choice([0, 1, 63, 64, 5000, 10**5, 10**6, 10**7, 10**10])) for i in range(90)]
    wanted += [(100, nats[0], None, -(1 << 40), 1 << 40), (101, nats[1], None, first, first), (102, None, None, 0, 1 << 60)]
    r = spark.createDataFrame(wanted, "request_id int, nat_ip long, nat_port int, t0 long, t1 long")
    got = {x["request_id"]: x["n"] for x in search.search_batch(logs, r, 10**6).groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = logs.select("nat_ip", "nat_port", "ts").collect()
    for i, ip, port, a, b in wanted:
        assert got.get(i, 0) == sum(x["nat_ip"] == ip and a <= x["ts"] <= b and port in (None, x["nat_port"]) for x in rows), (i, a, b)
    assert got[100] > 0 and len(got) > 10
    assert search.search_batch(logs, r.limit(0)).isEmpty()


def test_windows_prune_days_and_scan_once(spark, logs, tmp_path):
    lake.write_archive(logs, str(tmp_path / "lake"))
    first = logs.agg(F.min("ts")).first()[0]
    r = spark.createDataFrame([(1, 5, None, first, first + 100), (2, 5, None, first, first + 90_000)], "request_id int, nat_ip long, nat_port int, t0 long, t1 long")
    plan = search.search_batch(lake.read_lake(spark, str(tmp_path / "lake")), r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(day" in plan


def test_ids_without_a_name(spark):
    dims = spark.createDataFrame([("d", "interfaces", 1, "VLAN1"), ("d", "protocols", 1, "GRE")], "day string, kind string, id int, name string")
    rows = spark.createDataFrame([("d", 1, 9, 1, None), ("d", None, 1, 2, 4), ("e", 1, 1, 1, 1)], "day string, in_iface_id int, out_iface_id int, proto_id int, conn_state_id int")
    got = sorted(tuple(r) for r in registry.decode(rows, dims).select("day", "in_iface", "out_iface", "proto", "conn_state").fillna("-").collect())
    assert got == [("d", "-", "VLAN1", "UDP", "id=4"), ("d", "VLAN1", "id=9", "GRE", "-"), ("e", "id=1", "id=1", "TCP", "id=1")]


def test_many_addresses_first_seen_at_one_time(spark):
    dim = spark.createDataFrame([(k, 1, 7 if k > 5 else k, 9) for k in range(500)], "ip long, total_hits long, first_seen long, last_seen long")
    old = spark.createDataFrame([(3, 100)], "ip long, ip_id long")
    ids = {r["ip"]: r["ip_id"] for r in registry.assign_ids(dim, old, 6).collect()}
    assert ids == {3: 100} | {ip: 101 + k for k, ip in enumerate(x for x in range(500) if x != 3)}


def test_shares_and_reasons(spark, logs):
    from flowlake.operators import classify, profile

    day = lake.scan_day(logs, "2024-01-10")
    n = day.count()
    r = report.classified(report.day_report(day, 2, 2, 2), classify.Scale(volume=1000, spread=20)).first()
    assert all(x["pct"] == int(x["connections"] / n * 1000 + 0.5) / 10 for x in r["top_sources"])
    assert all(x["pct"] == int(x["n"] / n * 10000 + 0.5) / 100 for x in [*r["top_ports"], *r["top_destinations"]])
    assert r["reasons"] and r["causes"] and profile.globals_of(day).first()["total"] == n
    text = report.narrative(spark.createDataFrame([r.asDict()], report.classified(report.day_report(day, 2, 2, 2)).schema)).first()["analysis"]
    assert all(x in text for x in r["reasons"]) and r["category"] in text


def test_report_of_one_day_equals_its_row_of_all_days(spark, logs):
    one = report.day_stats(lake.scan_day(logs, "2024-01-10"), 2, 2, 2).collect()
    every = report.day_stats(logs, 2, 2, 2).where("day = DATE'2024-01-10'").collect()
    assert one == every and len(one) == 1


def test_batches_in_reversed_order_of_time_decode(spark, logs, tmp_path):
    import threading

    path, columns = str(tmp_path / "dicts"), logs.columns
    half = logs.agg(F.percentile_approx("ts", 0.5)).first()[0]
    newer, older = logs.where(F.col("ts") >= half), logs.where(F.col("ts") < half)
    same_day = logs.where("day = DATE'2024-01-10'")
    late, early = same_day.where("proto = 'UDP' and ts % 2 = 0").withColumn("in_iface", F.lit("late")), same_day.withColumn("ts", F.col("ts") - 86_400)
    coded = []
    for batch in (newer, late, older, early):
        registry.store_dicts(spark, path, batch)
        coded.append(lake.written(registry.encode(batch, registry.read_dicts(spark, path)), "coded"))
    dims = registry.read_dicts(spark, path)
    for batch, rows in zip((newer, late, older, early), coded):
        back = registry.decode(rows, dims).select(*columns)
        assert back.exceptAll(batch).isEmpty() and back.count() == batch.count()
    threads = [threading.Thread(target=registry.store_dicts, args=(spark, path, logs.withColumn("in_iface", F.concat("in_iface", F.lit(x))))) for x in "pqr"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = registry.read_dicts(spark, path).groupBy("day", "kind", "id").count()
    assert ids.where("count > 1").isEmpty() and registry.read_dicts(spark, path).groupBy("day", "kind", "name").count().where("count > 1").isEmpty()
    assert registry.read_dicts(spark, path).where("name like '%q'").count() > 0
    assert registry.decode(coded[1], registry.read_dicts(spark, path)).select(*columns).exceptAll(late).isEmpty()


def joined_rows(df):
    """Rows that the joins of a query give, after it has run."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().get("numOutputRows").get().value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_long_windows_meet_a_few_rows_of_many(spark):
    """500 windows of weeks over 20,000 rows of one address: 10 million pairs, of which 5 rows a window are asked for."""
    from datetime import timedelta

    from flowlake.schemas import CONN_LOGS

    n, start = 20_000, 1704067200
    at = lambda k: start + k * 97 % 1_700_000
    rows = [(at(k), date(1970, 1, 1) + timedelta(at(k) // 86_400), "a", "b", "TCP" if k % 3 else None, "new", True, k, 5, 9, 53, 77, k % 4 or None, 40, None, "nat") for k in range(n)]
    logs = spark.createDataFrame(rows, CONN_LOGS)
    wanted = [(k, 77, 2 if k % 5 == 0 else None, start + k * 31, start + k * 31 + (1_600_000 if k % 2 else 3)) for k in range(500)]
    wanted.append((7, 77, None, start + 50, start + 60))  # a second window of one request
    r = spark.createDataFrame(wanted, "request_id int, nat_ip long, nat_port int, t0 long, t1 long")
    df = search.search_batch(logs, r, 5)
    assert joined_rows(df) < 200 * len(wanted)
    got = {}
    for x in df.collect():
        got.setdefault(x["request_id"], []).append((x["nth"], x["ts"], x["src_ip"]))
    by_time = sorted((x[0], x[7], x[12]) for x in rows)
    for i, _, port, a, b in wanted[:500]:
        own = [(a, b)] + ([wanted[-1][3:]] if i == 7 else [])
        want = sorted((t, s) for lo, hi in own for t, s, p in by_time if lo <= t <= hi and port in (None, p))[:5]
        assert sorted(got.get(i, [])) == [(k + 1, *x) for k, x in enumerate(want)], i

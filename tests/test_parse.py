from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowlake.operators import parse

NOW = int(datetime(2026, 3, 18, 12, tzinfo=timezone.utc).timestamp())
BODY = "forward: in:{i} out:ether1, connection-state:{s} src-mac 00:11:22:33:44:55, proto {p}, 100.64.1.2:40000->8.8.8.8:443, NAT (100.64.1.2:40000->170.245.175.121:1024)->8.8.8.8:443, len 60"


def body(i="VLAN10", s="new,snat", p="TCP (SYN)"):
    return BODY.format(i=i, s=s, p=p)


def stamp(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


LINES = {
    "A": ("2026-03-17 16:44:49 firewall,info " + body(), stamp(2026, 3, 17, 16, 44, 49)),
    "B": ("Mar 17 16:39:52 CGNAT-1 LOG_NAT: " + body(p="UDP"), stamp(2026, 3, 17, 16, 39, 52)),
    "C": (" 10:20:30 CGNAT: " + body(), stamp(2026, 3, 18, 10, 20, 30)),
    "D": ("<30>Mar 17 16:39:52 gw " + body(i="VLAN P2P"), stamp(2026, 3, 17, 16, 39, 52)),
    "E": ("2025-11-15T00:16:50-04:00 gw LOG_NAT: LOG_NAT " + body().replace(", connection", ", connection-mark:m1 connection"), stamp(2025, 11, 15, 4, 16, 50)),
}


def parsed(spark, lines, now=NOW):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    return {r["k"]: r for r in parse.parse(df, F.lit(now)).collect()}


def test_five_formats(spark):
    got = parsed(spark, [x for x, _ in LINES.values()])
    for k, (letter, (_, ts)) in enumerate(LINES.items()):
        r = got[k]
        assert r["ok"], (letter, r["reason"])
        assert (r["format"], r["ts"], r["ts_inferred"]) == (letter, ts, False)
        assert (r["src_port"], r["dst_port"], r["nat_port"], r["pkt_len"]) == (40000, 443, 1024, 60)
        assert (r["src_ip"], r["dst_ip"], r["nat_ip"]) == (1681916162, 134744072, 2868227961)
        assert r["conn_state"] == "new" and r["has_snat"] and r["src_mac"] == "00:11:22:33:44:55"
    assert got[1]["proto"] == "UDP" and got[1]["tcp_flags"] is None and got[0]["tcp_flags"] == "SYN"
    assert got[3]["in_iface"] == "VLAN P2P" and got[4]["conn_mark"] == "m1"


def test_rejects(spark):
    a = "2026-03-17 16:44:49 "
    cases = {
        "": "no time", "free text": "no time", a + "topics,info: x": "not nat: other", a + "system,info user in": "not nat: system",
        a + "forward: in:a out:b, connection-state:new proto TCP, 1.2.3.4:1->2.3.4.5:2, len 3": "no nat fields",
        a + body().replace("8.8.8.8", "8.8.8.300"): "bad address", a + body().replace(":40000", ":70000"): "bad port",
    }
    got = parsed(spark, list(cases))
    assert [got[k]["reason"] for k in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize(
    "text, fmt, want",
    [
        ("Dec 31 23:00:00", "B", stamp(2025, 12, 31, 23)),  # more than 25 hours ahead: the year before
        ("Mar 19 12:30:00", "B", stamp(2026, 3, 19, 12, 30)),  # less than 25 hours ahead
        ("Mar  7 01:02:03", "D", stamp(2026, 3, 7, 1, 2, 3)), ("Foo 17 01:02:03", "B", None), ("Feb 30 01:02:03", "B", None),
        ("2026-01-02T03:04:05Z", "E", stamp(2026, 1, 2, 3, 4, 5)), ("2026-01-02T03:04:05,5+0200", "E", stamp(2026, 1, 2, 1, 4, 5)), ("2026-13-02 00:00:00", "A", None),
    ],
)
def test_times(spark, text, fmt, want):
    df = spark.createDataFrame([(text, fmt)], "t string, f string")
    assert df.select(parse.parse_time(F.col("t"), F.col("f"), F.lit(NOW))).first()[0] == want


def test_unreadable_time_is_now_and_marked(spark):
    r = parsed(spark, ["Foo 17 16:39:52 gw " + body()])[0]
    assert r["ok"] and r["ts"] == NOW and r["ts_inferred"]


def test_continuations(spark):
    lines = ["  :1, first of the file", "a->8.8.8.8", "  :443, NAT", "b", "", ":5, after blank", "12:7 x", "c->1.2.3", "4:80)"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)] + [("g", 0, ":9, own file")], "file string, pos int, value string")
    got = sorted((r["file"], r["pos"], r["line"]) for r in parse.join_continuations(df).collect())
    assert got == [("f", 0, "  :1, first of the file"), ("f", 1, "a->8.8.8.8:443, NAT"), ("f", 3, "b"), ("f", 5, ":5, after blank12:7 x"), ("f", 7, "c->1.2.34:80)"), ("g", 0, ":9, own file")]


def test_continuations_across_ranges_of_a_file(spark, monkeypatch):
    lines = [":1 x", " :2 y", ":3,", "a", " :4,", "", ":5,", ":6,", "b ", ":7,", ":8,", ":9,", ":10,", ":11,", "c", "", "", ":12,", "d", "e", ":13)", ":14)"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)] + [("g", k, "h" if k == 40 else ":1,") for k in range(38, 50)], "file string, pos int, value string")
    whole = sorted(map(tuple, parse.join_continuations(df).collect()))
    assert whole[0] == ("f", 0, ":1 x:2 y:3,") and ("f", 6, ":5,:6,") in whole and ("f", 8, "b :7,:8,:9,:10,:11,") in whole and ("f", 19, "e:13):14)") in whole
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(parse, "RANGE", size)
        assert sorted(map(tuple, parse.join_continuations(df).collect())) == whole


def test_null_lines_between_others(spark):
    lines = [None, "a", None, ":1, of a", "b", None, "", None, "c"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)] + [("g", 0, None)], "file string, pos int, value string")
    assert sorted(map(tuple, parse.join_continuations(df).collect())) == [("f", 1, "a:1, of a"), ("f", 4, "b"), ("f", 8, "c")]


def test_a_line_that_holds_the_mark(spark):
    got = parsed(spark, ["\x01 x", LINES["A"][0] + "\x01", "\x012026-03-17 16:44:49 " + body()])
    assert [got[k]["reason"] for k in range(3)] == ["no time", None, "no time"]


def test_prefixes(spark):
    bodies = ["LOG_NAT: forward: in:x", "LOG_NAT: LOG_NAT forward: in:x", "cgnat: firewall,info,ct forward: in:x", "Forward: in:x", "system,error,critical login failure", "dhcp x"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    got = {r["k"]: (r["log_type"], r["nat_body"]) for r in parse.normalise(df).collect()}
    assert [got[k][0] for k in range(6)] == ["nat"] * 4 + ["system", "other"]
    assert got[0][1] == got[1][1] == got[2][1] == "forward: in:x" and got[3][1] == "Forward: in:x"


def test_very_long_lines_stay_whole(spark):
    name = "V" * 1_500_000
    r = parsed(spark, ["2026-03-17 16:44:49 firewall,info " + body(i=name), "2026-03-17 16:44:49 " + "x" * 1_500_000])
    assert r[0]["ok"] and r[0]["in_iface"] == name and len(r[1]["body"]) == 1_500_000

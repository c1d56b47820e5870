"""Traffic classes of a day's statistics: a table of scoring rules, applied as Column expressions.

A rule list is data: each step is a chain of (condition, points) of which the first that holds
counts, or a deduction that stops at zero. Conditions are SQL over the statistics' columns and the
running score ``s``; volumes are multiples of the thresholds' scale, so that small tables exercise them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that the rules read.
STATS = [
    "total", "unique_src", "unique_dst", "unique_dst_ports", "suspects", "avg_ports", "top_pct", "wk_pct", "reg_pct", "eph_pct",
    "dns", "dns_pct", "http_pct", "ntp", "ntp_pct", "tt_ports", "tt_ips", "tt_wk_pct", "ntp_clients", "ntp_servers", "dns_clients",
    "dns_servers", "max_flow", "udp_on_tcp", "udp_pct",
]


@dataclass(frozen=True)
class Scale:
    """Divides the rules' volumes: connection counts and distinct counts."""

    volume: float = 1.0
    spread: float = 1.0


# Classes in order, their codes, and scoring rules. v() and d() scale volumes and distinct counts.
UNKNOWN = ("unknown", "Alto Volume (Indeterminado)")
NAMES = {
    "p2p": "P2P/Torrent", "ntp": "Abuso de Protocolo (NTP)", "dns": "Abuso de Protocolo (DNS)", "dos": "Ataque/DoS",
    "scan": "Varredura de Portas", "botnet": "Botnet/C2", "bandwidth": "Abuso de Banda", "flood": "Flood/Loop/Tráfego Automatizado",
    "malware": "Malware/Comportamento Anômalo",
}
LEAST = 0.30


def rules(scale: Scale = Scale()) -> dict[str, list]:
    def v(n: float) -> str:
        return repr(n / scale.volume)

    def d(n: float) -> str:
        return repr(n / scale.spread)

    return {
        "p2p": [
            [(f"tt_ports >= {d(2000)} AND tt_ips >= {d(2000)}", 0.30), (f"tt_ports >= {d(500)} AND tt_ips >= {d(500)}", 0.15)],
            [(f"suspects >= {d(20)} AND avg_ports >= {d(100)}", 0.30), (f"suspects >= {d(5)} AND avg_ports >= {d(50)}", 0.15)],
            [(f"eph_pct >= 0.30 AND unique_dst_ports >= {d(3000)}", 0.20), (f"reg_pct + eph_pct >= 0.70 AND unique_dst_ports >= {d(1500)}", 0.10)],
            [(f"unique_dst >= {d(10000)}", 0.15), (f"unique_dst >= {d(3000)} AND s >= 0.15", 0.08)],
            [("http_pct < 0.10 AND dns_pct < 0.20 AND s >= 0.15", 0.10)],
            ("http_pct >= 0.50", 0.20), ("wk_pct >= 0.70", 0.15), (f"max_flow >= {v(5000)}", 0.20),
        ],
        "ntp": [
            [(f"ntp >= {v(100000)} AND ntp_pct >= 0.02 AND ntp_clients <= 3", 0.70), (f"ntp >= {v(100000)} AND ntp_pct >= 0.02 AND ntp_clients <= 10", 0.50)],
            [(f"ntp >= {v(100000)} AND ntp_pct >= 0.02 AND ntp_servers >= {d(50)}", 0.15)],
        ],
        "dns": [
            [(f"dns >= {v(500000)} AND dns_pct >= 0.15 AND dns_clients <= 5", 0.60), (f"dns >= {v(500000)} AND dns_pct >= 0.15 AND dns_servers <= 3 AND dns_clients >= {d(20)}", 0.55)],
            [(f"dns >= {v(500000)} AND dns_pct >= 0.15 AND dns_servers >= {d(100)} AND dns_clients <= 5", 0.15)],
        ],
        "dos": [
            [("top_pct >= 0.80 AND unique_dst <= 10", 0.55), ("top_pct >= 0.60 AND unique_dst <= 20", 0.35)],
            [("unique_src <= 5 AND unique_dst <= 5", 0.25)],
            [("unique_dst_ports <= 5 AND s >= 0.25", 0.15)],
            (f"unique_dst >= {d(1000)}", 0.30), (f"suspects >= {d(10)}", 0.15),
        ],
        "scan": [
            [(f"unique_src <= 10 AND unique_dst_ports >= {d(1000)}", 0.55), (f"unique_src <= 5 AND unique_dst_ports >= {d(500)}", 0.40)],
            [(f"unique_dst >= {d(500)} AND unique_src <= 10", 0.20)],
            (f"unique_src >= {d(30)}", 0.25),
        ],
        "botnet": [
            [(f"unique_src >= {d(30)} AND unique_dst <= 10 AND unique_dst_ports <= 5", 0.70), (f"unique_src >= {d(20)} AND unique_dst <= 15 AND unique_dst_ports <= 8", 0.45)],
            [(f"unique_src >= {d(30)} AND top_pct <= 0.15", 0.15)],
            [(f"udp_on_tcp >= {v(5000)} AND s >= 0.20", 0.15)],
        ],
        "bandwidth": [
            [(f"top_pct >= 0.50 AND p2p_score < 0.40 AND dos_score < 0.35 AND tt_wk_pct >= 30 AND tt_ports < {d(500)}", 0.50), ("top_pct >= 0.50 AND p2p_score < 0.40 AND dos_score < 0.35 AND unique_src >= 3", 0.35)],
        ],
        "flood": [[(f"max_flow >= {v(500000)}", 0.90), (f"max_flow >= {v(100000)}", 0.80), (f"max_flow >= {v(10000)}", 0.65), (f"max_flow >= {v(1000)}", 0.45)]],
        "malware": [
            [(f"udp_on_tcp >= {v(10000)} AND udp_pct >= 0.01", 0.60), (f"udp_on_tcp >= {v(1000)}", 0.40)],
            [("s >= 0.30 AND flood_score >= 0.30", 0.20)],
        ],
    }


#: What may lie behind each class: what to look for first.
CAUSES = {
    "p2p": ["A file-swapping program on a customer's computer", "A set-top box that shares its streams with its neighbours", "A game whose players connect to each other"],
    "ntp": ["A clock client that asks again at once when no answer comes", "A box whose time server is gone", "Forged requests that use customers as reflectors"],
    "dns": ["A program that hides data in names", "A resolver that answers the whole Internet", "Clients that repeat failed look-ups without a pause"],
    "dos": ["A customer's machine under someone else's command", "A tool that measures throughput against one target", "A reply storm after an outage at the target"],
    "scan": ["Someone maps the network, with or without leave", "A worm that looks for its next host", "An inventory tool with too wide a range"],
    "botnet": ["Devices that report to one controller", "A hidden coin miner in many homes", "A popular device whose maker has a single server"],
    "bandwidth": ["Very large downloads or backups", "Video in the highest resolution for hours", "A server that runs on a home line"],
    "flood": ["A device that restarts the same connection for ever", "A monitor whose interval is far too short", "A tunnel that never comes up and is tried again"],
    "malware": ["A tunnel that borrows ports of other services", "A device with a broken network stack", "A test program that sends nonsense on purpose"],
    "unknown": ["A software release that many fetch at once", "An event that many watch at once", "More customers than before"],
}


def _n(c: str) -> Column:
    return F.format_number(F.col(c), 0)


def _pct(c: str) -> Column:
    return F.format_string("%.1f%%", F.col(c) * 100)


def evidence() -> dict[str, list[tuple[str, Column]]]:
    """For each class, the columns (of ``layers``, or a condition) whose points a text explains, and the texts, from the day's numbers."""
    say = F.format_string
    return {
        "p2p": [
            ("p2p_0 > 0", say("The busiest source reached %s addresses on %s ports", _n("tt_ips"), _n("tt_ports"))),
            ("p2p_1 > p2p_0", say("%s sources spread over many ports, the mean is %.0f", _n("suspects"), F.col("avg_ports"))),
            ("p2p_2 > p2p_1", say("%s of the ports are high ones, %s different ports in all", _pct("eph_pct"), _n("unique_dst_ports"))),
            ("p2p_3 > p2p_2", say("%s different addresses were called", _n("unique_dst"))),
            ("p2p_4 > p2p_3", say("Little of it is web (%s) or DNS (%s)", _pct("http_pct"), _pct("dns_pct"))),
        ],
        "ntp": [
            ("ntp_0 > 0", say("%s clients sent %s time requests, %s of all", _n("ntp_clients"), _n("ntp"), _pct("ntp_pct"))),
            ("ntp_0 > 0 AND ntp_clients = 1", F.lit("All of them come from a single client")),
            ("ntp_1 > ntp_0", say("They went to %s servers", _n("ntp_servers"))),
            ("ntp_0 > 0 AND ntp_servers <= 3 AND ntp_clients <= 3", say("Few clients keep asking the same %s servers", _n("ntp_servers"))),
        ],
        "dns": [
            ("dns_0 > 0", say("%s clients sent %s name queries, %s of all, to %s servers", _n("dns_clients"), _n("dns"), _pct("dns_pct"), _n("dns_servers"))),
            ("dns_1 > dns_0", say("So few clients seldom need %s servers", _n("dns_servers"))),
        ],
        "dos": [
            ("dos_0 > 0", say("One source makes %s of the traffic, to %s addresses in all", _pct("top_pct"), _n("unique_dst"))),
            ("dos_1 > dos_0", say("Only %s sources and %s destinations take part", _n("unique_src"), _n("unique_dst"))),
            ("dos_2 > dos_1", say("No more than %s ports are used", _n("unique_dst_ports"))),
        ],
        "scan": [
            ("scan_0 > 0", say("%s sources tried %s ports", _n("unique_src"), _n("unique_dst_ports"))),
            ("scan_1 > scan_0", say("They tried %s addresses", _n("unique_dst"))),
        ],
        "botnet": [
            ("botnet_0 > 0", say("%s sources call the same %s addresses on %s ports", _n("unique_src"), _n("unique_dst"), _n("unique_dst_ports"))),
            ("botnet_1 > botnet_0", say("None stands out: the first has %s", _pct("top_pct"))),
            ("botnet_2 > botnet_1", say("%s UDP connections went to TCP ports", _n("udp_on_tcp"))),
        ],
        "bandwidth": [("bandwidth_0 > 0", say("The busiest source has %s of all connections, %.0f%% of its ports are low ones", _pct("top_pct"), F.col("tt_wk_pct")))],
        "flood": [("flood_0 > 0", say("The same flow was opened %s times", _n("max_flow")))],
        "malware": [
            ("malware_0 > 0", say("%s UDP connections went to TCP ports, %s of all", _n("udp_on_tcp"), _pct("udp_pct"))),
            ("malware_1 > malware_0", F.lit("A flow that repeats without end comes with it")),
        ],
    }


def layers(scale: Scale = Scale()) -> list[tuple[str, str]]:
    """Column assignments ``(name, SQL expression)`` in order; each may read the ones before it."""
    out = []
    for code, steps in rules(scale).items():
        s = "CAST(0 AS DOUBLE)"
        for k, step in enumerate(steps):
            name = f"{code}_{k}"
            if isinstance(step, list):
                cases = " ".join(f"WHEN {c.replace(' s ', f' {s} ') if not c.startswith('s ') else s + c[1:].replace(' s ', f' {s} ')} THEN {points!r}" for c, points in step)
                out.append((name, f"{s} + CASE {cases} ELSE 0.0 END" if k else f"CAST(CASE {cases} ELSE 0.0 END AS DOUBLE)"))
            else:
                out.append((name, f"CASE WHEN {step[0]} THEN greatest({s} - {step[1]!r}, CAST(0 AS DOUBLE)) ELSE {s} END"))
            s = name
        # only candidates count, and none above 1; later classes read earlier ones
        out.append((f"{code}_score", f"CASE WHEN {s} >= {LEAST!r} THEN least({s}, CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"))
    return out


def scores(stats: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """``stats`` with a column ``code_score`` per class, 0 if it isn't a candidate, and one per step, for ``reasons``.

    Row-wise, no shuffle.
    """
    for name, sql in layers(scale):
        stats = stats.withColumn(name, F.expr(sql))
    return stats


def _rows() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("category"), F.col(f"{c}_score").alias("score")) for c, n in NAMES.items()])


def long_scores(scored: DataFrame) -> DataFrame:
    """``(day, category, score)`` of every class."""
    return scored.select("day", F.inline(_rows())).drop("code")


def best_of() -> Column:
    """(code, category, score) of the first class with the highest score above 0.30, else undetermined with 0.30."""
    start = F.struct(F.lit(UNKNOWN[0]).alias("code"), F.lit(UNKNOWN[1]).alias("category"), F.lit(LEAST).alias("score"))
    return F.aggregate(_rows(), start, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def best(scored: DataFrame) -> DataFrame:
    """``scored`` with code, category, score (rounded half up to two digits), reasons and causes."""
    found = scored.withColumn("_best", best_of())
    code = F.col("_best.code")
    score = F.floor(F.col("_best.score") * 100 + F.lit(0.5)) / F.lit(100.0)
    return found.withColumns({"code": code, "category": F.col("_best.category"), "score": score, "reasons": reasons(code), "causes": causes(code)}).drop("_best")


def reasons(code: Column) -> Column:
    """What in the day's numbers speaks for its class, as an array of texts."""
    out = F.lit(None).cast("array<string>")
    for name, items in evidence().items():
        texts = F.array_compact(F.array(*[F.when(F.expr(condition), text) for condition, text in items]))
        out = F.when(code == name, texts).otherwise(out)
    return F.coalesce(out, F.array(F.lit("The numbers fit no class")))


def causes(code: Column) -> Column:
    """Likely causes of a class code, as an array."""
    pairs = [x for c, texts in CAUSES.items() for x in (F.lit(c), F.array(*map(F.lit, texts)))]
    return F.element_at(F.create_map(*pairs), code)

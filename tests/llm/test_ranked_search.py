import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from flowlake.llm import ranked_search as rs
from flowlake.llm.queries import ORACLE_SQL, op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """(item_id, rank, score) and the set of (item_id, score, doc_id) of all documents."""
    every = [(i, Counter(terms(t))) for i, t in docs]
    every = [(i, c) for i, c in every if c]
    n, words = len(every), sum(sum(c.values()) for _, c in every)
    df = Counter(t for _, c in every for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in every:
            m = 50 + (50 * sum(c.values()) * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "A1", "漢字"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", ", ", "--"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 10, 40])))) for i in range(700)]
    docs += [(900, None), (901, ""), (902, " .. "), (5, docs[5][1]), (None, docs[9][1]), (903, " ".join(rng.choices(vocabulary, k=20_000)))]
    docs += [(1000 + i, "same words here w1 w2") for i in range(90)]  # ties
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 12])))) for i in range(25)]
    items += [(50, "same HERE"), (51, None), (52, ""), (53, "unknown"), (3, "w59 naïve"), (None, "w3 w3 Über"), (54, "w0 w1 w2 w3 w4 w58")]
    return docs, items


@pytest.mark.parametrize("block, segment", [(200_000, 1 << 14), (40, 64)])
def test_ranked_against_all_scores(spark, corpus, monkeypatch, block, segment):
    monkeypatch.setattr(rs, "BLOCK_TERMS", block)
    docs, items = corpus
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, rank int")
    if segment < 1 << 14:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = rs.ranked(d, q, 7)
        assert dict(got.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(5)
    stopped = 0
    for _ in range(200):
        docs, k = 300, int(rng.integers(1, 9))
        lists = []
        for j in range(int(rng.integers(1, 9))):
            at = np.sort(rng.choice(docs, int(rng.integers(1, 20 + 30 * j)), replace=False))
            lists.append((at, rng.integers(0, 4000 // (1 + j * j), len(at))))
        floor = int(rng.choice([0, 0, 500, 3000]))
        want = np.zeros(docs, np.int64)
        for at, c in lists:
            want[at] += c
        got, made = rs.term_at_a_time(lists, docs, k, floor)
        stopped += made < len(lists)
        kth = max(np.sort(want)[-k], floor, 1)
        best = want >= kth
        assert (got[best] == want[best]).all() and (got <= want).all()
    assert stopped > 40


def test_empty_tables(spark, corpus):
    docs, items = corpus
    d, q = spark.createDataFrame(docs[:20], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rs.ranked(d.limit(0), q).collect() == [] and rs.ranked(d, q.limit(0)).collect() == []
    assert rs.ranked(d.limit(0), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_its_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = con.execute(ORACLE_SQL["op12_ranked_search"])
    names = [x[0] for x in r.description]
    want = sorted(r.fetchall())
    assert sorted(tuple(x[c] for c in names) for x in op12_ranked_search(spark, sf).collect()) == want and len(want) > 1000

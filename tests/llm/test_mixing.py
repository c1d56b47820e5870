import hashlib
import re

import duckdb
import pytest

from flowlake.llm import mixing

ROWS = [(i, "w " * (i * 7 % 50), f"s{i % 5}") for i in range(200)] + [
    (300, None, "s1"), (301, "", None), (302, "a b c", None), (303, "x " * 3000, "s0"), (303, "x " * 3000, "s0"), (None, "y y", "s2"), (304, "", "void"),
]


def water(sizes, weights=(5, 2, 1), budget=1.5, repeats=2):
    """The rule as stated: share by weight, stop at the caps, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {s: 0.0 for s in order}
    while left > 1e-9 and open_:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            out[s] += share * weight[s] / total
            if out[s] >= repeats * sizes[s]:
                left += out[s] - repeats * sizes[s]
                out[s] = repeats * sizes[s]
                open_.discard(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, size int")


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs.drop("size")).collect()
    assert len(rows) == len(ROWS)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert {r["size"] for r in rows if r["doc_id"] == 302} == {len(re.findall(r"[^\x20\x09-\x0D]+", "a b c"))}
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_equals_sql(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.drop("size").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in mixing.mix(docs).collect())


def test_hash(spark):
    row = spark.range(5, 6).select(mixing.hash_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"))).first()
    assert row[0] == int(hashlib.md5(b"5").hexdigest()[:15], 16)


def test_mixed_rows(spark, docs):
    rows = mixing.mixed_rows(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "size"}
    per = {r["doc_id"]: r for r in mixing.mix(docs.drop("size")).collect()}
    counts = {}
    for r in rows:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    for doc_id, r in per.items():
        if doc_id not in (303,) and r["size"]:
            assert abs(counts.get(doc_id, 0) - r["taken"] / r["size"]) <= 0.5


def test_empty(spark, docs):
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_rows(docs.limit(0)).collect() == []

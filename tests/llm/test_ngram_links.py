import random

import pytest
from test_ngram_join import EDGE, brute, brute_set, corpus

from flowlake.llm import ngram_join as nj
from flowlake.llm import queries


def brute_links(rows):
    sets = [brute_set(t) for _, t in rows]

    def linked(a, b):
        x = len(a & b)
        return bool(a and b) and 100 * x >= 75 * (len(a) + len(b) - x)

    return sorted(str((d, len(s), sum(linked(s, sets[j]) for j in range(len(rows)) if j != i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = nj.jaccard_links(df).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["n_links"])) for r in got) == brute_links(rows)
    assert sorted(str(tuple(r)[:3]) for r in got) == brute(rows)


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(120)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_against_brute_force(spark):
    check(spark, corpus(1) + EDGE)


@pytest.mark.parametrize("block", [4, 40])
def test_large_components_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_ITEMS", block * nj.LEAST_ITEMS)
    check(spark, near_copies(150) + [(i + 1000, t) for i, t in corpus(3, 8)] + EDGE)


def test_query_counts_links(spark, tmp_path):
    df = spark.createDataFrame(near_copies(12), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_ngram_join(spark, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["n_links"])) for r in got) == brute_links(near_copies(12))
    empty = nj.jaccard_links(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "n_links"]

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowlake.llm import quality as ql

SF = "/root/testdata/sf0.1"


def test_features_of_small_texts():
    texts = ["Aa bb bb\nbb cc! 12", None, "", " \n ", "| x |", "é", "One line\nOne line\nOne line", "a %%% b"]
    x = ql.features(pa.array(texts))
    at = {f: x[:, i] for i, f in enumerate(ql.FEATURES)}
    assert np.isnan(x[1:4]).all()
    assert at["log_words"][0] == pytest.approx(np.log2(7)) and at["word_bytes"][0] == pytest.approx(13 / 6)
    assert at["distinct_words"][0] == pytest.approx(4 / 6) and at["same_as_last"][0] == pytest.approx(2 / 6) and at["top_word"][0] == pytest.approx(3 / 6)
    assert at["distinct_pairs"][0] == pytest.approx(4 / 5) and at["sentence_ends"][0] == pytest.approx(1 / 6) and at["words_per_line"][0] == 3
    assert at["digits"][0] == pytest.approx(2 / 13) and at["capitals"][0] == pytest.approx(1 / 10)
    assert at["lone_symbols"][4] == pytest.approx(2 / 3) and at["symbols"][4] == pytest.approx(2 / 3) and at["word_bytes"][5] == 2
    assert at["repeated_lines"][6] == pytest.approx(2 / 3) and at["capital_words"][6] == pytest.approx(0.5)
    assert at["doubled_symbols"][7] == pytest.approx(2 / 5) and at["same_as_last"][5] == 0 and np.isnan(at["distinct_pairs"][5])
    apart = np.concatenate([ql.features(pa.array([t])) for t in texts])
    assert np.array_equal(x, apart, equal_nan=True)  # a text's features don't depend on its neighbours
    assert ql.features(pa.array([], pa.string())).shape == (0, len(ql.FEATURES))


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((6000, len(ql.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = ql.fit(x, y, np.ones(len(y)))
    assert next(iter(model.planes)) == (2, 5)
    fresh = rng.random((3000, len(ql.FEATURES)))
    right = (model.score(fresh) > 0.5) == ((fresh[:, 2] > 0.5) ^ (fresh[:, 5] > 0.5))
    assert right.mean() > 0.95
    one = ql.Model(model.start, model.edges, model.lines)
    assert ((one.score(fresh) > 0.5) == ((fresh[:, 2] > 0.5) ^ (fresh[:, 5] > 0.5))).mean() < 0.65


def test_a_line_is_learned_and_missing_values_too():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(ql.FEATURES)))
    x[::4, 3] = np.nan
    y = np.where(np.isnan(x[:, 3]), 1, x[:, 3] > 0.7).astype(float)
    model = ql.fit(x, y, np.ones(len(y)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_no_labels_one_class_or_few_rows():
    n = len(ql.FEATURES)
    assert (ql.fit(np.empty((0, n)), np.empty(0), np.empty(0)).score(np.full((3, n), np.nan)) == 0.5).all()
    assert (ql.fit(np.ones((5, n)), np.ones(5), np.ones(5)).score(np.zeros((2, n))) > 0.9).all()
    s = ql.fit(np.arange(2 * n).reshape(2, n).astype(float), np.array([0.0, 1.0]), np.ones(2)).score(np.zeros((2, n)))
    assert ((0 <= s) & (s <= 1)).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = ql.quality(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 800
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    good, bad = (np.array([r["score"] for r in held if truth[r["doc_id"]] == q]) for q in (1, 0))
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert right > 0.93 and auc > 0.9, (right, auc)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_learns_nothing_from_held_out_rows_and_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(ql, "SAMPLE_ROWS", 50)
    rng = random.Random(3)
    out = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1]
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(1 + i % 30)), "q") for i in range(3000)]
    rows += [(2, " ".join(word() for _ in range(1 + i % 30)), "q") for i in range(9000)] + [(4, "same text", "q")] * 3000 + [(None, "x", "q"), (0, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)] + [(2, 1, 0), (4, None, 0), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    found = ql.measured(docs)
    sample = ql.training_rows(found, labels).collect()
    assert 40 < len(sample) <= 200
    only = labels.where(labels["doc_id"].isin(out))
    assert ql.training_rows(found, only).collect() == []
    assert {r["score"] for r in ql.quality(docs.limit(50), only).collect()} == {0.5}


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 0.1)], "doc_id int, text string, x int, score double")
    labels = spark.createDataFrame([], "doc_id int, quality int")
    assert ql.quality(docs.limit(0), labels).collect() == []
    assert [tuple(r) for r in ql.quality(docs, labels).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, 0.5, 1)]

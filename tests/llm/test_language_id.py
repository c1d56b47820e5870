import random
import zlib

import numpy as np
import pytest

from flowlake.llm import language_id as li

WORDS = {"en": "the of and to in is was for with that from this have not are".split(), "de": "der die das und ist nicht ein eine mit für auf von zu sich über".split(),
         "fr": "le la les des une est pas que qui dans pour sur avec être où".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + rng.choice([".", "!!", " 12"])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de", "fr"])
        out.append((i, text(rng, lang, rng.randint(5, 80)), lang, "x"))
    return out + [(500, None, "en", "x"), (501, "", "de", "x"), (502, "12 ... !!", "fr", "x"), (503, text(rng, "de", 3000), None, "x"), (None, text(rng, "fr", 30), "fr", "x"), (3, text(rng, "en", 30), "en", "x"), (504, "漢字漢字", None, "x")]


def test_identify(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = li.identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 500}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (500, 501, 502, 503)] == ["und", "und", "und", "de"]
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    kept = li.keep_known(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"]: r for r in kept.collect()}
    assert not {500, 501, 502, 504} & set(ids) and ids[503]["lang"] == "de" and set(truth) <= set(ids)


def test_learns_nothing_from_held_out_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    assert set(li.training_texts(df)) == {"en", "de", "fr"}
    only = df.where(li.held_out(li.F.col("doc_id")))
    assert li.training_texts(only) == {}
    assert {r["lang_pred"] for r in li.identify(only).collect()} == {"und"}


def test_empty(spark, rows):
    df = spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, score string").limit(0)
    assert li.identify(df).collect() == [] and li.keep_known(df).collect() == []


def test_phrases_against_plain_parsing():
    train = ["the cat sat on the mat and the dog", "der hund und die katze saß"]
    classes = li.byte_classes(train)
    model = li.Model({"a": [train[0]], "b": [train[1]]}, classes)
    probe = "the hund sat, ß zz the the mat " * 40

    def plain(t, own):
        s, corpus = bytes(li.symbols(t, classes)), bytes(np.append(li.symbols(own, classes), np.uint8(li.SPACE)))
        n = i = 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i : i + k] in corpus:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    rates = model.bits_per_symbol([probe, None])
    size = len(li.symbols(probe, classes))
    for k, own in enumerate(train):
        assert round(rates[0, k] * size / model.bits[k]) == plain(probe, own)
    assert (rates[1] == 0).all()


def test_phrases_go_on_across_blocks_and_flushes(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)
    monkeypatch.setattr(li, "MARK", 4)
    monkeypatch.setattr(li, "STEP_BLOCKS", 5)
    rng = random.Random(5)
    train = {"a": ["".join(rng.choice("abc") for _ in range(300))], "b": ["ab" * 100, "cab" * 50]}
    classes = li.byte_classes([t for x in train.values() for t in x])
    model = li.Model(train, classes)
    probes = ["".join(rng.choice("abcab dß") for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 41, 500]))) for _ in range(60)] + ["ab" * 300, "z" * 33]
    rates = model.bits_per_symbol(probes)
    for t, r in zip(probes, rates):
        if not li.letters(t):
            assert (r == 0).all()
            continue
        s = bytes(li.symbols(t, classes))
        for k, lang in enumerate(model.langs):
            corpus = b"".join(bytes(np.append(li.symbols(x, classes), np.uint8(li.SPACE))) for x in train[lang])
            n = i = 0
            while i < len(s):
                j = i + 1
                while j < len(s) and s[i : j + 1] in corpus:
                    j += 1
                i, n = j, n + 1
            assert round(r[k] * len(s) / model.bits[k]) == n


def test_texts_are_learned_whole(spark, monkeypatch):
    monkeypatch.setattr(li, "TRAIN_SYMBOLS", 60)
    rows = [(i, w * n, lang) for i, (w, n, lang) in enumerate([("ab ", 10, "x"), ("cd ", 10, "x"), ("ef ", 10, "x"), ("gh ", 100, "y"), ("ij ", 50, "y")] * 9)]
    got = li.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"x", "y"} and got["y"] == ["ij " * 50] and 1 <= len(got["x"]) <= 2 and all(len(t) == 30 for t in got["x"])


def test_clashing_columns(spark, rows):
    names = ["doc_id", "text", "lang", "_lang", "_bits", "c0", "a.b", "_more"]
    df = spark.createDataFrame([(*r[:3], "q", 1.0, "z", "dot", r[0]) for r in rows], "doc_id long, text string, lang string, _lang string, _bits double, c0 string, `a.b` string, _more long")
    kept = li.keep_known(df)
    assert kept.columns == names
    got = kept.collect()
    assert len(got) > 200 and {tuple(r)[3:7] for r in got} == {("q", 1.0, "z", "dot")} and all(r["_more"] == r["doc_id"] for r in got)


def test_only_letters_are_letters(spark):
    texts = ["² ½ ①", "Ⅷ", "٣", "_", "ª", "漢", "ǅ", "12 é", "\u0301"]
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] for i in range(len(texts))] == ["und"] * 4 + ["en"] * 4 + ["und"]
    assert [li.letters(t) for t in texts] == [any(c.isalpha() for c in t) for t in texts]


def test_one_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_ROWS", 20)
    doc = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5)
    many = spark.range(20_000).selectExpr(f"CAST({doc} AS BIGINT) AS doc_id", "concat('text number ', id) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    same = spark.range(20_000).selectExpr(f"CAST({doc} AS BIGINT) AS doc_id", "'encore' AS text", "'fr' AS lang")
    seen = []
    monkeypatch.setattr(li, "letters", lambda t: seen.append(t) or bool(t))
    got = li.training_texts(many.union(same))
    assert got["fr"] == ["encore"] and set(got) == {"en", "de", "fr"} and len(got["en"]) > 5
    assert len(seen) <= 3 * 20

import random
import re

import pytest

from flowlake.llm import licenses

MIT = licenses.TEMPLATES["mit-text"].split()


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["labels"], r["score"]) for r in sorted(licenses.license_scan(df).collect(), key=lambda r: r["doc_id"])]


def test_words_put_in_or_left_out_in_the_middle(spark):
    at = 11  # "to any person | obtaining a copy"
    texts = [" ".join(MIT[:at] + ["zz"] * k + MIT[at:]) for k in (0, 1, 2)] + [" ".join(MIT[:at] + MIT[at + k:]) for k in (1, 2)]
    texts.append(" ".join(MIT[:at] + "v w x y z".split() + MIT[at + 3:]))  # three words became five
    pairs = len(MIT) - 1
    want = [1.0, (pairs - 1) / pairs, (pairs - 1) / pairs, (pairs - 2) / pairs, (pairs - 3) / pairs, (pairs - 4) / pairs]
    got = scan(spark, texts)
    assert [s for _, s in got] == pytest.approx([x if x >= licenses.COVERAGE else 0 for x in want])
    assert [x for x, _ in got] == ["mit-text" if x >= licenses.COVERAGE else "" for x in want]


def test_a_stray_hit_between_two_halves(spark):
    # "permission is" is the template's first pair and lies on a diagonal of its own
    text = " ".join(MIT[:11] + ["permission", "is"] + MIT[11:])
    assert scan(spark, [text]) == [("mit-text", (len(MIT) - 2) / (len(MIT) - 1))]


def test_repeated_pairs_count_once(spark):
    got = scan(spark, ["the mit the mit the mit the mit", "released under the mit license", "licensed under cc by nc 4 0" + " 4 0" * 20])
    assert got == [("", 0.0), ("mit", 1.0), ("cc-by,cc-by-nc", 1.0)]


def brute(text, templates):
    """Labels and best score of the spans, from the words themselves."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for label, phrase in templates:
        t = phrase.split()
        k = licenses.K_LONG if len(t) >= licenses.LONG else licenses.K_SHORT
        grams = len(t) - k + 1
        cells = [(i - j, i, j) for j in range(grams) for i in range(len(words) - k + 1) if words[i : i + k] == t[j : j + k]]
        islands = []
        for d, i, j in sorted(cells):
            if not islands or d - islands[-1][-1][0] > licenses.DRIFT:
                islands.append([])
            islands[-1].append((d, i, j))
        for cell in islands:
            most = 2 * grams + k
            groups = [cell]
            if max(i for _, i, _ in cell) + k - min(i for _, i, _ in cell) > most:
                groups = [[c for c in cell if c[0] == d] for d in {c[0] for c in cell}]
            for g in groups:
                score = len({j for _, _, j in g}) / grams
                if score >= licenses.COVERAGE and max(i for _, i, _ in g) + k - min(i for _, i, _ in g) <= most:
                    labels.add(label)
                    best = max(best, min(1.0, score))
    return labels, best


@pytest.mark.parametrize("long", [32, 12])
def test_spans_labels_and_score_against_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(licenses, "LONG", long)
    rng = random.Random(3)
    own = [f"w{k}" for k in range(12)]
    templates = [*licenses.TEMPLATES.items(), *((f"own-{k % 3}", " ".join(rng.choice(own) for _ in range(rng.choice([2, 5, 14, 40])))) for k in range(8))]
    texts = [None, "", "w1"]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(templates)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 2])] = [rng.choice(own)] * rng.choice([0, 1, 2])
                t = t or ["x"]
            w += t + [rng.choice(["and", "w1", "licensed"])] * rng.choice([0, 1, 3])
        texts.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    table = spark.createDataFrame(templates + [(None, "cc by"), ("none", None), ("one", "word")], "label string, text string")
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, h int")
    got = {r["doc_id"]: r for r in licenses.license_scan(df, table).collect()}
    found = 0
    for i, t in enumerate(texts):
        labels, best = brute(t, templates)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base
        assert got[i]["score"] == pytest.approx(1.0 if base else best)
        found += bool(labels)
    assert found > 60

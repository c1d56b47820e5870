import random
import re

import numpy as np

from flowlake.llm import ngram_join as nj


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                x = len(sets[i] & sets[j])
                if 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x):
                    root[find(i)] = find(j)
    small = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        small[r] = min((x for x in (small.get(r), d) if x is not None), default=None)
    return sorted(str((d, len(s), small[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n_base=25, copies=6):
    """Bases, edited copies near the threshold, shared passages, copies of very different length."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([3, 4, 5, 6, 20, 80, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [word()], [word(), word()]])
            if rng.random() < 0.2:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            rows.append(rng.choice([" ", "  ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


EDGE = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A B"), (1005, "a b c"), (None, "q w e r t y u"), (1006, "q w e r t y u"), (1006, "q w e r t y u"), (None, "alone here")]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").repartition(4)
    return sorted(str(tuple(r)) for r in nj.jaccard_components(df).collect())


def test_components_against_brute_force(spark):
    rows = corpus(1) + EDGE
    assert run(spark, rows) == brute(rows)


def test_without_pivots_the_index_alone_is_exact(spark, monkeypatch):
    rows = corpus(2, 40, 5)
    monkeypatch.setattr(nj, "pivots", lambda nodes: nodes.select(nj.F.col("fp").alias("a"), nj.F.col("fp").alias("b")).limit(0))
    assert run(spark, rows) == brute(rows)


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_neighbourhoods_of_small_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ITEMS", 8 * nj.LEAST_ITEMS)
    rng = random.Random(6)
    rows = []
    for i in range(60):
        w = "a b c d e".split() + [f"x{rng.randrange(3)}" for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_components(df).collect() == []
    assert nj.one_per_component(df).collect() == []


def test_one_per_component(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (5, None, "z"), (None, "k", "n")], "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in nj.one_per_component(df).collect())))
    assert got == sorted(map(str, [(2, "A b c d e f", "y"), (5, None, "z"), (None, "k", "n")]))


def test_which_row_of_a_component_stays(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [
        (7, near, "p"), (7, "other words stand here all alone", "q"), (8, near + " u", "r"), (None, near, "s"), (None, near, "s"), (None, "lone one two three four five", "t"),
        (9, "x y z x y z", "v"), (9, "x y z x y z", "v"), (10, "", "w"), (10, "", "w"), (None, None, "n"),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, key int, `nth.x` string")
    kept = nj.one_per_component(df)
    assert kept.columns == df.columns
    got = sorted(str(tuple(r)[:3]) for r in kept.collect())
    assert got == sorted(map(str, [rows[0], rows[1], rows[5], rows[6], rows[8], rows[9], rows[10]]))


def test_hot_sets_and_parts_are_split(spark, monkeypatch):
    monkeypatch.setattr(nj, "MEET", 2)
    monkeypatch.setattr(nj, "PART_ENTRIES", 40)
    rng = random.Random(8)
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    rows = corpus(7, 15, 4)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(99)}"
        rows.append((5000 + i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_sets_that_share_a_fingerprint_go_by_their_other_bits(spark, monkeypatch):
    names = nj._names

    def all_shared(sets):
        fps = frozenset(r["fp"] for r in sets.where("fp is not null").select("fp").distinct().collect())
        assert names(sets)[1] == frozenset()
        return sets.withColumn("fp", nj.F.when(nj.F.col("fp").isNotNull(), nj.F.col("other"))), fps

    monkeypatch.setattr(nj, "_names", all_shared)
    rows = corpus(9, 12, 4) + EDGE
    assert run(spark, rows) == brute(rows)


def test_strangers_of_one_fingerprint_are_found(spark):
    sets = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 12, 7), (2, 12, 7), (None, None, 0)], "fp long, other long, n long")
    named, shared = nj._names(sets)
    assert shared == {1} and sorted(str(r["fp"]) for r in named.collect()) == sorted(map(str, [10, 11, 2, 2, None]))


def test_long_texts_are_hashed_whole(monkeypatch):
    text = ("wörd " * 50 + "x" * 300 + " tail\n" + "abc def ghi ").encode() * 3
    b = np.frombuffer(text, np.uint8)
    whole = nj.word_hashes(b)
    monkeypatch.setattr(nj, "SEGMENT", 512)
    assert (nj.word_hashes(b) == whole).all()
    monkeypatch.setattr(nj, "SEGMENT", 64)
    assert len(nj.word_hashes(b)) == len(whole)

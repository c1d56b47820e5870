import hashlib
import random
import zlib

import numpy as np
import pytest

from flowlake.llm import periodic_runs as pr


def brute_runs(words):
    """Every maximal stretch with a smallest period, by trying all periods."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                part = words[i : j + q]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def tangled(rng):
    """Words in which runs overlap, nest and touch."""
    out = []
    for _ in range(rng.randint(1, 6)):
        part = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13]))]
        if rng.random() < 0.4:
            part = part * rng.randint(2, 5) + [rng.choice("abcd")]
        out += (part * rng.randint(1, 9))[: rng.randint(1, 120)]
    return out


@pytest.mark.parametrize("at_once, largest", [(1 << 19, 1 << 24), (64, 1 << 24), (1 << 19, 4)])
def test_runs_against_all_periods(monkeypatch, at_once, largest):
    monkeypatch.setattr(pr, "AT_ONCE", at_once)
    monkeypatch.setattr(pr, "LARGEST", largest)
    rng = random.Random(at_once + largest)
    for _ in range(150):
        words = tangled(rng)
        codes = np.array([1000, *[ord(w) for w in words], 1001])
        got = sorted((s - 1, e - s, q) for s, e, q in zip(*(x.tolist() for x in pr.find_runs(codes, len(words)))))
        assert got == sorted(brute_runs(words)), words


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, pr.PRIME, (3, 32)).astype(np.uint64) for _ in range(2))
    got = pr.inverse(pr.transform(a) * pr.transform(b) % np.uint64(pr.PRIME))
    for r in range(3):
        want = [sum(int(a[r, i]) * int(b[r, (k - i) % 32]) for i in range(32)) % pr.PRIME for k in range(32)]
        assert got[r].tolist() == want


def test_whole_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(tangled(rng)) if rng.random() < 0.8 else "\t\n ".join(rng.choice(["x", "ü", "Ab", "\x00", " "]) for _ in range(40))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "w " * 5), (404, "w " * 6), (405, "a b " * 3), (406, "a b " * 4), (7, rows[7][1]), (7, "other"), (None, "a " * 50)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_runs int, start string")
    for plant in (False, True):
        got = sorted(map(tuple, pr.runs(df, plant).collect()), key=repr)
        assert got == sorted((brute(i, t, plant) for i, t in rows), key=repr)


def test_long_texts(spark):
    rng = random.Random(2)
    prose = [f"w{rng.randint(0, 400)}" for _ in range(9000)]
    long_ = prose[:2000] + prose[2000:4300] * 4 + ["end"] + ["a", "b"] * 30_000 + prose[:50]
    got = pr.runs(spark.createDataFrame([(1, " ".join(long_)), (2, " ".join(["a"] * 300_000))], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert tuple(by[2])[1:6] == (1, 0, 300_000, 1, 300_000_000)
    assert tuple(by[1])[1:6] == (2, 11_201, 60_000, 2, 30_000_000)
    assert by[1]["collapsed_sha256"] == hashlib.sha256(" ".join(long_[:4300] + ["end", "a", "b"] + prose[:50]).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    got = pr.runs(df)
    assert got.collect() == [] and dict(got.dtypes)["doc_id"] == "int"

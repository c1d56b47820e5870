import numpy as np
import pytest

from flowlake.llm import embedding_dedup as ed


def brute(rows, t=0.93):
    def ok(e, label, vec_id):
        return label is not None and vec_id is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)

    n = len(rows)
    good = [ok(e, lab, v) for v, e, lab in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    small = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            small[find(i)] = min(small.get(find(i), v), v)
    return sorted(str((v, links[i], small.get(find(i)), v is not None and small.get(find(i)) == v)) for i, (v, _, _) in enumerate(rows))


def vectors(seed, n, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 6), dim))
    x = (centers[rng.integers(0, len(centers), n)] + rng.normal(scale=0.28, size=(n, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]
    for k in range(0, n // 8):
        rows.append((n + k, rows[k][1], rows[k][2]))
    return rows


EDGE = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] + [1.0] * 7, 1), (905, [float("inf")] + [1.0] * 7, 1),
        (906, [1.0] * 8, None), (907, [1.0] * 8, None), (None, [1.0] * 8, 1), (908, [1.0] * 4, 1), (909, [2.0] * 4, 1), (910, [1e-30] * 4, 1), (911, [1e30] * 4, 1), (912, [1.0] * 8, 0), (912, [1.0] * 8, 0)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
    return sorted(str(tuple(r)) for r in ed.near_duplicates(df).collect())


def test_one_cell(spark):
    rows = vectors(1, 200) + EDGE
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("side", [8192, 9])
def test_many_cells_and_blocks(spark, monkeypatch, side):
    monkeypatch.setattr(ed, "CELL", 20)
    monkeypatch.setattr(ed, "SIDE", side)
    rows = vectors(2, 260, dim=5, labels=2) + EDGE
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    one = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in ed.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_cells_never_lose_a_neighbour():
    rng = np.random.default_rng(0)
    x = ed.unit_rows(rng.normal(size=(400, 3)))
    pivots, r = x[:12], 0.37
    home, near = ed.cells_of(x, pivots, r)
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for i, j in zip(*np.nonzero(d <= r)):
        lo, hi = sorted((home[i], home[j]))
        assert lo == hi or near[i if home[i] == lo else j, hi]

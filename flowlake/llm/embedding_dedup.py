"""Embedding near-dedup: an exact metric range join over pivot cells.

Unit vectors with cosine >= t lie at most r = sqrt(2 - 2t) apart. Pivots of a label partition its
vectors; a vector is copied into every later cell that the triangle inequality can't exclude, and
the cells are joined independently, in tasks of bounded size. Tasks emit each vector's number of
links and a spanning forest of what they linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table

#: Vectors that a pivot stands for, pivots of a label, pivots in all (they are broadcast: at most 100,000 vectors).
CELL, LABEL_PIVOTS, ALL_PIVOTS = 4096, 32, 100_000
#: Rows of a side of one join task.
SIDE = 8192
ROWS = 256


def usable() -> F.Column:
    """True for rows that can link: a label, a vec_id, and a finite non-zero vector without nulls; never null."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & some, F.lit(False))


def pivot_table(reps: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots by (label, dimension) of the labels that need more than one cell: a hash sample, bounded by ALL_PIVOTS."""
    counts = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    want = F.least(F.lit(float(LABEL_PIVOTS)), F.ceil(F.col("n") / CELL).cast("double"))
    total = counts.agg(F.sum(want)).first()[0] or 0.0
    shrink = min(1.0, ALL_PIVOTS / total) if total else 1.0
    counts = counts.withColumn("share", want * shrink / F.col("n"))
    unit = F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = reps.join(counts, ["label", "dim"]).where(unit < F.col("share")).select("label", "dim", "rep", "embedding").collect() if total else []
    out: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["rep"]):
        out.setdefault((r["label"], r["dim"]), []).append(unit_rows(np.array([r["embedding"]], np.float64))[0])
    return {k: np.array(v) for k, v in out.items()}


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that very large and very small vectors stay exact."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the later cells it must be copied into.

    If w is at home in j and |v - w| <= r, then d(v, p_j) <= d(v, p_home) + 2r, and v is within r of
    the hyperplane between the two pivots: (d(v, p_j)^2 - d(v, p_home)^2) / (2 d(p_home, p_j)) <= r.
    """
    d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
    home = d.argmin(1)
    own = d[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    slack = 1e-7
    near = (d - own <= 2 * radius + slack) & (d * d - own * own <= 2 * apart * radius + slack)
    near &= np.arange(len(pivots))[None, :] > home[:, None]
    return home, near


def spread(reps: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """``(label, dim, cell, home, rep, n, embedding)``: each vector in its cell, and copied into later ones."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), g in b.groupby(["label", "dim"], sort=False):
                p = sent.value.get((label, dim))
                if p is None:
                    yield g.assign(cell=np.int32(0), home=True)
                    continue
                home, near = cells_of(unit_rows(np.array(g["embedding"].tolist(), np.float64)), p, radius)
                yield g.assign(cell=home.astype(np.int32), home=True)
                row, cell = np.nonzero(near)
                if len(row):
                    yield g.iloc[row].assign(cell=cell.astype(np.int32), home=False)

    schema = f"label {dict(reps.dtypes)['label']}, dim int, rep long, n long, embedding {dict(reps.dtypes)['embedding']}, cell int, home boolean"
    return reps.select("label", "dim", "rep", "n", "embedding").mapInPandas(run, schema)


def tasks_of(spreaded: DataFrame) -> DataFrame:
    """Adds the join tasks of each row: home rows in blocks of SIDE on the left, all rows on the right.

    A cell with few rows is one task; a large one becomes a grid of blocks. Home blocks meet each
    other once (left block <= right block). Blocks come from hashes, sized by the cell's counts.
    """
    counts = spreaded.groupBy("label", "dim", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("home") / SIDE)).cast("int").alias("nh"),
        F.ceil(F.count_if(~F.col("home")) / SIDE).cast("int").alias("nc"),
    )
    s = spreaded.join(counts, ["label", "dim", "cell"])
    block = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("nh"))).otherwise(F.col("nh") + F.pmod(F.xxhash64("rep"), F.greatest("nc", F.lit(1)))).cast("int")
    s = s.withColumn("block", block)
    right = F.transform(F.sequence(F.lit(0), F.least("block", F.col("nh") - 1)), lambda i: F.struct(i.alias("l"), F.col("block").alias("r")))
    left = F.when(
        F.col("home") & (F.col("block") + 1 <= F.col("nh") + F.col("nc") - 1),
        F.transform(F.sequence(F.col("block") + 1, F.col("nh") + F.col("nc") - 1), lambda i: F.struct(F.col("block").alias("l"), i.alias("r"))),
    ).otherwise(F.array().cast("array<struct<l:int,r:int>>"))
    return s.withColumn("task", F.explode(F.concat(right, left)))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of cosine >= threshold between unit rows; results within rounding of it are computed again, singly."""
    c = x @ y.T
    out = c >= threshold
    for i, j in zip(*np.nonzero(np.abs(c - threshold) < 1e-12)):
        out[i, j] = float(np.dot(x[i], y[j]) / np.sqrt(np.dot(x[i], x[i]) * np.dot(y[j], y[j]))) >= threshold
    return out


def join_task(left: np.ndarray, right: np.ndarray, same: bool, wl: np.ndarray, wr: np.ndarray, threshold: float):
    """Links of each row (weighted by copies) and the edges of a spanning forest, as positions in left ++ right.

    ``same``: left is right; a row doesn't link with itself.
    """
    nl, nr = len(left), len(right)
    base = 0 if same else nl
    label = np.arange(base + nr)
    links_l, links_r = np.zeros(nl, np.int64), np.zeros(nr, np.int64)
    edges: list[tuple[int, int]] = []
    for at in range(0, nl, ROWS):
        m = linked(left[at : at + ROWS], right, threshold)
        if same:
            m[np.arange(len(m)), np.arange(at, at + len(m))] = False
        links_l[at : at + ROWS] = m @ wr
        if not same:
            links_r += wl[at : at + ROWS] @ m
        for i in np.flatnonzero(m.any(1)):
            hit = np.flatnonzero(m[i]) + base
            roots = np.unique(np.append(label[hit], label[at + i]))
            if len(roots) > 1:
                edges += [(int(roots[0]), int(q)) for q in roots[1:]]
                label[np.isin(label, roots[1:])] = roots[0]
    return links_l, links_r, edges


def cell_links(tasks: DataFrame, threshold: float) -> DataFrame:
    """``(a long, b long, links long)``: rows with b are edges, rows with links are counts for a."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        l, r = key[3], key[4]
        block = g["block"].to_numpy()
        left, right = g[block == l], g[block == r]
        same = l == r
        x = unit_rows(np.array(left["embedding"].tolist(), np.float64)) if len(left) else np.zeros((0, 1))
        y = x if same else (unit_rows(np.array(right["embedding"].tolist(), np.float64)) if len(right) else np.zeros((0, 1)))
        if not len(x) or not len(y):
            return pd.DataFrame({c: pd.array([], "Int64") for c in ("a", "b", "links")})
        wl, wr = left["n"].to_numpy(), right["n"].to_numpy()
        links_l, links_r, edges = join_task(x, y, same, wl, wr, threshold)
        ids = left["rep"].to_numpy() if same else np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        links = links_l if same else np.concatenate([links_l, links_r])
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        n, k = len(some), len(e)
        return pd.DataFrame({
            "a": pd.array(np.concatenate([ids[some], ids[e[:, 0]]]), "Int64"),
            "b": pd.array([None] * n + ids[e[:, 1]].tolist(), "Int64"),
            "links": pd.array(links[some].tolist() + [None] * k, "Int64"),
        })

    keys = ["label", "dim", "cell", F.col("task.l"), F.col("task.r")]
    return tasks.groupBy(*keys).applyInPandas(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``.

    vec_id, n_links (other vectors of the same label with cosine >= threshold, in double
    precision), component_id (smallest vec_id reachable by links), kept (vec_id = component_id).
    Vectors that are null, empty, zero or hold null or non-finite parts, and rows without a label
    or a vec_id, link with nothing; vectors of different length don't link. Equal vectors of a label
    are compared once and counted as often as they stand. An empty table gives no rows; other
    columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = v.where(usable()).withColumn("dim", F.size("embedding")).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    same = ["label", "dim", "k1", "k2"]
    reps, _ = table(
        good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by("embedding", "vec_id").alias("embedding")), "vectors"
    )
    radius = float(np.sqrt(2 - 2 * threshold))
    spreaded, _ = table(spread(reps, pivot_table(reps), radius), "cells")
    found, _ = table(cell_links(tasks_of(spreaded), threshold), "links")
    counts = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    info = reps.select(*same, "rep", "n").join(counts, "rep", "left").join(comps, "rep", "left").select(
        *same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    rows = good.select("vec_id", *same).join(info, same).select("vec_id", "n_links", "component_id")
    rest = v.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Quality of documents by a generalised additive model with pairwise interactions.

A text becomes a few shares and means. Each is cut into bins; boosting visits the features in turn,
again and again, and each time adds a shallow tree over that feature's bins to its lookup table.
Pairs whose joint trees explain most of what is left get tables of their own in the same way. A
document's score is the sum of one entry per table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import slabs
from .words import SPACED, as_array, bytes_of, cut

#: The bounded training sample: labelled rows of each class (expected, at most twice as many); equal rows are one weighted row.
SAMPLE_ROWS = 16_384
#: Bytes of text whose features are computed at once.
SLAB = 2 << 20
#: Bins of a feature beside the one for texts that lack it; tables of pairs; rounds of boosting and how far each goes.
BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 160, 60, 0.15
#: Rounds without gain on the rows kept aside (one in eight) after which boosting ends.
PATIENCE = 25

FEATURES = (
    "log_words", "word_bytes", "capitals", "symbols", "digits", "distinct_words", "same_as_last", "top_word", "distinct_pairs",
    "lone_symbols", "doubled_symbols", "sentence_ends", "words_per_line", "repeated_lines", "capital_words",
)
_BYTE = np.arange(256)
UPPER, DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
SYMBOL = (_BYTE > 32) & (_BYTE < 127) & ~LETTER & ~DIGIT
ENDS = np.isin(_BYTE, [ord(c) for c in ".!?"])
LINES = _BYTE != 10


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _groups(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each owner has, and how often its most frequent one occurs."""
    different, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(owner):
        pairs, times = np.unique(owner * (int(code.max()) + 1) + code, return_counts=True)
        who = pairs // (int(code.max()) + 1)
        different = np.bincount(who, minlength=n)
        np.maximum.at(most, who, times)
    return different, most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text. Null, empty and blank texts have no shares: NaN."""
    flat, offsets = bytes_of(texts)
    n = len(texts)
    kept, at, counts = cut(flat, offsets, SPACED)
    words, ends = counts.astype(float), np.cumsum(counts)
    bounds = at[np.concatenate(([0], ends))]  # of each text's bytes without white space
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda part, whole: np.where(whole > 0, part / whole, np.nan)
        size = np.diff(bounds).astype(float)
        letters = _sums(LETTER[kept], bounds)
        symbol = SYMBOL[kept]
        doubled = symbol.copy()
        doubled[1:] &= symbol[:-1]
        doubled[:1] = False
        doubled[at[:-1]] = False  # the first byte of a word
        code = np.array(as_array(kept, at).dictionary_encode().indices, np.int64)
        owner = np.repeat(np.arange(n), counts)
        within = np.append(False, owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
        place = np.concatenate(([0], ends))
        same = within & np.append(False, code[1:] == code[:-1]) if len(code) else within
        different, most = _groups(owner, code, n)
        after = np.flatnonzero(within)
        pair = np.unique(code[after - 1] * (int(code.max()) + 1 if len(code) else 1) + code[after], return_inverse=True)[1]
        pairs = _groups(owner[after], pair, n)[0]
        starts, tails = at[:-1], at[1:] - 1
        plain = _sums((LETTER | DIGIT)[kept], at)
        line, line_at, lines = cut(flat, offsets, LINES)
        line_code = np.array(as_array(line, line_at).dictionary_encode().indices, np.int64)
        different_lines = _groups(np.repeat(np.arange(n), lines), line_code, n)[0]
        out = np.stack(
            [
                np.where(words > 0, np.log2(words + 1), np.nan), share(size, words), share(_sums(UPPER[kept], bounds), letters), share(_sums(symbol, bounds), size),
                share(_sums(DIGIT[kept], bounds), size), share(different, words), share(_sums(same, place), words), share(most, words), share(pairs, words - 1),
                share(_sums(plain == 0, place), words), share(_sums(doubled, bounds), size), share(_sums(ENDS[kept[tails]], place), words),
                share(words, np.where(words > 0, lines, 0)), share(lines - different_lines, np.where(words > 0, lines, 0)), share(_sums(UPPER[kept[starts]], place), words),
            ],
            axis=1,
        )
    return out


def _line_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The steps of a shallow tree over ordered bins from sums of gradients and curvatures."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        best = int(np.argmax(gain))
        if gain[best] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[: best + 1] = _line_tree(g[: best + 1], h[: best + 1], depth - 1)
            out[best + 1 :] = _line_tree(g[best + 1 :], h[best + 1 :], depth - 1)
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The steps of a tree that cuts one axis of a plane of bins, then the other in each half, and its gain."""
    best, steps = -1.0, np.full(g.shape, g.sum() / (h.sum() + 1.0))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if min(a.shape) < 2:
            continue
        low_g, low_h = (np.cumsum(np.cumsum(x, 0), 1) for x in (a, b))
        high_g, high_h = low_g[-1:] - low_g, low_h[-1:] - low_h
        cuts, total = [], 0.0
        for gg, hh in ((low_g, low_h), (high_g, high_h)):
            whole_g, whole_h = gg[:-1, -1:], hh[:-1, -1:]
            gain = gg[:-1, :-1] ** 2 / (hh[:-1, :-1] + 1) + (whole_g - gg[:-1, :-1]) ** 2 / (whole_h - hh[:-1, :-1] + 1)
            cuts.append(gain.argmax(1))
            total = total + gain.max(1)
        i = int(np.argmax(total))
        if total[i] > best:
            best, steps = float(total[i]), np.empty(a.shape)
            for rows, c in ((slice(0, i + 1), cuts[0][i]), (slice(i + 1, None), cuts[1][i])):
                for cols in (slice(0, c + 1), slice(c + 1, None)):
                    steps[rows, cols] = a[rows, cols].sum() / (b[rows, cols].sum() + 1)
            steps = steps.T if turned else steps
    return steps, best - g.sum() ** 2 / (h.sum() + 1)


@dataclass
class Model:
    """Bin edges and lookup tables; a constant without labels."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    lines: list[np.ndarray] = field(default_factory=list)
    planes: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers; 0 where a text lacks the feature."""
        cut_ = [np.where(np.isnan(c), 0, np.searchsorted(e, c, "right") + 1) for e, c in zip(self.edges, x.T)]
        return np.stack(cut_) if cut_ else np.zeros((0, len(x)), np.int64)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1] if bins.ndim > 1 else 0, self.start)
        for b, t in zip(bins, self.lines):
            out += t[b]
        for (i, j), t in self.planes.items():
            out += t[bins[i], bins[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the likelier is label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)) if self.edges else np.full(len(x), self.start), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Learns from rows in the order given: every eighth is kept aside and ends the boosting. Without both classes, a constant."""
    model = Model()
    if not len(y):
        return model
    share = float(np.clip(weight @ y / weight.sum(), 1e-3, 1 - 1e-3))
    model.start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    for c in x.T:
        known = c[~np.isnan(c)]
        model.edges.append(np.unique(np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1])) if len(known) else np.empty(0))
    bins = model.bins(x)
    sizes = [len(e) + 2 for e in model.edges]
    model.lines = [np.zeros(s) for s in sizes]
    aside = np.arange(len(y)) % 8 == 7
    if len(np.unique(y[~aside])) < 2 or not aside.any():
        aside = np.zeros(len(y), bool)
    learn = ~aside
    margin = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.where(learn, weight * (y - p), 0), np.where(learn, weight * p * (1 - p), 0)

    def loss() -> float:
        m, yy, ww = margin[aside], y[aside], weight[aside]
        return float(ww @ (np.logaddexp(0, m) - yy * m)) if aside.any() else 0.0

    def boost(rounds: int, step, tables: dict) -> None:
        """Visits all tables in turn, ``rounds`` times; the tables of the best round stay."""
        nonlocal margin
        best, kept, since = loss(), {k: t.copy() for k, t in tables.items()}, 0
        for _ in range(rounds):
            for k in tables:
                change, where = step(k)
                tables[k] += RATE * change
                margin = margin + RATE * change[where]
            if not aside.any():
                kept = {k: t.copy() for k, t in tables.items()}
                continue
            now = loss()
            if now < best - 1e-9:
                best, kept, since = now, {k: t.copy() for k, t in tables.items()}, 0
            elif (since := since + 1) >= PATIENCE:
                break
        for k, t in tables.items():
            t[...] = kept[k]
        margin = model.margin(bins)

    def line(k: int) -> tuple[np.ndarray, tuple]:
        g, h = slopes()
        return _line_tree(np.bincount(bins[k], g, sizes[k]), np.bincount(bins[k], h, sizes[k])), (bins[k],)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(bins[i] * sizes[j] + bins[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    def plane(k: tuple[int, int]) -> tuple[np.ndarray, tuple]:
        g, h = slopes()
        return _plane_tree(sums(*k, g), sums(*k, h))[0], (bins[k[0]], bins[k[1]])

    boost(ROUNDS, line, dict(enumerate(model.lines)))
    g, h = slopes()
    gains = {k: _plane_tree(sums(*k, g), sums(*k, h))[1] for k in combinations(range(len(sizes)), 2)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.planes = {k: np.zeros((sizes[k[0]], sizes[k[1]])) for k in chosen}
    boost(PAIR_ROUNDS, plane, model.planes)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3, is 1. A null doc_id counts as empty text: not held out, and no label is its own."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the features of every whole text of ``docs(doc_id, text)``, as a written table."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in (part for whole in batches for part in slabs(whole, 1, SLAB)):
            x = features(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), lists], names=["doc_id", "x"])
        pa.default_memory_pool().release_unused()

    with small_batches(docs.sparkSession):
        return table(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>"), "features")[0]


def training_rows(found: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample ``(x, y, n)`` of the labelled rows that aren't held out.

    Labels other than 0 and 1, and null ids, teach nothing; a document with several labels teaches each. Distinct
    rows are counted per class, and a threshold on a hash of id and features picks SAMPLE_ROWS of each, as
    expected; equal rows become one with their number, so a repeated id or row can't fill the sample.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id", F.col("quality").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = found.where(~held_out(F.col("doc_id"))).join(lab, "doc_id").withColumn("h", F.xxhash64("doc_id", "x"))
    many = rows.groupBy("y").agg(F.approx_count_distinct("h").alias("many")).collect()
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    limit = F.lit(0.0)
    for r in many:  # two classes at most
        limit = F.when(F.col("y") == r["y"], F.lit(SAMPLE_ROWS / max(r["many"], 1))).otherwise(limit)
    picked = rows.where(share < limit).groupBy("h", "y", "x").agg(F.sum("n").alias("n"))
    return picked.orderBy("h", "y", "x").limit(4 * SAMPLE_ROWS).select("x", "y", "n")


def learn(found: DataFrame, labels: DataFrame) -> Model:
    """The model of a sample whose bound doesn't depend on the tables; numbers, no texts, reach the driver."""
    rows = training_rows(found, labels).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)``, having learned from ``labels(doc_id, quality)``.

    doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on). Null, empty and blank
    texts are scored by what their label is likely to be; without labels all scores are 0.5. Repeated rows
    stay; an empty table gives no rows; other columns, lang and source among them, are ignored.
    """
    found = measured(docs)
    sent = docs.sparkSession.sparkContext.broadcast(learn(found, labels))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            x = np.array(b.column(2).flatten(), float).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sent.value.score(x))], names=["doc_id", "held_out", "score"])

    rows = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x")
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

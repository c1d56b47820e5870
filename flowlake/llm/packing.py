"""Packing documents into fixed windows by non-negative least squares on the length histogram.

Every document is cut into full windows and a remainder. Combinations of up to three remainder
lengths that fill a window exactly are the columns of a non-negative least squares problem whose
right side is the histogram of remainders; its rounded solution says how often each combination
is used. What the rounding leaves is laid end to end, longest first, and cut at the windows' ends.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, small_batches, table
from .tokens import encoder, ids_crc32, slabs, tokenizer_text

WINDOW = 1024
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, part int, place long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths that add up to the window; a row has 0 for no third."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    pairs = pairs[have[pairs[:, 0]] & have[pairs[:, 1]]]
    x, y = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    z = window - x - y
    keep = (x <= y) & (y <= z)
    triples = np.stack([x[keep], y[keep], z[keep]], 1)
    triples = triples[have[triples].all(1)]
    return np.concatenate([pairs, triples]).astype(np.int64)


def least_squares(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, A the sparse matrix of the combinations.

    Accelerated projected gradient; the work is bounded by the window, not by the data.
    """
    n = len(hist)
    scale = max(float(hist.max()), 1.0)
    want = hist / scale
    real = combos > 0
    uses = np.bincount(combos.ravel(), minlength=n)
    uses[0] = 0
    step = 1.0 / (3.0 * max(uses.max(), 1))  # 1 / a bound of A's squared norm (largest row sum times largest column sum)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        made = np.bincount(combos.ravel(), weights=(y[:, None] * real).ravel(), minlength=n)
        gap = made - want
        gap[0] = 0
        new = np.maximum(y - step * gap[combos].sum(1), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(hist: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, from their counts by length (index = length, up to window).

    The rows are sorted by (length, rank): from that rank on, a piece of that length stands in
    sequence ``sequence + rank - from`` at ``offset`` (kind 0), or in the stream of what is left at
    ``sequence * window + offset + (rank - from) * length`` (kind 1). ``total`` is the number of
    sequences, ``last`` what the last one holds.
    """
    left = hist.astype(np.int64).copy()
    rank = np.zeros(window + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(combo: list[int], times: int) -> None:
        nonlocal sequence
        at = 0
        for length in combo:
            rows.append((length, int(rank[length]), sequence, at, 0))
            rank[length] += times
            left[length] -= times
            at += length
        sequence += times

    if left[window]:
        use([window], int(left[window]))
    if left[1:window].any():
        combos = combinations(np.flatnonzero(left[:window])[0 if left[0] == 0 else 1 :], window)
        if len(combos):
            share = left.astype(float)
            share[0] = 0
            x = least_squares(combos, share[: window + 1])
            for rounding in (np.floor, np.ceil):
                times = rounding(x).astype(np.int64)
                for k in np.argsort(-x, kind="stable"):
                    if not times[k]:
                        break
                    combo = [int(c) for c in combos[k] if c]
                    fits = min(int(left[c]) // combo.count(c) for c in combo)
                    if n := min(int(times[k]) if rounding is np.floor else 1, fits):
                        use(combo, n)
    filled = 0
    for length in range(window - 1, 0, -1):  # the rest, longest first
        if left[length]:
            rows.append((length, int(rank[length]), sequence + filled // window, filled % window, 1))
            filled += int(left[length]) * length
    total = sequence + -(-filled // window)
    last = filled % window or window
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "from", "sequence", "offset", "kind"), out.T)) | {"total": np.int64(total), "last": np.int64(last)}


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of every document: full windows and a remainder, numbered by length within each task.

    Remainders keep their ids (as the tokenizer's narrow integers), full windows only their crc.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        enc, part = encoder(spec.value), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in batches:
            for texts in slabs(b):
                ids, tokens = enc.encode_all(texts.column(1), end_id)
                first = np.cumsum(tokens) - tokens
                count = -(-tokens // window)
                doc = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(tokens[doc] - start, window)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                at, stop = ((x * enc.dtype.itemsize).tolist() for x in (first[doc] + start, first[doc] + start + length))
                wide = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(wide[i:j]) for i, j in zip((4 * (first[doc] + start)).tolist(), (4 * (first[doc] + start + length)).tolist())]
                kept = [bytes(raw[i:j]) if n < window else None for i, j, n in zip(at, stop, length.tolist())]
                # numbered by length, in order
                order = np.argsort(length, kind="stable")
                sizes, begin, times = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(begin, times) + np.repeat(seen[sizes], times)
                seen[sizes] += times
                columns = (
                    texts.column(0).take(pa.array(doc)), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(tokens[doc]),
                    pa.array(kept, pa.binary()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth),
                )
                yield pa.record_batch([*columns], names=names)
        pa.default_memory_pool().release_unused()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, PIECES)


def place(pieces: DataFrame, layout: dict[str, np.ndarray], width: int, window: int = WINDOW) -> DataFrame:
    """Sequence and offset of ranked pieces; one that crosses a window's end is cut there."""
    sent = pieces.sparkSession.sparkContext.broadcast(layout)
    base = 1 << 48  # more pieces of one length than that don't exist

    def run(batches):
        p = sent.value
        keys = p["length"] * base + p["from"]
        total, last = int(p["total"]), int(p["last"])
        for b in batches:
            d = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "ids_crc32", "doc_tokens", "rank")}
            length = d["length"].astype(np.int64)
            k = np.searchsorted(keys, length * base + d["rank"], "right") - 1
            nth = d["rank"] - p["from"][k]
            stream = p["sequence"][k] * window + p["offset"][k] + nth * length
            rest = p["kind"][k] == 1
            seq = np.where(rest, stream // window, p["sequence"][k] + nth)
            off = np.where(rest, stream % window, p["offset"][k])
            head = np.minimum(length, window - off)
            crc = d["ids_crc32"].copy()
            crosses = np.flatnonzero(head < length)
            tails = []
            for i in crosses:
                ids = np.frombuffer(b.column("ids")[int(i)].as_py(), f"<u{width}")
                crc[i] = ids_crc32(ids[: head[i]])
                tails.append(ids_crc32(ids[head[i] :]))
            take = np.concatenate([np.arange(len(length)), crosses])
            start = np.concatenate([d["start"], d["start"][crosses] + head[crosses]])
            n = np.concatenate([head, length[crosses] - head[crosses]])
            seq = np.concatenate([seq, seq[crosses] + 1])
            off = np.concatenate([off, np.zeros(len(crosses), np.int64)])
            crc = np.concatenate([crc, np.array(tails, np.int64)])
            power = last & (last - 1) == 0
            to = np.where((seq == total - 1) & power, last, window)
            out = [b.column("doc_id").take(pa.array(take)), start, n, crc, d["doc_tokens"][take], seq, off, to]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out], names=names)

    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank").mapInArrow(run, PACKED)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Packs all ``docs(doc_id, text)`` into sequences of ``window`` tokens; one row per piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and padded_to (what the
    sequence is padded to: the window, but a last sequence that holds a power of two stays so).
    Only the last sequence can have padding. A null text is empty (one piece, the end id), a
    repeated row is packed again, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces, path = table(cut(docs, tokenizer_path, end_id, window), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts, counts_path = table(
        counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts"
    )
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most one row per length of the window
        hist[length] = n
    width = encoder(tokenizer_text(tokenizer_path)).dtype.itemsize
    ranked = pieces.join(counts.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    with small_batches(spark):
        packed = table(place(ranked, plan(hist, window), width, window), "packed")[0]
    delete_path(spark, path)
    delete_path(spark, counts_path)
    return packed

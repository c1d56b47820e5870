"""Exact Jaccard self join of word n-gram sets, by set-relation skipping.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one node.
2. Pivots: sets that share min-hash bands with a smaller set are compared with it. Found links give
   clusters, and every member its differences from its pivot.
3. Index: each set's rarest shingles (the prefix that any partner must meet) become lists. Lists are
   cut into blocks by set size; a set at some position of a list skips the blocks that its
   position and size rule out, and lists whose sets are all of one cluster are skipped whole.
4. Neighbourhoods: sets that share lists with a central set are compared with it; those that don't link
   with it are compared with its other neighbours in blocks. Pairs inside are then known.
5. Answers: candidates of different clusters are decided from their pivots' overlap and the sizes of
   the differences; only the undecided are compared themselves.

6. Link counts: links lie inside components, whose sets are compared in blocks. Pairs of blocks around
   one pivot whose differences from it leave no doubt are counted whole.

Steps 3 to 5 lose no link between clusters, so the components are exact whatever step 2 finds.
The rarity order uses counts of hash buckets over all texts; an inexact count costs time, not links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, delete_path, plain_names, small_batches, table

WORDS = 5
#: Jaccard similarity as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 3, 4

#: Frequency sketch: buckets, and chunks that are summed apart.
BUCKETS, CHUNKS = 1 << 24, 256
#: Min-hash bands that find pivots, and rows of each.
BANDS, BAND_ROWS = 6, 3
#: Shingles of a block of a neighbourhood, what a small set counts as at least, and columns of an incidence matrix.
BLOCK_ITEMS, LEAST_ITEMS, WIDTH = 200_000, 256, 2048
#: Pairs that meet one copy of a set.
MEET = 256
#: Fingerprints that different sets may share.
SHARED = 10_000
#: Filter of wanted sets: bits.
FILTER_BITS = 1 << 24
#: Bytes of text that are hashed at once, index entries that one message or group holds.
SEGMENT, FLUSH, PART_ENTRIES = 1 << 20, 1 << 20, 300_000
#: Set sizes of a block of an index list grow by this factor.
BLOCK_GROWTH = DEN / NUM

_u = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _u(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | _u(1)
_SEEDS = _rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_MULT = 0x9E3779B97F4A7C15 | 3  # odd, 3 modulo 4: powers keep swapped letters apart
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> _u(30))
    x = x * _u(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _u(27))
    x = x * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(SEGMENT + 1, m, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _words(b: np.ndarray) -> np.ndarray:
    """Hashes of the words of a byte segment of at most SEGMENT bytes."""
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[b]] * up[: len(b)])))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all words of a text's bytes; long texts go segment by segment, cut at a space."""
    if len(b) <= SEGMENT:
        return _words(b)
    out, at = [], 0
    while at < len(b):
        end = min(at + SEGMENT, len(b))
        if end < len(b):
            gaps = np.flatnonzero(_SPACE[b[at:end]])
            if not len(gaps):  # one word longer than a segment: hashed by pieces, chained
                stop = at
                while stop < len(b) and len(piece := np.flatnonzero(_SPACE[b[stop : stop + SEGMENT]])) == 0:
                    stop += SEGMENT
                stop = min(len(b), stop + (int(piece[0]) if stop < len(b) else 0))
                h = np.zeros(1, np.uint64)
                for k in range(at, stop, SEGMENT):
                    h = _mix(h * _PLACE[0] + _words(b[k : min(k + SEGMENT, stop)]))
                out.append(h)
                at = stop
                continue
            end = at + int(gaps[-1]) + 1
        out.append(_words(b[at:end]))
        at = end
    return np.concatenate(out)


def shingles(w: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that begins at each word, where one does."""
    n = max(len(w) - WORDS + 1, 0)
    total = w[:n] * _PLACE[0]
    for i in range(1, WORDS):
        total = total + w[i : n + i] * _PLACE[i]
    return _mix(total)


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _of_words(w: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A text's set from its words and its n-grams: the whole sequence where there are fewer words than that."""
    n = len(w)
    if n >= WORDS or not n:
        return _distinct(grams)
    total = np.full(1, n, np.uint64) * _PLACE[WORDS]
    for i in range(n):
        total = total + w[i : i + 1] * _PLACE[i]
    return _mix(total)


def shingle_set(b: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of the whole sequence if it is shorter; none without words."""
    w = word_hashes(b)
    return _of_words(w, shingles(w))


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits that stand for each set, and 64 more that take their place where strangers share the first; signed longs."""
    size = np.array([len(s) for s in sets], np.uint64)
    end = np.cumsum(size).astype(np.int64)
    items, out = np.concatenate(sets), []
    for a, b in ((_PLACE[2], _PLACE[1]), (_PLACE[4], _PLACE[3])):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(items + a))))
        out.append(_mix(size * b + total[end] - total[end - size.astype(np.int64)]).view(np.int64))
    return out[0], _mix(out[0].view(np.uint64) * _PLACE[5] + out[1].view(np.uint64)).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys that sets of high similarity share, most likely: a row of BANDS for each of the non-empty sets."""
    items = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    low = [np.minimum.reduceat(_mix(items ^ seed), at) for seed in _SEEDS]
    keys = []
    for k in range(BANDS):
        key = np.full(len(sets), k, np.uint64)
        for r in range(BAND_ROWS):
            key = _mix(key * _PLACE[0] + low[k * BAND_ROWS + r])
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def _set_groups(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sets of consecutive texts, hashed together while they fit a segment."""
    group: list[np.ndarray] = []
    held = 0

    def together() -> list[np.ndarray]:
        if len(group) == 1:
            return [shingle_set(group[0])]
        gap = np.full(1, 32, np.uint8)
        b = np.concatenate([x for t in group for x in (t, gap)])
        ends = np.cumsum([len(t) + 1 for t in group])
        before = np.concatenate(([True], _SPACE[b[:-1]]))
        start = np.flatnonzero(before & ~_SPACE[b])
        w = _words(b)
        cuts = np.concatenate(([0], np.searchsorted(start, ends)))
        grams = shingles(w)
        return [_of_words(w[i:j], grams[i : max(i, j - WORDS + 1)]) for i, j in zip(cuts[:-1], cuts[1:])]

    for t in texts:
        if group and held + len(t) + 1 > SEGMENT:
            yield together()
            group, held = [], 0
        group.append(t)
        held += len(t) + 1
    if group:
        yield together()


def prefix_length(n: int) -> int:
    """Rarest shingles of a set of n, of which every partner has one."""
    return n - -(-NUM * n // DEN) + 1


def similar(overlap: Column, a: Column, b: Column) -> Column:
    return overlap * DEN >= (a + b - overlap) * NUM


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Bytes of each text; a null is empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        c = chunk.cast(pa.large_binary())
        offsets = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, c.offset * 8) if len(c) else np.zeros(1, np.int64)
        data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
        valid = c.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(c)):
            yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def _named_sets(column: pa.Array, shared: frozenset[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Name and set of each text that has words; ``shared``: see ``Texts``."""
    for sets in _set_groups(_texts(column)):
        if full := [s for s in sets if len(s)]:
            first, other = (x.tolist() for x in fingerprints(full))
            yield from zip([o if f in shared else f for f, o in zip(first, other)], full) if shared else zip(first, full)


@dataclass(frozen=True)
class Texts:
    """The table of texts, and the fingerprints that different sets share: those sets go by their other 64 bits.

    Of n sets, n^2 / 2^65 share one: none up to a billion, a few of ten billion.
    """

    table: DataFrame
    shared: frozenset[int] = frozenset()

    @property
    def text(self) -> DataFrame:
        return self.table.select(F.col("text").cast("string").alias("text"))

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession


class _Counter:
    """Counts of hash buckets, 32 MB."""

    def __init__(self):
        self.count, self.wait, self.held = np.zeros(BUCKETS, np.uint16), [], 0

    def add(self, s: np.ndarray) -> None:
        self.wait.append((s & _u(BUCKETS - 1)).astype(np.uint32))
        self.held += len(s)
        if self.held > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            at, more = np.unique(np.concatenate(self.wait), return_counts=True)
            self.count[at] = np.minimum(self.count[at].astype(np.int64) + more, 65535)
            self.wait, self.held = [], 0


SETS = "doc_id long, key long, n long, fp long, other long, bands array<long>, chunk int, counts binary"


def describe(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, key, n, fp, other, bands) and, of each task, the bucket counts by chunk.

    key: a hash of the text; fp and other: see ``fingerprints``.
    """
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    names = [x.split()[0] for x in SETS.split(", ")]

    def run(batches):
        seen = _Counter()
        for b in batches:
            n, fp, other, bands = [], [], [], []
            for sets in _set_groups(_texts(b.column(2))):
                full = [s for s in sets if len(s)]
                n += map(len, sets)
                if full:
                    first, second = (iter(x.tolist()) for x in fingerprints(full))
                    keys = iter(band_keys(full).tolist())
                    seen.add(np.concatenate(full))
                fp += [next(first) if len(s) else None for s in sets]
                other += [next(second) if len(s) else None for s in sets]
                bands += [next(keys) if len(s) else None for s in sets]
            none = [None] * len(n)
            columns = (b.column(0), b.column(1), n, fp, other, bands, none, none)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        seen.flush()
        if seen.count.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in seen.count.reshape(CHUNKS, -1)]
            none = [None] * CHUNKS
            yield pa.record_batch([pa.array(c, t) for c, t in zip((*[none] * 6, range(CHUNKS), parts), types)], names=names)
        pa.default_memory_pool().release_unused()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, SETS)


def common_buckets(sets: DataFrame, total: int) -> np.ndarray:
    """Bits of the buckets that hold many more shingles than the mean: 2 MB, whatever the input's size.

    Counts of the tasks are summed by chunk in two steps, so that no group holds those of all tasks.
    """
    mean = total / BUCKETS
    many = max(12.0, mean + 6 * math.sqrt(mean))

    def sums(g: pd.DataFrame, width: type) -> np.ndarray:
        out = np.zeros(BUCKETS // CHUNKS, np.uint64)
        for c in g["counts"]:
            out += np.frombuffer(zlib.decompress(c), width).astype(np.uint64)
        return out

    def first(key, g):
        return pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(sums(g, np.uint16).tobytes(), 1)]})

    def last(key, g):
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(sums(g, np.uint64) >= many).tobytes()]})

    counts = sets.where("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    some = counts.groupBy("chunk", "salt").applyInPandas(first, "chunk int, counts binary")
    bits = np.zeros((CHUNKS, BUCKETS // CHUNKS // 8), np.uint8)
    for r in some.groupBy("chunk").applyInPandas(last, "chunk int, bits binary").collect():
        bits[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(bits.ravel()).astype(bool)


def wanted(fps: DataFrame) -> np.ndarray:
    """A filter of fixed size (2 MB) that lets all of ``fps(fp)`` through, and few others."""

    def bits(key, g: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(FILTER_BITS // CHUNKS, bool)
        b[g["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(b).tobytes()]})

    slot = F.pmod("fp", F.lit(FILTER_BITS))
    width = FILTER_BITS // CHUNKS
    at = fps.select((slot / width).cast("int").alias("chunk"), (slot % width).cast("int").alias("bit")).distinct()
    out = np.zeros((CHUNKS, width // 8), np.uint8)
    for r in at.groupBy("chunk").applyInPandas(bits, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sets_of(docs: Texts, fps: DataFrame) -> DataFrame:
    """``(fp, items binary)``: the sorted shingle hashes of the wanted sets, made again from the texts."""
    sent, shared = docs.spark.sparkContext.broadcast(wanted(fps)), docs.shared

    def run(batches):
        bits, done = sent.value, set()
        for b in batches:
            fp, items = [], []
            for f, s in _named_sets(b.column(0), shared):
                slot = f % FILTER_BITS
                if f not in done and bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                    done.add(f)
                    fp.append(f)
                    items.append(s.tobytes())
                    if len(done) > 1_000_000:
                        done.clear()
            yield pa.record_batch([pa.array(fp, pa.int64()), pa.array(items, pa.binary())], names=["fp", "items"])
        pa.default_memory_pool().release_unused()

    found = docs.text.mapInArrow(run, "fp long, items binary").join(fps.select("fp").distinct(), "fp", "left_semi")
    return found.groupBy("fp").agg(F.first("items").alias("items"))


def _beside(pairs: DataFrame, sets: DataFrame, x: str) -> tuple[DataFrame, list[str]]:
    """``pairs`` with the items of the sets in column ``x``, as ``x`` + items, and the tables that can go later.

    A set that many pairs name (a pivot of a large group) is copied once for every MEET of them, and
    its pairs are dealt out over the copies.
    """
    hot, path = table(pairs.groupBy(x).agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("copies")).where("copies > 1"), "hot-sets")
    one = F.coalesce("copies", F.lit(1))
    other = "b" if x == "a" else "a"
    p = pairs.join(hot, x, "left").withColumn("copy", F.pmod(F.xxhash64(other), one).cast("int")).drop("copies")
    s = sets.withColumnsRenamed({"fp": x, "items": f"{x}items"}).join(hot, x, "left")
    s = s.withColumn("copy", F.explode(F.sequence(F.lit(0), one - 1))).drop("copies")
    return p.join(s, [x, "copy"]).drop("copy"), [path]


def overlaps(pairs: DataFrame, docs: Texts) -> tuple[DataFrame, str]:
    """``pairs(a, b)`` with ``overlap``, the size of the two sets' intersection, from the sets themselves; and the table's path."""
    pairs = pairs.select("a", "b")
    fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets, path = table(sets_of(docs, fps), "sets")

    def run(batches):
        for g in batches:
            n = [
                len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
                for x, y in zip(g.column("aitems"), g.column("bitems"))
            ]
            yield pa.record_batch([g.column("a"), g.column("b"), pa.array(n, pa.int64())], names=["a", "b", "overlap"])
        pa.default_memory_pool().release_unused()

    left, more = _beside(pairs, sets, "a")
    both, last = _beside(left, sets, "b")
    found, out = table(both.mapInArrow(run, "a long, b long, overlap long"), "overlaps")
    for p in (path, *more, *last):
        delete_path(docs.spark, p)
    return found, out


def pivots(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: each set and the pivot with which it shares most bands, the smaller node of equals."""
    keys = nodes.select("fp", F.explode("bands").alias("band"))
    first = keys.groupBy("band").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other")).where("pivot < other").drop("other")
    shared = keys.join(first, "band").where("fp <> pivot").groupBy("fp", "pivot").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("fp").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("fp").alias("a"), "b")


POSTINGS = "part int, entries long, items binary, owner binary, place binary, fps binary, sizes binary"


def postings(docs: Texts, common: np.ndarray, parts: int) -> DataFrame:
    """Index entries (shingle, set, position) of every set's prefix, packed by range of the shingle's hash.

    The order is: shingles of uncommon buckets before those of common ones, then by hash.
    """
    sent, shared = docs.spark.sparkContext.broadcast(np.packbits(common)), docs.shared
    shift = _u(64 - int(math.log2(parts)))

    def run(batches):
        rare_last = np.unpackbits(sent.value).astype(bool)
        done: set[int] = set()
        items, owner, place, fps, sizes, held = [], [], [], [], [], 0

        def flush():
            x, o, p = np.concatenate(items), np.concatenate(owner), np.concatenate(place)
            part = (x >> shift).astype(np.int64) if parts > 1 else np.zeros(len(x), np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            f, s = np.array(fps, np.int64), np.array(sizes, np.int32)
            rows: list[list] = [[] for _ in range(7)]
            for k in range(parts):
                own = order[ends[k] : ends[k + 1]]
                if len(own):
                    who, at = np.unique(o[own], return_inverse=True)
                    row = (k, len(own), x[own], at.astype(np.uint32), p[own], f[who], s[who])
                    for column, value in zip(rows, row):
                        column.append(value if isinstance(value, int) else zlib.compress(value.tobytes(), 1))
            types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            return pa.record_batch([pa.array(c, t) for c, t in zip(rows, types)], names=[c.split()[0] for c in POSTINGS.split(", ")])

        for b in batches:
            for f, s in _named_sets(b.column(0), shared):
                if f in done:
                    continue
                done.add(f)
                if len(done) > 1_000_000:
                    done.clear()
                late = rare_last[(s & _u(BUCKETS - 1)).astype(np.int64)]
                k = prefix_length(len(s))
                early = s[~late]
                head = early[:k] if len(early) >= k else np.concatenate((early, s[late][: k - len(early)]))
                items.append(head)
                owner.append(np.full(k, len(fps), np.uint32))
                place.append(np.arange(k, dtype=np.uint32))
                fps.append(f)
                sizes.append(len(s))
                held += k
                if held >= FLUSH:
                    yield flush()
                    items, owner, place, fps, sizes, held = [], [], [], [], [], 0
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    return docs.text.mapInArrow(run, POSTINGS)


ENTRIES = "item long, fp long, n long, at long"


def lists(packed: DataFrame) -> DataFrame:
    """Entries of the lists that hold at least two sets: ``(item, fp, n, at)``, as a written table.

    Parts of the index are unpacked in groups. A part with many more entries than the mean (that of a
    very common shingle) is dealt out over several groups, and what these leave is put together by
    aggregations, so no task holds a long list.
    """
    spark = packed.sparkSession
    held = packed.groupBy("part").agg(F.ceil(F.sum("entries") / (4 * PART_ENTRIES)).cast("int").alias("groups")).where("groups > 1")
    hot, hot_path = table(held, "hot-parts")
    split = packed.join(hot, "part", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("fps"), "groups"), F.lit(-1)).cast("int"))

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        x, f, n, at = [], [], [], []
        for r in g.itertuples():
            def get(name, kind, r=r):
                return np.frombuffer(zlib.decompress(getattr(r, name)), kind)

            who = get("owner", np.uint32)
            x.append(get("items", np.uint64))
            f.append(get("fps", np.int64)[who])
            n.append(get("sizes", np.int32)[who])
            at.append(get("place", np.uint32))
        x, f, n, at = map(np.concatenate, (x, f, n, at))
        order = np.lexsort((f, x))
        x, f, n, at = x[order], f[order], n[order], at[order]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != x[:-1]) | (f[1:] != f[:-1])  # copies met by different tasks
        x, f, n, at = x[keep], f[keep], n[keep], at[keep]
        whole = key[1] < 0
        if whole:
            same = x[1:] == x[:-1]
            keep = np.zeros(len(x), bool)
            keep[1:] |= same
            keep[:-1] |= same
            x, f, n, at = x[keep], f[keep], n[keep], at[keep]
        return pd.DataFrame({"item": x.view(np.int64), "fp": f, "n": n.astype(np.int64), "at": at.astype(np.int64), "whole": whole})

    entries, path = table(split.drop("groups").groupBy("part", "piece").applyInPandas(run, f"{ENTRIES}, whole boolean"), "entries")
    done = entries.where("whole").drop("whole")
    if not hot.isEmpty():
        open_ = entries.where("not whole").groupBy("item", "fp").agg(F.min("n").alias("n"), F.min("at").alias("at"))
        many = open_.groupBy("item").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("item")
        done, _ = table(done.unionByName(open_.join(many, "item")), "all-entries")
        delete_path(spark, path)
    delete_path(spark, hot_path)
    return done


def neighbourhoods(entries: DataFrame) -> DataFrame:
    """``(fp, pivot)``: each set of the lists with the central set that it meets in most of them.

    A list's central set is the one in which the list's shingle stands first: it has the fewest rare
    shingles of its own. One row per entry at most; sets that meet it in less than an eighth of their
    prefix have no neighbourhood.
    """
    lead = entries.groupBy("item").agg(F.min(F.struct("at", "n", "fp")).alias("p"))
    met = entries.join(lead, "item").where("fp <> p.fp").groupBy("fp", "n", F.col("p.fp").alias("pivot")).agg(F.count(F.lit(1)).alias("common"))
    met = met.where(F.col("common") * 8 * DEN >= F.col("n") * (DEN - NUM))
    return met.groupBy("fp").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("pivot"))


def _overlap_matrix(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """Overlaps of all pairs, from products of incidence matrices over the shingles that occur twice."""
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = int((times > 1).sum())
    place = np.full(len(items), -1)
    place[times > 1] = np.arange(shared)
    column = place[column]
    who, column = who[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    rows = np.arange(len(sets))
    overlap = np.zeros((len(rows[left]), len(rows[right])), np.float32)
    for at in range(0, shared, WIDTH):
        i, j = np.searchsorted(column, [at, at + WIDTH])
        m = np.zeros((len(sets), min(WIDTH, shared - at)), np.float32)
        m[who[i:j], column[i:j] - at] = 1
        overlap += m[left] @ m[right].T
    return overlap


def _inside(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Links of a block of open sets with a block of their neighbourhood, as edges of a spanning forest.

    Sets that link with the pivot (closed) are connected already and count as one.
    """
    left, right = g[g["left"]].reset_index(drop=True), g[~g["left"]].reset_index(drop=True)
    rows = pd.concat([left, right], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
    nl, n = len(left), rows["n"].to_numpy()
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not nl or nl == len(rows):
        return none
    overlap = _overlap_matrix(sets, slice(nl), slice(nl, None))
    fp = rows["fp"].to_numpy()
    hit = (overlap * DEN >= (n[:nl, None] + n[None, nl:] - overlap) * NUM) & (fp[:nl, None] != fp[None, nl:])
    label = np.arange(len(rows))
    closed = np.flatnonzero(rows["closed"].to_numpy())
    label[closed] = closed[0] if len(closed) else 0
    first = {f: k for k, f in reversed(list(enumerate(fp)))}
    label = np.array([label[first[f]] for f in fp])  # a set on both sides is one
    a, b = [], []
    for i in np.flatnonzero(hit.any(1)):
        for j in np.flatnonzero(hit[i]) + nl:
            if label[j] != label[i]:
                a.append(fp[i])
                b.append(fp[j])
                label[label == label[j]] = label[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def inside_links(hoods: DataFrame, docs: Texts) -> DataFrame:
    """Links ``(a, b)`` inside neighbourhoods, of the sets that don't link with their pivot with any other member.

    ``hoods``: (fp, pivot, n, closed). Neighbourhoods are cut into blocks of shingles, open blocks
    meet all blocks, so no task holds a large neighbourhood. A small set counts as LEAST_ITEMS
    shingles, which bounds the sets of a block too.
    """
    items = F.greatest(F.col("n"), F.lit(LEAST_ITEMS))
    sizes, sizes_path = table(hoods.groupBy("pivot").agg(
        F.ceil(F.sum(F.when(~F.col("closed"), items)) / BLOCK_ITEMS).cast("int").alias("nl"), F.ceil(F.sum(items) / BLOCK_ITEMS).cast("int").alias("nr"), F.count(F.lit(1)).alias("k")
    ).where("nl > 0 and k > 1").drop("k"), "hood-sizes")
    h, path = table(hoods.join(sizes, "pivot"), "open-hoods")
    sets, sets_path = table(sets_of(docs, h.select("fp")), "hood-sets")
    lb, rb = F.pmod(F.xxhash64("fp"), "nl").cast("int"), F.pmod(F.xxhash64("fp"), "nr").cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda i: F.struct(i.alias("l"), rb.alias("r"), F.lit(False).alias("left")))
    left = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(lb.alias("l"), i.alias("r"), F.lit(True).alias("left")))
    every = F.when(F.col("closed"), right).otherwise(F.concat(left, right))
    rows = h.join(sets, "fp").select("pivot", "fp", "n", "closed", "items", F.inline(every))
    links, _ = table(rows.groupBy("pivot", "l", "r").applyInPandas(_inside, "a long, b long"), "inside")
    for p in (sizes_path, path, sets_path):
        delete_path(docs.spark, p)
    return links


def bridges(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links between sets as links between their clusters."""
    c = clusters.select("node", "component")
    return (
        links.join(c.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
        .join(c.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )


def merged(clusters: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """Clusters after the links between their sets are added; clusters are stars, so these stay shallow."""
    stars = clusters.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return table(components(stars.union(bridges(links, clusters))), "clusters")


def candidates(entries: DataFrame, clusters: DataFrame, hoods: DataFrame) -> DataFrame:
    """``(a, b, na, nb)``: pairs of sets of different clusters and neighbourhoods that the index can't rule out.

    Lists whose sets are all of one cluster are skipped. The others are cut into blocks of set
    sizes; an entry meets its own block and the next one, the next only if its position leaves room
    for so large a partner: |b| <= (|a| - position of a) * DEN / NUM. Of the pairs that meet, those
    stay whose common prefix shingles suffice: overlap <= common + what lies behind the prefix.
    """
    c = clusters.select(F.col("node").alias("fp"), "component")
    e = entries.join(c, "fp", "left").withColumn("cluster", F.coalesce("component", "fp")).drop("component")
    e = e.join(hoods.select("fp", "pivot"), "fp", "left").withColumn("hood", F.coalesce("pivot", "fp")).drop("pivot")
    mixed = e.groupBy("item").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("item")
    e = e.join(mixed, "item")
    # a pair has no more shingles in common lists than either set has entries there
    e = e.join(e.groupBy("fp").agg(F.count(F.lit(1)).alias("entries")), "fp")

    # monotone in the size, so every size from n to room lies in a block from block(n) to block(room)
    def block(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(BLOCK_GROWTH)).cast("int")

    room = F.floor((F.col("n") - F.col("at")) * DEN / NUM)
    e = e.withColumn("block", block(F.col("n")))
    probe = e.where(room >= F.col("n")).select(
        "item", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("cluster").alias("ca"), F.col("hood").alias("ha"), F.col("entries").alias("ea"),
        F.explode(F.sequence(F.col("block"), block(room))).alias("block"),
    )
    index = e.select("item", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("cluster").alias("cb"), F.col("hood").alias("hb"), F.col("entries").alias("eb"), "block")
    # shingles that don't meet lie behind one of the two prefixes: fewer than NUM / DEN of the larger set
    def enough(common: Column) -> Column:
        most = common + F.ceil(F.col("nb") * NUM / DEN) - 1
        return similar(F.least(most, F.col("na")), F.col("na"), F.col("nb"))

    met = probe.join(index, ["item", "block"]).where(
        (F.col("ca") != F.col("cb")) & (F.col("ha") != F.col("hb")) & (F.col("ha") != F.col("b")) & (F.col("hb") != F.col("a"))
        & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("nb") * NUM <= (F.col("na") - F.col("ia")) * DEN) & enough(F.least("ea", "eb"))
    )
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("common"))
    return pairs.where(enough(F.col("common"))).select("a", "b", "na", "nb")


def answers(cands: DataFrame, members: DataFrame, docs: Texts) -> DataFrame:
    """Links ``(a, b)`` among the candidates, derived from their pivots' answers where these decide.

    ``members``: (fp, pivot, added, removed), the sizes of a linked set's differences from its
    pivot. With o the pivots' overlap, a pair's overlap is at least o - removed and at most
    o + added. Pairs between the bounds are compared themselves.
    """
    m = members.select("fp", "pivot", "added", "removed")
    zero = F.lit(0).cast("long")

    def side(df: DataFrame, x: str) -> DataFrame:
        j = df.join(m.withColumnsRenamed({"fp": x, "pivot": f"p{x}", "added": f"add{x}", "removed": f"rem{x}"}), x, "left")
        return j.withColumn(f"p{x}", F.coalesce(f"p{x}", x)).withColumn(f"add{x}", F.coalesce(f"add{x}", zero)).withColumn(f"rem{x}", F.coalesce(f"rem{x}", zero))

    c = side(side(cands, "a"), "b")
    c = c.withColumn("lo", F.least("pa", "pb")).withColumn("hi", F.greatest("pa", "pb"))
    c, path = table(c, "candidates")
    pivot_pairs = c.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    known, known_path = overlaps(pivot_pairs, docs)
    c = c.join(known.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "overlap"), ["lo", "hi"])
    low = F.greatest(zero, F.col("overlap") - F.col("rema") - F.col("remb"))
    high = F.least(F.col("overlap") + F.col("adda") + F.col("addb"), "na", "nb")
    c = c.withColumn("sure", similar(low, F.col("na"), F.col("nb"))).withColumn("open", similar(high, F.col("na"), F.col("nb")))
    links = c.where("sure").select("a", "b")
    rest, rest_path = table(c.where("open and not sure").select("a", "b", "na", "nb"), "undecided")
    paths = [path, known_path, rest_path]
    if not rest.isEmpty():
        found, found_path = overlaps(rest, docs)
        found = found.join(rest, ["a", "b"]).where(similar(F.col("overlap"), F.col("na"), F.col("nb")))
        links = links.union(found.select("a", "b"))
        paths.append(found_path)
    links, _ = table(links, "answers")
    for p in paths:
        delete_path(docs.spark, p)
    return links


def _counted(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Linked rows of each set, by pair of blocks (ka, kb) of a component."""
    fps, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (_, ka, kb), rows in g.groupby(["whole", "ka", "kb"], sort=False):
        if ka != kb:
            rows = pd.concat([rows[rows["k"] == ka], rows[rows["k"] == kb]])
        nl = int((rows["k"] == ka).sum())
        left, right = slice(nl), slice(nl, None) if ka != kb else slice(None)
        fp, n, copies = (rows[c].to_numpy() for c in ("fp", "n", "copies"))
        overlap = _overlap_matrix([np.frombuffer(x, np.uint64) for x in rows["items"]], left, right)
        hit = overlap * DEN >= (n[left, None] + n[None, right] - overlap) * NUM
        if ka == kb:
            np.fill_diagonal(hit, False)
        else:
            fps.append(fp[right])
            links.append(hit.T @ copies[left])
        fps.append(fp[left])
        links.append(hit @ copies[right])
    return pd.DataFrame({"fp": np.concatenate(fps), "links": np.concatenate(links)})


def link_counts(sets: DataFrame, members: DataFrame, docs: Texts) -> DataFrame:
    """``(fp, links)``: the rows of other sets that each set links with; sets without such links don't appear.

    ``sets``: (fp, n, copies, whole), whole being the component, outside which nothing links. A
    component of more than BLOCK_ITEMS shingles is cut into blocks by size and, around a pivot with
    so many shingles in its members, by the difference from the pivot. Pairs of blocks are left out
    if their sizes exclude links, counted whole if o - removed - removed suffices for all their
    pairs (see ``answers``), and compared otherwise. Small components share tasks.
    """
    load = F.greatest(F.col("n"), F.lit(LEAST_ITEMS))
    many = sets.groupBy("whole").agg(F.sum(load).alias("held"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    zero = F.lit(0).cast("long")
    s = sets.join(many, "whole").join(members.select("fp", "pivot", "added", "removed"), "fp", "left").select(
        "fp", "n", "copies", "whole", "held", F.coalesce("pivot", "fp").alias("star"), F.coalesce("added", zero).alias("added"), F.coalesce("removed", zero).alias("removed")
    )
    s, path = table(s, "linked")
    small = s.where(F.col("held") <= BLOCK_ITEMS)
    bins = 1 + (small.agg(F.sum(load)).first()[0] or 0) // BLOCK_ITEMS
    small = small.select("whole", zero.alias("ka"), zero.alias("kb"), zero.alias("k"), "fp", "n", "copies", F.pmod(F.xxhash64("whole"), F.lit(bins)).alias("bin"))

    large = s.where(F.col("held") > BLOCK_ITEMS)
    stars = large.groupBy("whole", "star").agg(F.sum(load).alias("around")).where(F.col("around") > BLOCK_ITEMS).select("whole", "star", F.lit(True).alias("large"))
    difference = F.when(F.col("large"), F.floor(F.log2(F.col("added") + F.col("removed") + 1)))
    kind = F.xxhash64(F.when(F.col("large"), F.col("star")), difference, F.floor(F.log(F.col("n").cast("double")) / math.log(BLOCK_GROWTH)))
    large = large.join(stars, ["whole", "star"], "left").withColumn("kind", kind)
    parts = large.groupBy("whole", "kind").agg(F.ceil(F.sum(load) / BLOCK_ITEMS).alias("parts"))
    large = large.join(parts, ["whole", "kind"]).withColumn("k", F.xxhash64("kind", F.pmod(F.xxhash64("fp"), "parts")))
    large, large_path = table(large.select("whole", "k", "fp", "n", "copies", "star", "added", "removed"), "large-components")
    blocks = large.groupBy("whole", "k").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("removed").alias("removed"), F.sum("copies").alias("copies"),
        F.min("star").alias("star"), F.max("star").alias("last"), F.min(F.col("n") - F.col("added") + F.col("removed")).alias("o"),
    )

    def side(x: str) -> DataFrame:
        return blocks.select("whole", *(F.col(c).alias(f"{c}{x}") for c in blocks.columns if c != "whole"))

    low = F.col("oa") - F.col("removeda") - F.col("removedb")
    one_star = (F.col("stara") == F.col("lasta")) & (F.col("starb") == F.col("lastb")) & (F.col("stara") == F.col("starb"))
    pairs = side("a").join(side("b"), "whole").where(
        (F.col("ka") <= F.col("kb")) & (F.col("mosta") * DEN >= F.col("leastb") * NUM) & (F.col("mostb") * DEN >= F.col("leasta") * NUM)
    )
    pairs = pairs.withColumn("sure", one_star & (low > 0) & similar(low, F.col("mosta"), F.col("mostb")))
    pairs, pairs_path = table(pairs.select("whole", "ka", "kb", "copiesa", "copiesb", "sure"), "block-pairs")
    ends = F.array(F.struct(F.col("ka").alias("k"), F.col("copiesb").alias("other")), F.struct(F.col("kb").alias("k"), F.col("copiesa").alias("other")))
    ends = pairs.select("whole", "ka", "kb", "sure", F.inline(F.slice(ends, F.lit(1), F.when(F.col("ka") == F.col("kb"), 1).otherwise(2))))
    open_ = large.join(ends.where("not sure"), ["whole", "k"]).select("whole", "ka", "kb", "k", "fp", "n", "copies", F.xxhash64("whole", "ka", "kb").alias("bin"))
    sure = ends.where("sure").groupBy("whole", "k").agg(F.sum("other").alias("other"), F.max(F.col("ka") == F.col("kb")).alias("own"))
    sure = large.join(sure, ["whole", "k"]).select("fp", (F.col("other") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))

    items, items_path = table(sets_of(docs, s.select("fp")), "linked-sets")
    found = small.union(open_).join(items, "fp").groupBy("bin").applyInPandas(_counted, "fp long, links long")
    out, _ = table(found.union(sure).groupBy("fp").agg(F.sum("links").alias("links")).where("links > 0"), "link-counts")
    for p in (path, large_path, pairs_path, items_path):
        delete_path(docs.spark, p)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``.

    Documents link when 100 * intersection >= 75 * union of their sets of distinct five-word
    shingles (words: lower-cased A-Z, split at ASCII white space; with fewer than five, the whole
    sequence is one shingle). component_id is the smallest doc_id reachable by links. Null texts and
    texts without words have an empty set and link with nothing. Repeated rows and equal texts
    link; a row without doc_id passes links on but never names a component (null if alone). An
    empty table gives no rows; other columns are ignored.
    """
    rows, named, _, _ = _joined(docs)
    return _per_row(rows, named.select("fp", "component_id"))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """``jaccard_components`` with n_links, the number of other rows that the row links with; copies count one by one."""
    rows, named, members, texts = _joined(docs)
    if members is None:
        return _per_row(rows, named.select("fp", "component_id")).withColumn("n_links", F.lit(0).cast("long"))
    with small_batches(docs.sparkSession):
        links = link_counts(named.select("fp", "n", "copies", "whole"), members, texts)
    found = named.select("fp", "component_id", "copies").join(links, "fp", "left")
    own = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return _per_row(rows, found.select("fp", "component_id", own.alias("n_links"))).fillna(0, ["n_links"])


def one_per_component(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id.

    Rows without a doc_id come last; of rows with one doc_id, the smallest hash of the text decides, and
    of rows that repeat both, any. Rows without words link with nothing and stay.
    """
    rows, named, _, _ = _joined(docs)
    ids = ("nameless", "doc_id", "key")
    first = named.groupBy("whole").agg(F.min("rank").alias("rank")).select("rank.*", F.lit(False).alias("apart"))
    rest = rows.where("fp is null").select(*_rank(), F.lit(True).alias("apart")).distinct()
    keep = first.unionByName(rest).toDF(*(f"{c}_kept" for c in (*ids, "apart")))
    d, name = plain_names(docs)
    text = F.col(name["text"]).cast("string")
    own = d.withColumns(dict(zip(ids, _rank(F.col(name["doc_id"]).cast("long"), F.xxhash64(text)))))
    kept = own.join(keep, [F.col(c) == F.col(f"{c}_kept") for c in ids]).withColumn("nth", F.when(F.col("apart_kept"), F.monotonically_increasing_id()))
    return kept.dropDuplicates([*ids, "nth"]).select(*d.columns).toDF(*docs.columns)


def _rank(doc_id: Column | None = None, key: Column | None = None) -> tuple[Column, ...]:
    """What a row is ranked by within its component; never null."""
    doc_id, key = F.col("doc_id") if doc_id is None else doc_id, F.col("key") if key is None else key
    return doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), key.alias("key")


def _per_row(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets(fp, component_id, ...)`` for every row; a row without words is alone."""
    more = [c for c in sets.columns if c not in ("fp", "component_id")]
    alone = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(sets, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), alone, *more)


def _names(sets: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``sets`` with a name for each set in ``fp``, and the fingerprints that different sets share (see ``Texts``)."""
    twice = sets.where("fp is not null").groupBy("fp").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("fp")
    shared = [r["fp"] for r in twice.limit(SHARED + 1).collect()]
    if len(shared) > SHARED:
        raise RuntimeError("too many sets share 64 bits")
    if not shared:
        return sets, frozenset()
    return sets.withColumn("fp", F.when(F.col("fp").isin(shared), F.col("other")).otherwise(F.col("fp"))), frozenset(shared)


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, Texts]:
    """Rows (doc_id, key, n, fp), sets (fp, n, copies, whole, rank, component_id), members (see ``answers``) and texts.

    whole names a set's component. Without any words, there are no sets and no members.
    """
    with small_batches(docs.sparkSession):
        return _joined_in_small_batches(docs)


def _joined_in_small_batches(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, Texts]:
    spark = docs.sparkSession
    described, _ = table(describe(docs), "described")
    described, shared = _names(described)
    texts = Texts(docs, shared)
    rows = described.where("chunk is null").select("doc_id", "key", "n", "fp")
    nodes = described.where("fp is not null").groupBy("fp").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min(F.struct(*_rank())).alias("rank"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")
    )
    nodes, nodes_path = table(nodes, "nodes")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return rows, nodes.select("fp", "n", "copies", F.col("fp").alias("whole"), "rank", F.col("doc_id").alias("component_id")), None, texts

    # pivots and their clusters
    stars, stars_path = table(pivots(nodes), "stars")
    size = nodes.select("fp", "n")

    def compared(pairs: DataFrame) -> tuple[DataFrame, str]:
        found, path = overlaps(pairs, texts)
        sized = found.join(size.withColumnsRenamed({"fp": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"fp": "b", "n": "nb"}), "b")
        return sized.withColumn("linked", similar(F.col("overlap"), F.col("na"), F.col("nb"))), path

    found, path = compared(stars)
    members, _ = table(
        found.where("linked").select(F.col("a").alias("fp"), F.col("b").alias("pivot"), (F.col("na") - F.col("overlap")).alias("added"), (F.col("nb") - F.col("overlap")).alias("removed")),
        "members",
    )
    delete_path(spark, path)
    delete_path(spark, stars_path)
    clusters, clusters_path = table(components(members.select(F.col("fp").alias("a"), F.col("pivot").alias("b"))), "clusters")

    # index over all sets
    parts = 1 << max(0, math.ceil(math.log2(max(1.0, total * (1 - NUM / DEN) / PART_ENTRIES))))
    packed, path = table(postings(texts, common_buckets(described, total), parts), "packed", "none")
    entries = lists(packed)
    delete_path(spark, path)
    near, near_path = table(neighbourhoods(entries), "near")
    found, path = compared(near.select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    hoods, hoods_path = table(found.select(F.col("a").alias("fp"), F.col("b").alias("pivot"), F.col("na").alias("n"), F.col("linked").alias("closed")), "known")
    delete_path(spark, path)
    delete_path(spark, near_path)
    links = hoods.where("closed").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).union(inside_links(hoods, texts))
    more, more_path = merged(clusters, links)
    all_, _ = merged(more, answers(candidates(entries, more, hoods), members, texts))
    for p in (clusters_path, more_path, hoods_path):
        delete_path(spark, p)
    named = nodes.drop("bands").join(all_.withColumnRenamed("node", "fp"), "fp", "left").withColumn("whole", F.coalesce("component", "fp"))
    smallest = named.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    named, _ = table(named.join(smallest, "whole").select("fp", "n", "copies", "whole", "rank", "component_id"), "components")
    delete_path(spark, nodes_path)
    return rows, named, members, texts

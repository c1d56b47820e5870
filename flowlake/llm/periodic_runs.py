"""Runs of words with a period, found by block convolution, and texts with those runs collapsed.

All texts of a slab stand in one row of word codes, parted by codes that occur once. At each dyadic
scale B the row is cut into blocks of B words. The exact number-theoretic transform gives, for each
block and each distance d from B to 2B - 1, the sum of squared differences between the block and
the words d places on, in one convolution with the window that follows. Zeros are occurrences. A
run of period q (B <= q < 2B) and length 4q or more holds two neighbouring blocks that both recur
at distance q, so such pairs seed extensions, which compare words themselves.

What keeps the work near linear, without losing a run:

- a block can only recur if each of its words does within the window, which the distances to the
  words' next places tell;
- what lies inside a run of a smaller period has that period or a multiple of it at all distances
  that matter (two periods of a stretch as long as both have their greatest common divisor as a
  period), so blocks and seeds inside known runs are skipped; scales go from small to large.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import slabs
from .words import SPACED, as_array, bytes_of, cut

#: Bytes of text whose words stand in one row.
SLAB = 2 << 20
#: A prime 7 * 2^26 + 1 with its primitive root. Residues of up to 27 primes times a residue fit 64 bits.
PRIME, ROOT = 469_762_049, 3
#: Words of the largest block: a transform of twice as many residues exists. Larger scales use several windows.
LARGEST = 1 << 24
#: Residues that are transformed at once, unless one block has more.
AT_ONCE = 1 << 19
#: What a run must have: words, and periods.
LEAST, TIMES = 6, 4

RESULT = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@lru_cache(64)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of a root of unity of order n."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(1, np.uint64)
    while len(out) < n // 2:
        out = np.concatenate((out, out * np.uint64(pow(w, len(out), PRIME)) % PRIME))
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Transforms of residues, row by row, in bit-reversed order."""
    m, n = rows.shape
    half, p = n // 2, np.uint64(PRIME)
    while half:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1]
        out = np.empty_like(x)
        s = u + v
        np.subtract(s, p, out=s, where=s >= p)
        out[:, :, 0] = s
        out[:, :, 1] = (u + p - v) * _powers(2 * half, False) % p
        rows, half = out.reshape(m, n), half // 2
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """Rows of residues from transforms in bit-reversed order."""
    m, n = rows.shape
    half, p = 1, np.uint64(PRIME)
    while half < n:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1] * _powers(2 * half, True) % p  # u gains one prime a step
        out = np.empty_like(x)
        out[:, :, 0], out[:, :, 1] = u + v, u + p - v
        rows, half = out.reshape(m, n), half * 2
    return rows % p * np.uint64(pow(n, -1, PRIME)) % p


def occurrences(residues: np.ndarray, squares: np.ndarray, blocks: np.ndarray, size: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever a block's residues recur ``near`` to ``near + size - 1`` places on.

    ``residues`` go on behind the last word for as long as windows reach; ``squares`` are their squares' running sums.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    p, step = np.uint64(PRIME), max(1, AT_ONCE // (2 * size))
    for i in range(0, len(blocks), step):
        k = blocks[i : i + step, None] * size
        own = np.zeros((len(k), 2 * size), np.uint64)
        pattern = residues[k + np.arange(size)]
        own[:, 0], own[:, size + 1 :] = pattern[:, 0], pattern[:, :0:-1]  # reversed, so that the product is a correlation
        window = residues[k + near + np.arange(2 * size)]
        product = inverse(transform(own) * transform(window) % p)[:, :size]
        at = k + near + np.arange(size)
        theirs = (squares[at + size] - squares[at]) % p
        ours = (squares[k + size] - squares[k]) % p
        row, d = np.nonzero((theirs + ours + 2 * (p - product)) % p == 0)
        found.append((blocks[i + row], near + d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class _Known:
    """Runs found so far; tells which stretches lie inside one of them."""

    def __init__(self) -> None:
        self.start = self.end = self.period = np.empty(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        both = np.unique(np.stack([np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period))]), axis=1)
        self.start, self.end, self.period = both

    def holds(self, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """Stretches inside a run whose period is ``most`` or less."""
        use = self.period <= most
        s, far = self.start[use], np.maximum.accumulate(self.end[use])
        i = np.searchsorted(s, start, "right") - 1
        return (i >= 0) & (far[i] >= end) if len(s) else np.zeros(len(start), bool)


def _reach(codes: np.ndarray, at: np.ndarray, d: np.ndarray, way: int, step: int) -> np.ndarray:
    """How many places on from ``at`` (``way`` 1 or -1) the words equal those d further, ``at`` included."""
    out, going, last = np.zeros(len(at), np.int64), np.arange(len(at)), len(codes) - 1
    rows = max(1, AT_ONCE // step)
    while len(going):
        still = []
        for i in range(0, len(going), rows):
            g = going[i : i + rows]
            left = (at[g] + way * out[g])[:, None] + way * np.arange(step)
            right = left + d[g, None]
            same = (left >= 0) & (right <= last)
            same &= codes[np.clip(left, 0, last)] == codes[np.clip(right, 0, last)]
            more = np.where(same.all(1), step, same.argmin(1))
            out[g] += more
            still.append(g[more == step])
        going = np.concatenate(still)
    return out


def find_runs(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in a row of word codes, by start, end and period.

    Codes are not negative. No text has more than ``longest`` words; texts are parted by codes that occur once.
    """
    known, n = _Known(), len(codes)
    if n < LEAST:
        return known.start, known.end, known.period
    order = np.argsort(codes, kind="stable")
    again = np.full(n, np.iinfo(np.int64).max)  # how far each word's next place is
    next_same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][next_same]] = (order[1:] - order[:-1])[next_same]
    residues = (codes.astype(np.uint64) * np.uint64(97_531_213) + np.uint64(1)) % np.uint64(PRIME)  # different for different codes
    farthest, scale = again, 1
    while TIMES * scale <= longest:
        size = min(scale, LARGEST)
        if scale > 1 and size == scale:
            m = len(farthest) // 2
            farthest = np.maximum(farthest[: 2 * m : 2], farthest[1 : 2 * m : 2])
        k = np.flatnonzero(farthest < 2 * scale)
        k = k[~known.holds(k * size, k * size + size + 2 * scale, size)]
        beside = np.diff(k) == 1
        k = k[np.append(beside, False) | np.append(False, beside)] if len(k) else k
        if len(k):
            # what follows the last word is filled up with a residue; extensions compare words, so it can't make a run
            padded = np.concatenate((residues, np.zeros(3 * scale + 2 * size, np.uint64)))
            squares = np.concatenate((np.zeros(1, np.uint64), np.cumsum(padded * padded % np.uint64(PRIME))))
            for near in range(scale, 2 * scale, size):
                known_here = _seeds(codes, known, *occurrences(padded, squares, k, size, near), size)
                if len(known_here[0]):
                    known.add(*known_here)
        scale *= 2
    return known.start, known.end, known.period


def _seeds(codes: np.ndarray, known: _Known, k: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that neighbouring blocks recurring at one distance belong to."""
    inside = known.holds(k * size, (k + 1) * size + d, size)
    k, d = k[~inside], d[~inside]
    k, d = (x[np.lexsort((k, d))] for x in (k, d))
    if len(k) < 2:
        return known.start[:0], known.end[:0], known.period[:0]
    follows = (np.diff(k) == 1) & (np.diff(d) == 0)
    pair = np.append(follows, False) | np.append(False, follows)
    k, d, follows = k[pair], d[pair], (np.append(False, follows))[pair]
    head = np.flatnonzero(~follows)  # the first block of each row of blocks
    a, d = k[head] * size, d[head]
    right = _reach(codes, a, d, 1, 2 * size)
    a, d, right = (x[right >= 2 * size] for x in (a, d, right))  # equal residues of a sum needn't be equal words
    start, end = a - _reach(codes, a - 1, d, -1, size), a + right + d
    good = (end - start >= np.maximum(LEAST, TIMES * d)) & ~known.holds(start, end, int(d.max()) - 1 if len(d) else 0)
    return start[good], end[good], d[good]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words' numbers after the planting of a period, for a tenth of the ids; else None.

    A null id plants nothing.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


def _slab(ids: list, texts: pa.Array, plant: bool) -> list[tuple]:
    """A row for each text: runs, the longest, and digests of all runs and of the collapsed text."""
    kept, at, counts = cut(*bytes_of(texts), SPACED)
    words = as_array(kept, at)
    ends = np.cumsum(counts)
    picked = np.arange(len(words))
    moved: dict[int, np.ndarray] = {}
    if plant:
        for i, (doc_id, n) in enumerate(zip(ids, counts)):
            if (own := planted(doc_id, int(n))) is not None:
                moved[i] = own
                picked[ends[i] - n : ends[i]] = own + (ends[i] - n)
    own = np.array(words.dictionary_encode().indices, np.int64)[picked]
    n, different = len(own), len(words)
    begins = ends - counts + np.arange(len(counts))  # each text's first word, with one code before it
    codes = np.arange(different, different + n + len(counts) + 1)  # codes that occur once
    inner = np.arange(n) + np.repeat(np.arange(1, len(counts) + 1), counts)
    codes[inner] = own
    start, end, period = find_runs(codes, int(counts.max()) if len(counts) else 0)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stays = (np.cumsum(change)[inner] == 0) if n else np.empty(0, bool)
    owner = np.searchsorted(begins + 1, start, "right") - 1
    # several empty texts may begin at one place's neighbours; a run's text is the last that begins before it
    order = np.lexsort((period, start))
    start, end, period, owner = start[order], end[order], period[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    length_of = np.diff(at)
    spaced = np.full(len(kept) + len(words), 32, np.uint8)
    inner_bytes = np.ones(len(spaced), bool)
    inner_bytes[np.cumsum(length_of + 1) - 1] = False
    spaced[inner_bytes] = kept
    places = np.concatenate(([0], np.cumsum(length_of + 1)))
    out = []
    for i, n in enumerate(counts.tolist()):
        lo = int(ends[i]) - n
        raw = spaced[places[lo] : max(places[lo], places[lo + n] - 1)].tobytes()
        mine = slice(int(bounds[i]), int(bounds[i + 1]))
        if i in moved or mine.start < mine.stop:
            each, use = raw.split(b" "), picked[lo : lo + n][stays[lo : lo + n]] - lo
            raw = b" ".join([each[j] for j in use.tolist()])
        first = best = None
        listed = b""
        if mine.start < mine.stop:
            s, size, q = start[mine] - begins[i] - 1, end[mine] - start[mine], period[mine]
            listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), size.tolist(), q.tolist())).encode()
            first = int(np.lexsort((q, s, -size))[0])
            best = (int(s[first]), int(size[first]), int(q[first]), 1000 * int(size[first]) // int(q[first]))
        out.append((ids[i], mine.stop - mine.start, *(best or (None,) * 4), hashlib.sha256(listed).hexdigest(), hashlib.sha256(raw).hexdigest()))
    return out


def runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Periodic runs of every whole text of ``docs(doc_id, text)``, one row a document.

    A run is a stretch of words with smallest period q and length >= max(6, 4q) that no neighbouring word
    extends. doc_id, n_runs; start, length, period and exponent_milli of the longest (ties: smallest
    start, then period; null without a run); runs_sha256 of all runs' ``start,length,period`` lines;
    collapsed_sha256 of the words that no run holds after its first period, joined by one space.
    ``plant`` first plants periods in a tenth of the documents, see ``planted``. Null and empty texts
    have no words and no runs; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches):
        for b in (part for whole in batches for part in slabs(whole, 1, SLAB)):
            rows = _slab(b.column(0).to_pylist(), b.column(1), plant)
            kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])
        pa.default_memory_pool().release_unused()

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return table(d.mapInArrow(find, RESULT.format(kind)), "runs")[0]

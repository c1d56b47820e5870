"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text is walked along a document: every longest match
is a phrase, and the walk begins anew after it. The language whose text needs the fewest
normalised phrases wins. The automata are dense tables, so numpy walks thousands of blocks of
documents in step. Blocks of one document are walked from the start state at once and then again
from the state in which the block before them ends, up to the place where both walks meet, so
that phrases go on across blocks and their number is that of the whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_batches, plain_names
from .tokens import slabs

#: The bounded training sample: labelled rows per language (at most), and bytes and symbols of their whole texts that are learned.
SAMPLE_ROWS, TRAIN_SYMBOLS = 128, 49_152
#: Bytes of text that are read at once.
SLAB = 2 << 20
#: Languages that can be learned; a table of some 20 MB each in every worker, so 1.3 GB at most.
MAX_LANGUAGES = 64
#: Symbols of a block, blocks that are walked in step, and symbols between the marks at which walks can meet.
BLOCK, STEP_BLOCKS, MARK = 512, 4096, 32
#: Bits per symbol above which no learned language explains a text. The first phrase, which every text needs, is free.
MAX_BITS = 7.0

SPACE, UNKNOWN, PAD = 0, 1, 2
_letter = regex.compile(r"\p{L}")
_models: dict[int, "Model"] = {}


def letters(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None


def symbols(text: str, classes: np.ndarray) -> np.ndarray:
    """Lower-cased UTF-8 bytes as symbol classes; runs of ASCII non-letters count once."""
    s = classes[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    space = s == SPACE
    space[1:] &= space[:-1].copy()
    space[:1] = False
    return s[~space]


def byte_classes(texts: list[str]) -> np.ndarray:
    """Class of each byte value: ASCII letters and the other bytes seen in training have their own."""
    seen = np.zeros(256, bool)
    for t in texts:
        seen[np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8)] = True
    classes = np.full(256, UNKNOWN, np.uint8)
    classes[:128] = SPACE
    own = [b for b in range(256) if (97 <= b <= 122) or (b >= 128 and seen[b])]
    classes[own] = np.arange(PAD + 1, PAD + 1 + len(own), dtype=np.uint8)
    return classes


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``s``; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def walk_table(nxt: list[dict[int, int]], n_classes: int) -> np.ndarray:
    """One entry per state and symbol: next state's row * 4 + phrases closed by the step (0 to 2).

    A symbol that can't go on closes the phrase and begins the next one; a symbol that the
    training text doesn't have is a phrase of its own. Padding changes nothing.
    """
    start = np.full(n_classes, 1, np.int32)
    for c, q in nxt[0].items():
        start[c] = q * n_classes * 4
    table = np.empty((len(nxt), n_classes), np.int32)
    table[:] = start + 1
    table[0] = start
    table[:, PAD] = np.arange(len(nxt), dtype=np.int32) * n_classes * 4
    rows = np.repeat(np.arange(len(nxt)), [len(d) for d in nxt])
    table[rows, np.fromiter((c for d in nxt for c in d), np.int64, len(rows))] = (
        np.fromiter((q for d in nxt for q in d.values()), np.int64, len(rows)) * n_classes * 4
    )
    return table.ravel()


class _Walk:
    """Phrases of consecutive blocks in one language.

    ``state`` and ``closed`` hold each block's state and closed phrases at its marks; the last mark is its end.
    """

    def __init__(self, table: np.ndarray, blocks: np.ndarray, entry: np.ndarray):
        self.table, self.blocks = table, blocks
        self.state = np.empty((len(blocks), BLOCK // MARK), np.int32)
        self.closed = np.empty((len(blocks), BLOCK // MARK), np.int32)
        columns = np.ascontiguousarray(blocks.T).astype(np.int32)
        base, count = entry, np.zeros(len(blocks), np.int32)
        for k in range(BLOCK // MARK):
            base, count = self._steps(columns[k * MARK : (k + 1) * MARK], base, count)
            self.state[:, k], self.closed[:, k] = base, count

    def _steps(self, columns: np.ndarray, base: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for c in columns:
            v = self.table.take(base + c)
            count = count + (v & 3)
            base = v >> 2
        return base, count

    def again(self, rows: np.ndarray, entry: np.ndarray) -> None:
        """Walks these blocks from other states, each until it meets its last walk."""
        base, count = entry, np.zeros(len(rows), np.int32)
        for k in range(BLOCK // MARK):
            columns = np.ascontiguousarray(self.blocks[rows, k * MARK : (k + 1) * MARK].T).astype(np.int32)
            base, count = self._steps(columns, base, count)
            met = base == self.state[rows, k]
            self.closed[rows[met], k:] += (count[met] - self.closed[rows[met], k])[:, None]
            rows, base, count = rows[~met], base[~met], count[~met]
            if not len(rows):
                break
            self.state[rows, k], self.closed[rows, k] = base, count


class Model:
    """The tables of all languages, built in each worker from the broadcast training texts."""

    def __init__(self, train: dict[str, list[str]], classes: np.ndarray):
        self.langs, self.classes = sorted(train), classes
        n = int(classes.max()) + 1 if len(classes) else PAD + 1
        n = max(n, PAD + 1)
        self.tables, self.bits = [], []
        for lang in self.langs:
            s = np.concatenate([np.append(symbols(t, classes), SPACE) for t in train[lang]])
            self.tables.append(walk_table(suffix_automaton(s.tolist()), n))
            self.bits.append(np.log2(max(len(s), 2)))

    def phrases(self, blocks: np.ndarray, first: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each block (rows) closes for each language (columns), and the state in which it ends.

        ``first``: the block begins a text. A text's blocks stand in order; ``entry`` (by language) is
        the state at the first block, which can go on a text.
        """
        closed = np.empty((len(blocks), len(self.langs)), np.int64)
        state = np.empty((len(blocks), len(self.langs)), np.int32)
        for k, table in enumerate(self.tables):
            begin = np.zeros(len(blocks), np.int32)
            if not first[0]:
                begin[0] = entry[k]
            walk = _Walk(table, blocks, begin)
            while True:
                want = np.concatenate((begin[:1], np.where(first[1:], 0, walk.state[:-1, -1])))
                rows = np.flatnonzero(want != begin)
                if not len(rows):
                    break
                begin = want
                walk.again(rows, want[rows])
            closed[:, k], state[:, k] = walk.closed[:, -1], walk.state[:, -1]
        return closed, state

    def bits_per_symbol(self, texts: list[str | None]) -> np.ndarray:
        """Normalised phrases of each text for each language: phrases * log2(training symbols) / symbols."""
        return self.rates(texts)[0]

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of all phrases, and of those that a perfect match of the text wouldn't need.

        The latter leave the first phrase out, unless the text is one symbol that the language doesn't have.
        """
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts))
        strange = np.zeros((len(texts), len(self.langs)), bool)
        blocks: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        first: list[bool] = []
        state = np.zeros(len(self.langs), np.int32)

        def flush() -> None:
            nonlocal state
            if blocks:
                who = np.concatenate(owner)
                closed, ends = self.phrases(np.concatenate(blocks), np.array(first), state)
                last = np.append(who[1:] != who[:-1], True)
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(who, weights=closed[:, k], minlength=len(texts))
                opened[who[last]] = ends[last] > 0  # of a text that goes on, later blocks say it again
                state = ends[-1]
            blocks.clear(), owner.clear(), first.clear()

        opened = np.zeros((len(texts), len(self.langs)), bool)
        for i, t in enumerate(texts):
            if not letters(t):
                continue
            s = symbols(t, self.classes)
            size[i] = len(s)
            if len(s) == 1:
                strange[i] = [table[s[0]] == 1 for table in self.tables]
            n = -(-len(s) // BLOCK)
            own = np.full(n * BLOCK, PAD, np.uint8)
            own[: len(s)] = s
            own = own.reshape(n, BLOCK)
            for at in range(0, n, STEP_BLOCKS):  # a long text never stands in memory as one matrix of wide numbers
                part = own[at : at + STEP_BLOCKS]
                blocks.append(part)
                owner.append(np.full(len(part), i))
                first += [at == 0] + [False] * (len(part) - 1)
                if len(first) >= STEP_BLOCKS:
                    flush()
        flush()
        total += opened
        a_phrase = np.array(self.bits) / np.maximum(size, 1)[:, None]
        return total * a_phrase, np.maximum(total - ~strange, 0) * a_phrase


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5, is 0. A null doc_id counts as empty text: held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_texts(docs: DataFrame) -> dict[str, list[str]]:
    """Whole texts per language from the rows that aren't held out.

    Different rows (by id and text) that fit TRAIN_SYMBOLS bytes are counted per language over the whole table; a
    threshold on a hash of id and text then picks SAMPLE_ROWS of them, as expected and at most, so neither a
    repeated id nor a repeated row can fill the sample. In hash order, they are learned as long as they fit
    TRAIN_SYMBOLS bytes together; a text that doesn't fit is left out whole. A language none of whose picked texts
    fits learns from its shortest text. No more than MAX_LANGUAGES * SAMPLE_ROWS such rows reach the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    fits = F.octet_length("text") <= TRAIN_SYMBOLS
    rows = labelled.groupBy("lang").agg(F.approx_count_distinct(F.when(fits, F.col("h"))).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: each needs a table of its own in every worker")
    counts = docs.sparkSession.createDataFrame([(r["lang"], max(r["n"], 1)) for r in rows], f"lang {dict(labelled.dtypes)['lang']}, n long")
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = labelled.join(F.broadcast(counts), "lang").where(fits & (share < F.lit(float(SAMPLE_ROWS)) / F.col("n"))).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of some SAMPLE_ROWS rows
    found: dict[str, list[tuple]] = {}
    for lang, h, text in picked.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS).select("lang", "h", "text").collect():
        if letters(text):
            found.setdefault(lang, []).append((h, text))
    out: dict[str, list[str]] = {}
    for lang, own in found.items():
        left = TRAIN_SYMBOLS
        for _, text in sorted(own):
            if (size := len(text.encode("utf-8", "replace"))) <= left:
                out.setdefault(lang, []).append(text)
                left -= size
    if missing := [r["lang"] for r in rows if r["lang"] not in out]:
        short = labelled.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("x"))
        out |= {r["lang"]: [r["x"]["text"]] for r in short.collect() if letters(r["x"]["text"])}
    return out


def predict(docs: DataFrame, train: dict[str, list[str]], text: str, *keep: str) -> DataFrame:
    """Adds _lang, _score, _bits and _more to the ``keep`` columns of every row of ``docs``; reads the column ``text`` alone.

    _more is what _bits holds beyond one phrase, in the language with least. No column may have one of these names.
    """
    lower_batches(docs.sparkSession)  # for good: the result is lazy
    classes = byte_classes([t for texts in train.values() for t in texts])
    sent = docs.sparkSession.sparkContext.broadcast((train, classes))

    def run(batches):
        train, classes = sent.value
        key = zlib.crc32(repr(sorted(train.items())).encode())
        if key not in _models:
            _models.clear()
            _models[key] = Model(train, classes)
        model = _models[key]
        for b in (part for whole in batches for part in slabs(whole, text, SLAB)):
            texts = b.column(text).to_pylist()
            lang, score, bits, more = [], [], [], []
            rates = model.rates(texts) if model.langs else (np.zeros((len(texts), 0)),) * 2
            for t, r, m in zip(texts, *rates):
                if not letters(t) or not len(r):
                    lang.append("und")
                    score.append(0.0)
                    bits.append(None)
                    more.append(None)
                    continue
                best = int(np.argmin(r))  # equal rates: the first language in order
                rest = np.delete(r, best)
                lang.append(model.langs[best])
                score.append(float(1 - r[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
                bits.append(float(r[best]))
                more.append(float(m.min()))
            found = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in (score, bits, more))]
            yield pa.record_batch([*(b.column(c) for c in keep), *found], names=[*keep, "_lang", "_score", "_bits", "_more"])
        pa.default_memory_pool().release_unused()

    d = docs.select(*keep, *([F.col(text).cast("string").alias(text)] if text not in keep else []))
    schema = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c in keep)
    return d.mapInArrow(run, f"{schema}, _lang string, _score double, _bits double, _more double")


def identify(docs: DataFrame) -> DataFrame:
    """Predicts the language of every row of ``docs(doc_id, text, lang)``; lang is read for learning only.

    doc_id, held_out, lang_pred (a learned language; ``und`` if the text is null or has no letter, or
    if nothing could be learned), score (0 to 1: how far the second language lies behind), bits
    (per symbol; null for ``und``). Repeated rows stay; a null lang teaches nothing; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    found = predict(rows, training_texts(docs), "text", "doc_id", "held_out")
    return found.drop("_more").withColumnsRenamed({"_lang": "lang_pred", "_score": "score", "_bits": "bits"})


def keep_known(docs: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that a learned language explains, with all their columns; a null lang is filled in.

    Rows without a letter go, and those that need more than ``max_bits`` per symbol in every language
    for the phrases beyond the first: a text of a few symbols that one phrase explains stays.
    """
    d, name = plain_names(docs)
    found = predict(d, training_texts(docs), name["text"], *d.columns).where((F.col("_lang") != "und") & (F.col("_more") <= max_bits))
    return found.withColumn(name["lang"], F.coalesce(name["lang"], "_lang")).select(*d.columns).toDF(*docs.columns)

"""Ranked lexical search for a table of queries: term at a time, with a limit on new accumulators.

Documents are cut into segments of inverted lists, one row each, that hold the terms of the queries
alone. Each task walks its segments; for each query it takes the terms rarest first and adds their
exact integer contributions to accumulators. Before a term, the most that it and the rest can add
to a document is compared with the k-th best score that the query has so far (in this task's
earlier segments, or as a partial score in this one): once less, no document without an
accumulator can be among the best, so none is created any more, and the lists go on updating those
that exist. Each task returns its k best of each query, so lists are never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, setting, small_batches, table
from .tokens import slabs
from .words import ALNUM, LOWER, as_array, bytes_of, cut

#: (query, term) rows of a block of queries (expected). A block's terms are sent to all tasks; blocks are searched in turn.
BLOCK_TERMS = 200_000
#: Bytes of text that are cut at once, and documents and postings at which a segment ends.
SLAB, SEGMENT_DOCS, SEGMENT_POSTINGS = 2 << 20, 1 << 14, 1 << 21
#: Parts of a query's candidates that are ranked apart before the query as a whole.
PARTS = 64

SEGMENT = "ids array<{}>, sizes array<long>, terms array<int>, lists array<int>, at array<int>, tf array<int>, docs long, words long"


def query_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``: the distinct terms of each query; the terms of rows with one id are taken together."""
    kind = dict(items.dtypes)["item_id"]

    def terms(batches):
        for b in (part for whole in batches for part in slabs(whole, 1, SLAB)):
            kept, at, counts = cut(*bytes_of(b.column(1)), ALNUM, LOWER)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.record_batch([b.column(0).take(owner), as_array(kept, at)], names=["item_id", "term"])

    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(terms, f"item_id {kind}, term binary").distinct()


def _segment(ids: list[pa.Array], sizes: list, doc: list, term: list, tf: list) -> pa.RecordBatch:
    doc, term, tf, sizes = (np.concatenate(x) for x in (doc, term, tf, sizes))
    order = np.argsort(term, kind="stable")
    terms, lists = np.unique(term, return_counts=True)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
    i32 = pa.int32()
    columns = [one(pa.concat_arrays(ids), None), one(sizes, pa.int64()), one(terms, i32), one(lists, i32), one(doc[order], i32), one(tf[order], i32), pa.array([len(sizes)]), pa.array([int(sizes.sum())])]
    return pa.record_batch(columns, names=[c.split()[0] for c in SEGMENT.split(", ")])


def segments(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Segments of ``docs(doc_id, text)`` with inverted lists of ``terms``; documents without any term at all are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    kind = dict(docs.dtypes)["doc_id"]

    def index(batches):
        known = pa.array(sent.value, pa.binary())
        ids, sizes, doc, term, tf, n, m = [], [], [], [], [], 0, 0
        for b in (part for whole in batches for part in slabs(whole, 1, SLAB)):
            kept, at, counts = cut(*bytes_of(b.column(1)), ALNUM, LOWER)
            code = np.array(pc.fill_null(pc.index_in(as_array(kept, at), value_set=known), -1), np.int64)
            some = counts > 0
            place = np.cumsum(some) - 1 + n
            owner = np.repeat(place, counts)
            hit = code >= 0
            pairs, times = np.unique(owner[hit] * len(known) + code[hit], return_counts=True)
            ids.append(b.column(0).filter(pa.array(some)))
            sizes.append(counts[some])
            doc.append(pairs // max(len(known), 1))
            term.append(pairs % max(len(known), 1))
            tf.append(times)
            n, m = n + int(some.sum()), m + len(pairs)
            if n >= SEGMENT_DOCS or m >= SEGMENT_POSTINGS:
                yield _segment(ids, sizes, doc, term, tf)
                ids, sizes, doc, term, tf, n, m = [], [], [], [], [], 0, 0
        if n:
            yield _segment(ids, sizes, doc, term, tf)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(index, SEGMENT.format(kind))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _lengths(sizes: np.ndarray, n: int, words: int) -> np.ndarray:
    """A document's m: 50 and half of its length against the mean, in hundredths."""
    if int(sizes.max()) * 50 * n < 1 << 62:
        return 50 + (50 * sizes * n) // words
    return np.array([50 + (50 * s * n) // words for s in sizes.tolist()], np.int64)


class _Best:
    """A query's best documents of the segments that a task has walked: ids and scores, best first."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, None, np.empty(0, np.int64)

    def floor(self) -> int:
        """A score below which no document can be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        scores = np.concatenate((self.scores, scores))
        order = pc.sort_indices(pa.table({"s": scores, "d": ids}), [("s", "descending"), ("d", "ascending")], null_placement="at_end")[: self.k]
        self.ids, self.scores = ids.take(order), scores[np.array(order)]


def term_at_a_time(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, floor: int) -> tuple[np.ndarray, int]:
    """Scores of a segment's documents from ``lists`` of (documents, contributions), in the order of the terms.

    A document that can't be among the k best, or reach ``floor``, may have a part of its score or none. Returns the
    scores and the number of terms after which no accumulator was created.
    """
    most = [int(c.max()) if len(c) else 0 for _, c in lists]
    rest, score, limit, made = sum(most), np.zeros(docs, np.int64), floor, len(lists)
    for j, (at, c) in enumerate(lists):
        if made == len(lists) and j:
            if rest < limit:
                made = j
            elif rest <= int(score.max()):  # else the k-th partial score can't exceed what is left
                have = score[score > 0]
                if len(have) >= k:
                    limit = max(limit, int(np.partition(have, len(have) - k)[len(have) - k]))
                    made = j if rest < limit else made
        elif made == len(lists) and rest < limit:
            return score, 0
        if made < len(lists):
            mine = score[at] > 0
            score[at[mine]] += c[mine]
        else:
            score[at] += c
        rest -= most[j]
    return score, made


def _walk(segs: DataFrame, queries: list[tuple], kinds: tuple[str, str], weights: list[int], n: int, words: int, k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: each task's best documents of each query, a list of (item_id, numbers of its terms, rarest first)."""
    sent = segs.sparkSession.sparkContext.broadcast((queries, np.array(weights, np.int64)))

    def walk(batches):
        queries, weights = sent.value
        best = [_Best(k) for _ in queries]
        id_kind = None
        for b in batches:
            for r in range(b.num_rows):
                ids, sizes, terms, lists, at, tf = (b.column(i)[r].values for i in range(6))
                id_kind, docs = ids.type, len(ids)
                sizes, terms, lists, at, tf = (np.array(x, np.int64) for x in (sizes, terms, lists, at, tf))
                m = _lengths(sizes, n, words)
                c = np.repeat(weights[terms], lists) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
                ends = np.cumsum(lists)
                where = {t: (at[e - size : e], c[e - size : e]) for t, size, e in zip(terms.tolist(), lists.tolist(), ends.tolist())}
                for q, (_, own) in enumerate(queries):
                    found = [where[t] for t in own if t in where]
                    if not found:
                        continue
                    score, _ = term_at_a_time(found, docs, k, best[q].floor())
                    least = max(best[q].floor(), 1)
                    good = np.flatnonzero(score >= least)
                    if len(good) > k:
                        kth = np.partition(score[good], len(good) - k)[len(good) - k]
                        good = good[score[good] >= kth]
                    if len(good):
                        best[q].add(ids.take(pa.array(good)), score[good])
        for (item, _), x in zip(queries, best):
            if x.ids is not None:
                yield pa.record_batch([pa.array([item] * len(x.scores), item_kind), x.ids, pa.array(x.scores)], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = segs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, doc_id {kinds[1]}, score long").schema
    item_kind = to_arrow_type(schema["item_id"].dataType)
    return segs.mapInArrow(walk, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each query of ``items(item_id, text)``.

    item_id, rank (from 1), doc_id, score (integer, above 0). Terms are runs of ASCII letters, digits and
    all other characters that aren't ASCII, with A-Z lower-cased. Equal scores are ranked by doc_id, a null
    one last; rows with one doc_id are documents of their own. Rows of ``items`` with one item_id (or a
    null one) are one query, each term counts once. Null and empty texts have no terms; a query none of
    whose terms is found has no rows; empty tables give none; other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    terms, terms_path = table(query_terms(items), "query-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found, paths = [], [terms_path]
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # bounded by the number of blocks
        known = sorted({bytes(r["term"]) for r in own})
        number = {t: i for i, t in enumerate(known)}
        with small_batches(spark):
            segs, path = table(segments(docs, known), "segments")
        paths.append(path)
        n, words = segs.agg(F.sum("docs"), F.sum("words")).first()
        if not n or not own:
            continue
        pairs = segs.select(F.explode(F.arrays_zip("terms", "lists")).alias("x")).groupBy("x.terms").agg(F.sum("x.lists").alias("df"))
        df = {r["terms"]: r["df"] for r in pairs.collect()}  # as many as the block has terms
        by_item: dict = {}
        for r in own:
            if (t := number[bytes(r["term"])]) in df:
                by_item.setdefault(r["item_id"], []).append(t)
        queries = [(item, sorted(ts, key=lambda t: (df[t], t))) for item, ts in by_item.items()]
        weights = [weight(n, df[t]) if t in df else 0 for t in range(len(known))]
        with small_batches(spark), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "2"):  # a row is a whole segment
            best, path = table(_walk(segs, queries, kinds, weights, n, words, k), "best")
        found.append(best)
        paths.append(path)
    if not found:
        [delete_path(spark, p) for p in paths]
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    every = every.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("nth") <= k)
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    out, _ = table(every.withColumn("rank", nth).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    [delete_path(spark, p) for p in paths]
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents), t AS (SELECT r, unnest(ts) AS term FROM d),
  tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL), size AS (SELECT r, count(*) AS n FROM t GROUP BY r),
  whole AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM size), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * whole.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
  m AS (SELECT r, 50 + (50 * size.n * whole.n) // whole.l AS m FROM size, whole),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
  n AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT * FROM n WHERE rank <= 50"""

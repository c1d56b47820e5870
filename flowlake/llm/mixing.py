"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's budget ends is found
from the running sums and refined alone, level by level, until the document at the threshold is
known. A document's share then follows from its hash and its source's threshold: no sort of the
documents, and the chosen sets are nested as budgets grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, plain_names, table

HASH_BITS = 60
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; a null text has 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """A 60-bit hash that any SQL engine can repeat: the first 15 hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[float], budget: float, repeats: float) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``: one row per source throughout.

    The weights go by the order of all sources, so these rows (a name and a few numbers each, not the
    documents) are ranked in one window: meant for up to some 10 million sources.

    Sources in code-point order, null last, take the weights in turn and share budget * all sizes;
    a target stops at ``repeats`` times its source's size and what it leaves is shared by weight
    again. That ends where every open source has the same target per weight, which running sums
    over the sources, ordered by the target per weight at which each closes, give directly.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1))
    s = s.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    closed = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(budget)) * F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - closed) / open_weight)
    level = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    return s.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target")
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole rounds, and the hash at which one more round ends.

    ``(source, source_size, target, rounds, edge, room)``: every document is taken ``rounds`` times,
    documents whose hash is under ``edge`` once more, and for those at ``edge`` ``room`` words are
    left. ``sized`` has (source, size, h). A level splits the boundary bucket of the level before
    into 4,096 and reads only the documents in it.
    """
    spark = sized.sparkSession
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    room = F.floor(F.col("target") - F.col("rounds") * F.col("source_size") + F.lit(0.5)).cast("long")
    bounds, path = table(
        goals.withColumn("rounds", rounds).withColumn("room", room).withColumn("edge", F.lit(0).cast("long")), "bounds"
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        b = bounds.select(F.col("source").alias("s"), "room", "edge")
        here = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("edge"))
        cells = (
            sized.select("source", "size", "h").where("size > 0").join(b, here)
            .groupBy("source", "room", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        )
        running = Window.partitionBy("source").orderBy("bucket")
        found = (
            cells.withColumn("before", F.sum("words").over(running) - F.col("words"))
            .where("before <= room")
            .groupBy(F.col("source").alias("s"))
            .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("x"))
        )
        step = bounds.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "rounds",
            (F.col("room") - F.coalesce("x.before", F.lit(0))).alias("room"),
            F.coalesce("x.bucket", F.lit(0)).cast("long").alias("edge"),
        )
        new, new_path = table(step, "bounds")
        delete_path(spark, path)
        bounds, path = new, new_path
    return bounds


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), budget: float = 1.5, repeats: float = 2) -> DataFrame:
    """Words that the mix takes of every row of ``docs(doc_id, text, source)``.

    doc_id, source, size, source_size, target, taken. A document on its source's threshold is taken
    in part, so every source's total is its target rounded to words. A null text has size 0 and
    is taken 0 times; a null source is a source of its own; repeated rows count each; rows with equal
    doc_id share a hash and, on the threshold, the smaller ones go first; an empty table gives no
    rows. The same rows give the same mix in every run and order.
    """
    sized, _ = table(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "sizes"
    )
    bounds = thresholds(sized, targets(sized, list(weights), budget, repeats)).withColumnRenamed("source", "s")
    rows = sized.join(bounds, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.col("rounds") * F.col("size")
    clear = rows.where("h <> edge").withColumn("taken", whole + F.when(F.col("h") < F.col("edge"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = rows.where("h = edge").withColumn("taken", whole + F.greatest(F.lit(0), F.least("size", F.col("room") - before)))
    return clear.unionByName(at_edge).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: list[float] = (5, 2, 1), budget: float = 1.5, repeats: float = 2) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Whole documents only: the one on a threshold is taken if at least half of it fits. The
    texts are not shuffled: a row's count follows from its hash and its source's threshold.
    """
    sized, _ = table(docs.select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "sizes")
    bounds = thresholds(sized, targets(sized, list(weights), budget, repeats)).withColumnRenamed("source", "s")
    d, name = plain_names(docs)
    again = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & (F.col("room") * 2 >= F.col("size")) & (F.col("size") > 0) & (F.col("room") > 0))
    rows = d.withColumn("h", hash_of(F.col(name["doc_id"]))).withColumn("size", size_of(F.col(name["text"])))
    rows = rows.join(bounds, F.col(name["source"]).eqNullSafe(F.col("s")))
    times = F.col("rounds") + F.when(again, 1).otherwise(0)
    taken = rows.where(times > 0).withColumn("again", F.explode(F.expr("sequence(1L, rounds + 2)"))).where(F.col("again") <= times)
    return taken.select(*d.columns).toDF(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, CAST(2.0 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT max(level) FROM l WHERE cap > level * weight) * weight, cap)) AS target
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t
), b AS (SELECT *, CAST(floor(target - rounds * source_size + 0.5) AS BIGINT) AS room FROM r),
o AS (
  SELECT d.*, b.source_size, b.target, b.rounds, b.room,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, room - before)) AS BIGINT) AS taken
FROM o
"""

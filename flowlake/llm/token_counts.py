"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are aggregated by their encoded length into a written table of one row per length;
every answer is a suffix sum over it, so no document is read twice.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import encoder, slabs, tokenizer_text

#: Distinct lengths whose suffix sums one window group adds up.
BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``(n_tokens long)`` of every row's whole text; a null or empty text has length 0."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches):
        enc = encoder(spec.value)
        for b in batches:
            for part in slabs(b, 0):
                yield pa.record_batch([pa.array(enc.encode_all(part.column(0))[1], pa.int64())], names=["n_tokens"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, n_docs)``: one row per distinct length, partially aggregated in every task."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each distinct length, taken as the context limit, what all longer documents hold.

    Blocks of BLOCK neighbouring lengths are summed first, so that no window group holds all
    distinct lengths. An empty histogram gives no rows.
    """
    h = hist.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block")
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    tokens_over = F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return (
        h.join(blocks, "block")
        .select("n_tokens", "n_docs", "tokens", "docs", "all_tokens", over.alias("docs_over"), tokens_over.alias("tokens_over"))
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            F.col("tokens").alias("n_tokens"),
            "docs_over",
            ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("quantile"),
            (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_kept"),
            (F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")).alias("tokens_cut"),
        )
    )


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """One row per distinct encoded length L of ``docs``, read as the context limit L.

    context_limit, n_docs and n_tokens (documents of this length and their tokens), docs_over
    (longer documents), quantile (share of documents of at most this length), tokens_kept and
    tokens_cut (totals when every document is cut after L tokens). Nulls and empty texts count as
    length 0, repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        lengths, _ = table(histogram(encoded_lengths(docs, tokenizer_path, text)), "lengths")
    return suffix_sums(lengths)


def answer(counts: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, tokens_kept, docs_over)`` for any limits, from the rows of ``token_counts``.

    Between two lengths the kept total is linear. Limits under the shortest length keep
    ``limit`` tokens of every document.
    """
    spark = counts.sparkSession
    want = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long"))
    rows = counts.select(F.col("context_limit").alias("length"), F.col("tokens_kept").alias("kept"), F.col("docs_over").alias("over"), "n_docs")
    best = want.join(rows, F.col("length") <= F.col("context_limit"), "left").groupBy("context_limit").agg(
        F.max_by(F.struct("length", "kept", "over"), "length").alias("b")
    )
    total = rows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"))
    return best.join(F.broadcast(total)).select(
        "context_limit",
        F.when(F.col("b.length").isNull(), F.col("context_limit") * F.col("docs"))
        .otherwise(F.col("b.kept") + (F.col("context_limit") - F.col("b.length")) * F.col("b.over"))
        .alias("tokens_kept"),
        F.coalesce("b.over", "docs").alias("docs_over"),
    )


def quantile_length(counts: DataFrame, q: float) -> DataFrame:
    """``(length)``: the smallest length that at least the share ``q`` of the documents doesn't exceed."""
    return counts.where(F.col("quantile") >= F.lit(q)).agg(F.min("context_limit").alias("length"))

"""License scans by diagonal voting, with DataFrame functions only.

Every text's rolling word k-grams are hashed and joined with the k-grams of the license templates (a
table, so of any number and length). A match votes for the diagonal (place in the text minus place
in the template). A base phrase stands where its diagonal has all votes; for the longer templates
neighbouring diagonals merge into spans, which are verified by their coverage and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of public license texts, lower case, in words of letters and digits.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gnu-gpl": "licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram: of short templates and base phrases, and of templates of at least LONG words, whose pairs stand everywhere.
K_SHORT, K_LONG, LONG = 2, 4, 32
#: Share of a template's grams that a span must hold, and how far diagonals may lie apart to merge.
COVERAGE, DRIFT = 0.8, 2


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z.

    ``lower`` differs from that only on letters outside ASCII, which no phrase has; the two of them
    whose lower case holds an ASCII letter take the slower exact way.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.when(t.contains("K") | t.contains("İ"), F.translate(t, upper, low)).otherwise(F.lower(t))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def grams_of(words: str, k: int) -> Column:
    """``array<struct<at, h, g>>``: place and two independent hashes (96 bits) of the k words from each place of the array ``words``."""

    def gram(i: Column) -> Column:
        own = [F.get(words, i + j) for j in range(k)]
        return F.struct(i.alias("at"), F.xxhash64(*own).alias("h"), F.hash(*own).alias("g"))

    places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, gram)


def template_grams(templates: DataFrame) -> DataFrame:
    """All rolling grams of ``templates(label, text, is_base)``: ``(label, text_id, is_base, grams, k, place, h, g)``.

    Templates of fewer than K_SHORT words have none. Several texts may have one label.
    """
    t = templates.select("label", F.xxhash64("label", "text").alias("text_id"), "is_base", words_of(F.col("text")).alias("w"))

    def of(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("label", "text_id", "is_base", (F.size("w") - k + 1).alias("grams"), F.lit(k).alias("k"), F.explode(grams_of("w", k)).alias("x"))

    both = of(t.where(F.size("w") < LONG), K_SHORT).unionByName(of(t.where(F.size("w") >= LONG), K_LONG))
    return both.select("label", "text_id", "is_base", "grams", "k", F.col("x.at").alias("place"), F.col("x.h").alias("th"), F.col("x.g").alias("tg"))


def gram_hits(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Join of all rolling grams of the texts with those of the templates.

    Every text has one row without a label (row, doc_id, n_words), and one row for each hit with the
    template's columns and the place ``at``. Texts aren't carried along, only places and hashes.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    # a text's own row has a key of its own, so such rows don't meet in one task, and no second hash, so it matches nothing
    head = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64("row").alias("h"), F.lit(None).cast("int").alias("g")))
    every = F.concat(head, *(grams_of("w", k) for k in sizes))
    rolled = d.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(every).alias("x")).select("row", "doc_id", "n_words", "x.*")
    same = (F.col("h") == F.col("th")) & (F.col("g") - F.col("tg") == 0)  # the first is the join's key, a single long
    return rolled.join(grams, same, "left").where("label is not null or at < 0").drop("h", "g", "th", "tg")


def diagonals(hits: DataFrame) -> DataFrame:
    """Votes by row, template and diagonal: ``(row, label, text_id, is_base, grams, k, diagonal, places, votes, first_at, last_at)``."""
    keys = ("row", "label", "text_id", "is_base", "grams", "k")
    return hits.where("label is not null").groupBy(*keys, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    ).withColumn("votes", F.size("places").cast("long"))


def spans(votes: DataFrame, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """Verified spans of the templates: ``(row, label, start, end, score)``, words from start to end exclusive.

    Diagonals of one template merge when they lie at most ``drift`` apart (words put in or left out
    between them). A diagonal is the template's place in the text, so those lie within a template's
    length of each other, and hits elsewhere don't come between them. Diagonals that together are
    much longer than the template stand alone. A span counts if its votes, each place of the
    template once, cover enough of the template and it isn't much longer than the template.
    """
    order = Window.partitionBy("row", "text_id").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > drift
    island = F.sum(F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).over(order)
    whole = Window.partitionBy("row", "text_id", "island")
    most = 2 * F.col("grams") + F.col("k")
    long_ = F.max("last_at").over(whole) + F.col("k") - F.min("first_at").over(whole) > most
    merged = (
        votes.where("not is_base").withColumn("island", island).withColumn("alone", F.when(long_, F.col("diagonal")))
        .select("row", "label", "text_id", "grams", "k", "island", "alone", "first_at", "last_at", F.explode("places").alias("place"))
        .groupBy("row", "label", "text_id", "grams", "k", "island", "alone")
        .agg(F.count_distinct("place").alias("votes"), F.min("first_at").alias("start"), (F.max("last_at") + F.col("k")).alias("end"))
    )
    score = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    return merged.withColumn("score", score).where((F.col("score") >= coverage) & (F.col("end") - F.col("start") <= most)).select(
        "row", "label", "start", "end", "score"
    )


def as_table(spark: SparkSession, phrases: dict[str, str], is_base: bool) -> DataFrame:
    """``(label, text, is_base)`` of label -> text."""
    return spark.createDataFrame([(k, v, is_base) for k, v in phrases.items()], "label string, text string, is_base boolean")


def license_scan(docs: DataFrame, templates: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``; ``templates``: a table (label, text) or a small map, else TEMPLATES.

    doc_id, n_words, n_base (places of all base phrases), first_word and last_word (their smallest
    and largest start, else null), base_labels, labels (with the templates' labels; distinct,
    sorted, comma-joined, empty string for none), score (1 for a base phrase, else the best verified
    span's coverage, else 0). Null and empty texts have no words; repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = as_table(spark, TEMPLATES if templates is None else templates, False)
    own = templates.where("label is not null and text is not null").select("label", "text", F.lit(False).alias("is_base"))
    grams, _ = table(template_grams(as_table(spark, {v: k for k, v in BASE.items()}, True).unionByName(own)), "grams")
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect())  # one or two
    hits, _ = table(gram_hits(docs, grams, sizes), "gram-hits")
    votes, _ = table(diagonals(hits), "votes")
    base = votes.where("is_base and votes = grams").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("first_at").cast("long").alias("first_word"), F.max("first_at").cast("long").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base_set"),
    )
    more = spans(votes).groupBy("row").agg(F.collect_set("label").alias("more_set"), F.max("score").alias("best"))
    found = base.join(more, "row", "full")
    none = F.array().cast("array<string>")
    return hits.where("label is null").select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base_set", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("more_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

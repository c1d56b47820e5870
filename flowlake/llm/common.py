"""Shared helpers: tables in the cluster's shared folder and distributed connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/flowlake-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Arrow batches that carry whole texts or sets: Spark's defaults (10,000 rows, 64 MB), and what replaces them.
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowlake/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    return table(df, name, codec)[0]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting ``key`` while a block runs; then what it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lower_batches(spark: SparkSession) -> None:
    """``small_batches`` from now on, for lazy results."""
    for key, (default, low) in BATCH_LIMITS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, low)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lowers the session's limits of Arrow batches while a block runs, where they stand at Spark's defaults.

    A batch is held several times at once, in the executor and in its Python worker.
    """
    with ExitStack() as stack:
        for key, (default, low) in BATCH_LIMITS.items():
            if spark.conf.get(key) == default:
                stack.enter_context(setting(spark, key, low))
        yield


#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``written``, and the table's path, for ``delete_path``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEAN_UP, "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., and the new name of each: no column of a table clashes with those of a plan."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def row_hash(*cols: str):
    """A 64-bit hash as a decimal, so that sums over many rows don't overflow."""
    return F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` -> ``(node long, component long)``, component = smallest node.

    Alternates large-star and small-star steps until the edge table no longer changes; every
    step is a partially aggregated minimum and a join, and every round is a written table.
    Self links, null ends and repeated links are ignored. Nodes without a link don't appear.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, path = table(e, "links")
    seen = e.agg(F.count(F.lit(1)), row_hash("u", "v")).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u is linked with the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked with the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new, new_path = table(small, "links")
        now = new.agg(F.count(F.lit(1)), row_hash("u", "v")).first()
        delete_path(spark, path)
        e, path, before, seen = new, new_path, seen, now
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

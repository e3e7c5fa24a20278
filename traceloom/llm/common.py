"""Shared pieces: tables written to the cluster's shared folder, connected components, crc32 folds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. On one machine that names none (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _OWN_DIR[0]


def written(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (a folder for each value of ``by``, its last columns): lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are over: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` returned, once nothing will read it again."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: columns ``a`` and ``b`` (long), any direction, repeats and loops allowed.
    Returns ``node``, ``component`` (smallest node reachable) for every node that has an edge to
    another one. Each round is two aggregations and two joins over the edges, written to the shared
    folder; the number of rounds grows with the logarithm of the largest component. A hub is a
    skewed join key that adaptive execution splits; its minimum is pre-aggregated map-side.
    """
    now = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc-edges",
    )
    mark = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node goes to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        then = written(small, "cc-edges")
        seen = then.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
        ).first()
        discard(now)
        now = then
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id reads as -1."""
    return F.crc32(F.coalesce(F.col(column).cast("long"), F.lit(-1)).cast("string").cast("binary")) % folds


LONG, STRING, DOUBLE = T.LongType(), T.StringType(), T.DoubleType()


def schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (null reads as -1), text (null reads as empty) and the columns named; no other column is read."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(df: DataFrame, key: str, by: str, each: int, seed: int = 7) -> DataFrame:
    """About ``each`` rows for each value of ``by`` (all where it has fewer), chosen by a hash of ``key``."""
    share = df.groupBy(by).agg((F.lit(float(each)) / F.count(F.lit(1))).alias("_share"))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(share, by).where(unit < F.col("_share")).drop("_share")

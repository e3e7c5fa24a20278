"""Repeatable order, ranks and samples that no single task has to sort whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.shared import table_in_shared


def seeded(seed: str, *keys: str) -> Column:
    """md5 of seed and keys: an order that is random to the eye and the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def seeded_unit(seed: str, *keys: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of ``seeded``."""
    return (F.conv(F.substring(seeded(seed, *keys), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def global_row_number(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """``df`` with ``rn``: row numbers from 1 by ``key``, then ``ties``, nulls first.

    ``df`` is computed once and written; ranges of its keys, as many as shuffle partitions, are drawn from a sample of
    that, each is sorted in a task of its own, and the ranges before it give where its numbers start. Name
    ties where a key may stand in a large part of the rows.
    """
    once = table_in_shared(df, "unordered")
    ranges = once.repartitionByRange(key, *ties).sortWithinPartitions(key, *ties)
    placed = table_in_shared(ranges.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = placed.withColumn("_range", F.shiftright("_at", 33))  # the id's upper bits: the task; the lower ones: the row in it
    counts = rows.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # a row for each range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return rows.join(F.broadcast(before), "_range").withColumn("rn", place.cast("long")).drop("_at", "_range", "_before")


def first_n(df: DataFrame, by: list[str], order: list, n: int | Column) -> DataFrame:
    """At most ``n`` rows of each group, in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key: the last in order. Pass ``F.desc`` columns in ``order`` to put the newest first."""
    return first_n(df, [key], order, 1)

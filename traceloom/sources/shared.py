"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; on one machine, in a folder of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = _OWN[0]
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def table_in_shared(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read again: lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

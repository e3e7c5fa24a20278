"""Queries of the streaming forms (X1-X3): each streams files that Spark writes from ``events`` and returns what arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators.text import enriched
from traceloom.plans.registry import ORACLES, query, table
from traceloom.plans import traces  # noqa: F401  registers the SQL that x3 shares
from traceloom.sources.shared import scratch, table_in_shared
from traceloom.streaming import incremental as op


def _score(props: str) -> str:
    if props.endswith("0}"):
        raise ValueError("round")
    return props.upper()


@query(
    "x1_incremental_enrichment",
    "select event_id, case when props not like '%0}' then upper(props) end as reply, case when props like '%0}' then 'ValueError: round' end as error from events",
)
def x1(spark, sf_dir):
    path, rows = scratch(spark, "x1"), table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "props")
    rows.write.json(f"{path}/in")
    rows.where("event_id % 3 = 0").write.mode("append").json(f"{path}/in")  # seen again: counts once
    source = spark.readStream.schema("event_id long, ts timestamp, props string").option("maxFilesPerTrigger", 100).json(f"{path}/in")
    op.enrich_new_files(source, "event_id", lambda df: enriched(df, _score, "event_id", "props", lambda t: table_in_shared(t, "x1")), f"{path}/good", f"{path}/bad", f"{path}/state", "ts", "400 days").awaitTermination()
    good, bad = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("good", "event_id long, reply string"), ("bad", "event_id long, error string")))
    return good.unionByName(bad, allowMissingColumns=True).select("event_id", "reply", "error")


@query("x2_windowed_counts", "select strftime(ts, '%Y-%m-%d') as start, event_type, count(*)::bigint as n from events group by all")
def x2(spark, sf_dir):
    path, rows = scratch(spark, "x2"), table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(f"{path}/in")
    counts = op.windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "ts", ["event_type"], "1 day", "10 days")
    op.write_updates(counts, f"{path}/out", f"{path}/state").awaitTermination()
    updates = spark.read.parquet(f"{path}/out")
    return op.latest(updates, ["start", "event_type"], "batch", ["n"]).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("x3_live_open_goals", ORACLES["p18_open_goals"])
def x3(spark, sf_dir):
    path = scratch(spark, "x3")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    files = spark.sparkContext.defaultParallelism  # a batch's, each of events from all times; three batches
    rows.repartition(3 * files, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    goals = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    op.write_updates(op.live_open_goals(stream, "user_id", "event_id", goals, "ts", "400 days"), f"{path}/out", f"{path}/state").awaitTermination()
    return op.latest(spark.read.parquet(f"{path}/out"), ["user_id"], "batch", ["left_open"])

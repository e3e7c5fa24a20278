"""Training-pair preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proofs(definitions: DataFrame, episodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(definitions with their episode, definitions without one)."""
    return definitions.join(episodes, key), definitions.join(episodes.select(key).distinct(), key, "left_anti")


def open_steps(steps: DataFrame, logged: DataFrame) -> DataFrame:
    """steps (episode, i, n) past what is logged (episode, i). An episode whose log has a gap is an error."""
    done = logged.groupBy("episode").agg(F.count_distinct("i").alias("_done"), F.max("i").alias("_max"))
    gap = F.when(F.col("_done") != F.col("_max"), F.raise_error(F.concat(F.lit("gap in the log of "), F.col("episode").cast("string"))).cast("long")).otherwise(F.col("_done"))
    out = steps.join(done, "episode", "left").withColumn("_from", F.coalesce(gap, F.lit(0)))
    return out.where(F.col("i") > F.col("_from")).drop("_done", "_max", "_from")


def with_history(steps: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """adds ``history``: the values of all earlier steps, the step itself left out."""
    over = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("history", F.collect_list(value).over(over))


def with_notes(steps: DataFrame, by: str, order: str, note: Column) -> DataFrame:
    """adds ``notes``: the notes up to and with the step, a line each."""
    over = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("notes", F.array_join(F.collect_list(note).over(over), "\n"))


def pairs(df: DataFrame, condensed: bool = False) -> DataFrame:
    """prompt and target."""
    return df.select(F.col("prompt_reorganize" if condensed else "prompt").alias("prompt"), F.col("tactic").alias("target"))


def fitted(prompt: Column, target: Column, most: int, target_most: int = 250) -> tuple[Column, Column]:
    """token arrays: the target cut at ``target_most``; the prompt's middle goes so that both and two marks fit ``most``."""
    cut = F.slice(target, F.lit(1), F.least(F.size(target), F.lit(target_most)))
    room = F.greatest(F.lit(most - 2) - F.size(cut), F.lit(0))
    head = F.floor(room / 2).cast("int")
    tail = (room - head).cast("int")
    short = F.concat(F.slice(prompt, F.lit(1), head), F.slice(prompt, F.greatest(F.size(prompt) - tail + 1, F.lit(1)), tail))
    return F.when(F.size(prompt) > room, short).otherwise(prompt), cut


def long_share(df: DataFrame, target: Column, most: int = 250) -> DataFrame:
    """``share`` of targets longer than ``most`` tokens."""
    return df.agg(F.avg((F.size(target) > most).cast("double")).alias("share"))


def sequences(df: DataFrame, batch: str, prompt: str, target: str, most: int, bos: int = 1, eos: int = 2, pad: int = 0) -> DataFrame:
    """F8: adds ids (bos, prompt, target, eos), mask (ones) and labels (-100 over bos and prompt), padded right to the batch's longest, ``most`` at most."""
    ids = F.slice(F.concat(F.array(F.lit(bos)), F.col(prompt), F.col(target), F.array(F.lit(eos))), 1, most)
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt) + 1), F.col(target), F.array(F.lit(eos))), 1, most)
    out = df.withColumns({"_ids": ids, "_labels": labels})
    longest = F.max(F.size("_ids")).over(Window.partitionBy(batch))
    out = out.withColumn("_gap", longest - F.size("_ids"))
    return out.select(
        *df.columns,
        F.concat("_ids", F.array_repeat(F.lit(pad), F.col("_gap"))).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), F.col("_gap"))).alias("mask"),
        F.concat("_labels", F.array_repeat(F.lit(-100), F.col("_gap"))).alias("labels"),
    )


def whitened(df: DataFrame, value: str, mask: Column | None = None) -> DataFrame:
    """adds ``white``: (value - mean) / sqrt(variance + 1e-6) over the masked rows."""
    x = F.col(value) if mask is None else F.when(mask, F.col(value))
    stats = df.agg(F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))  # one row
    return df.join(F.broadcast(stats), how="cross").withColumn("white", (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-6)).drop("_m", "_v")


def log_softmax(df: DataFrame, by: str, score: str) -> DataFrame:
    """adds ``logp`` within each group."""
    over = Window.partitionBy(by)
    top = F.max(score).over(over)
    return df.withColumn("_e", F.col(score) - top).withColumn("logp", F.col("_e") - F.log(F.sum(F.exp("_e")).over(over))).drop("_e")


def group_entropy(df: DataFrame, by: str) -> DataFrame:
    """entropy of each group's ``logp``."""
    return df.groupBy(by).agg((-F.sum(F.exp("logp") * F.col("logp"))).alias("entropy"))


def nucleus(df: DataFrame, by: str, item: str, prob: str, top_p: float, least: int = 1) -> DataFrame:
    """the likeliest items until their sum reaches ``top_p``, ``least`` at least; adds ``p``, renormalised."""
    over = Window.partitionBy(by).orderBy(F.desc(prob), item)
    before = F.sum(prob).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col(prob)
    kept = df.withColumns({"_b": before, "_r": F.row_number().over(over)}).where((F.col("_b") < top_p) | (F.col("_r") <= least))
    return kept.withColumn("p", F.col(prob) / F.sum(prob).over(Window.partitionBy(by))).drop("_b", "_r")


def perplexity(df: DataFrame, loss: str, *by: str) -> DataFrame:
    """mean loss and its exponential."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.exp(F.avg(loss)).alias("perplexity"))

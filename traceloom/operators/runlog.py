"""Run-log and search-table analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.ordering import first_n, seeded


def pruned_layer(df: DataFrame, by: list[str], width: int, order: list) -> DataFrame:
    """B1: at most ``width`` candidates of each episode and depth, by choice or seeded order."""
    return first_n(df, by, order, width)


def group_outcome(df: DataFrame, by: str, order: str) -> DataFrame:
    """B2: winner (order of the first COMPLETED or SUBCOM row, if any), status, all_success (no FAIL, where nobody won), n.

    Null statuses are ignored.
    """
    live = df.where("status is not null")
    won = F.col("status").isin("COMPLETED", "SUBCOM")
    return live.groupBy(by).agg(
        F.min(F.when(won, F.col(order))).alias("winner"),
        F.min_by(F.when(won, F.col("status")), F.when(won, F.col(order))).alias("status"),
        F.bool_and(F.col("status") != "FAIL").alias("all_success"),
        F.count("*").alias("n"),
    )


def merged_outcome(groups: DataFrame, retries: DataFrame, by: str, order: str) -> DataFrame:
    """B2 over a group and its retries, which come later in order."""
    shifted = retries.withColumn(order, F.col(order) + F.lit(1 << 40))
    return group_outcome(groups.unionByName(shifted), by, order)


def try_outcome(before: Column, after: Column, error: Column) -> Column:
    """From the goals before and after a try, and its error text."""
    return (
        F.when(error.isNotNull() & (error != ""), "FAIL").when(after == 0, "COMPLETED").when(after < before, "SUBCOM")
        .when(after == before, "NO_CHANGE").otherwise("SUCCESS")
    )


def node_paths(df: DataFrame, by: str, order: str, parent: Column, goals: Column) -> DataFrame:
    """Adds ``node``: ``parent@i``; where a try leaves n > 1 goals, ``parent@i-1/n``."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(order))
    base = F.concat(parent, F.lit("@"), i)
    return df.withColumn("node", F.when(goals > 1, F.concat(base, F.lit("-1/"), goals)).otherwise(base))


def popped(remaining: Column) -> Column:
    """An array of arrays less the first of its last entry; an entry left empty goes."""
    last = F.try_element_at(remaining, F.lit(-1))
    front = F.slice(remaining, F.lit(1), F.greatest(F.size(remaining) - 1, F.lit(0)))
    rest = F.slice(last, F.lit(2), F.greatest(F.size(last) - 1, F.lit(0)))
    return F.when(F.size(remaining) == 0, remaining).when(F.size(rest) > 0, F.concat(front, F.array(rest))).otherwise(front)


def updated_notes(df: DataFrame, by: str, most: int, seed: str) -> DataFrame:
    """``notes`` less ``remove`` (places from 0; bad ones ignored) and with ``add``; over ``most`` a seeded choice stays, in order."""
    kept = F.filter("notes", lambda x, i: ~F.array_contains("remove", i))
    each = df.select(by, F.posexplode(F.concat(kept, F.coalesce("add", F.array()))).alias("at", "note")).withColumn("_o", seeded(seed, by, "at"))
    chosen = first_n(each, [by], ["_o", "at"], most)
    ordered = F.sort_array(F.collect_list(F.struct("at", "note")))
    full = chosen.groupBy(by).agg(F.transform(ordered, lambda x: x["note"]).alias("notes"))
    return df.select(by).join(full, by, "left").withColumn("notes", F.coalesce("notes", F.array()))


def note_candidate(traces: Column, template: str) -> Column:
    """The template around a node's last trace."""
    return F.format_string(template, F.try_element_at(traces, F.lit(-1)))


def flattened_log(lines: DataFrame, text: str, key: str) -> DataFrame:
    """(key, path, node, status, depth) of each node of log lines ``{path: {"items_info": {node: {...}}}}``, successes first."""
    kind = "map<string, struct<items_info: map<string, struct<status: string, depth: long>>>>"
    each = lines.select(key, F.explode(F.from_json(text, kind)).alias("path", "entry")).select(key, "path", F.explode("entry.items_info").alias("node", "info"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.lower("info.status") == "success", 0).otherwise(1), "path", "node"))
    return each.select(key, "path", "node", "info.status", "info.depth", rank.cast("long").alias("ord"))


def outcome_records(lines: DataFrame) -> DataFrame:
    """File, status, name, log_file, depth: a status line and the keyed lines after it, in any order; truncated ones go."""
    status = F.regexp_extract("line", r"^(SUCCEEDED|FAILED): (\S+)", 1)
    over = Window.partitionBy("file").orderBy("line_no")
    each = lines.withColumn("_rec", F.sum(F.when(status != "", 1).otherwise(0)).over(over)).where("_rec > 0")
    value = lambda pattern: F.max(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    out = each.groupBy("file", "_rec").agg(
        F.max(F.nullif(status, F.lit(""))).alias("status"), value(r"^(?:SUCCEEDED|FAILED): (\S+)").alias("name"),
        value(r"^log_file: (.+)$").alias("log_file"), value(r"^depth: (\d+)").cast("long").alias("depth"),
    )
    return out.where("log_file is not null and depth is not null").drop("_rec")


def resumed(work: DataFrame, log: DataFrame, key: str, failed_only: bool = False) -> DataFrame:
    """Work without log rows, or the work whose last word is a failure."""
    if failed_only:
        ended = log.groupBy(key).agg(F.bool_or(F.col("status") == "SUCCEEDED").alias("_ok")).where("not _ok")
        return work.join(ended.select(key), key, "left_semi")
    return work.join(log.select(key).distinct(), key, "left_anti")


def stratified(df: DataFrame, key: str, n: int, most_depth: int, seed: str, step: int = 2) -> DataFrame:
    """``n`` seeded rows of each status and depth up to ``most_depth``; a short stratum is topped up from depth + ``step``.

    Adds ``stratum``: the depth that a row counts for.
    """
    by, o = ["_null", "_status", "depth"], seeded(seed, key)  # a null status is one of its own
    named = df.withColumns({"_null": F.col("status").isNull(), "_status": F.coalesce("status", F.lit(""))})
    keyed = named.withColumn("_o", o).withColumn("_b", F.conv(F.substring("_o", 1, 5), 16, 10).cast("int"))
    # how many rows of each stratum count: its own, and what the one above it lacks; a histogram of their order's first digits says up to where
    bars = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    totals = bars.groupBy(*by).agg(F.sum("_n").alias("_total"))
    lack = totals.where((F.col("depth") <= most_depth) & (F.col("_total") < n)).select("_null", "_status", (F.col("depth") + step).alias("depth"), (n - F.col("_total")).alias("_lack"))
    own = F.when(F.col("depth") <= most_depth, n).otherwise(0)
    quota = totals.join(lack, by, "left").select(*by, own.alias("_own"), F.coalesce("_lack", F.lit(0)).alias("_lack"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")
    cut = bars.withColumn("_before", before).join(quota, by).where(F.col("_before") < F.col("_own") + F.col("_lack")).groupBy(*by, "_own", "_lack").agg(F.max("_b").alias("_cut"))
    few = keyed.join(F.broadcast(cut), by).where(F.col("_b") <= F.col("_cut"))  # a row for each stratum
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_o", key)))
    stratum = F.when(F.col("_r") <= F.col("_own"), F.col("depth")).when(F.col("_r") <= F.col("_own") + F.col("_lack"), F.col("depth") - step)
    return ranked.withColumn("stratum", stratum).where("stratum is not null").select(*df.columns, "stratum")


def prompt_at_depth(nodes: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """The first node at each episode's search depth (d - 2 where d > 4), with its tactics less the last."""
    depth = F.when(F.col("depth") > 4, F.col("depth") - 2).otherwise(F.col("depth"))
    at = wanted.select(by, depth.alias("depth"))
    first = nodes.join(at, [by, "depth"]).groupBy(by, "depth").agg(F.min_by("tactics", "ord").alias("tactics"), F.min("ord").alias("ord"))
    return first.withColumn("tactics", F.slice("tactics", F.lit(1), F.greatest(F.size("tactics") - 1, F.lit(0))))


def prompt_sample(df: DataFrame, keys: list[str], n: int, seed: str) -> DataFrame:
    """A seeded sample of at most ``n`` rows."""
    return df.withColumn("_o", seeded(seed, *keys)).orderBy("_o", *keys).limit(n).drop("_o")


def plain_prompt(text: Column, marker: str, suffix: str, old: str, new: str) -> Column:
    """The text before ``marker``, without lines that hold ``## Internal``, a request swapped, a suffix added."""
    lines = F.filter(F.split(F.substring_index(text, marker, 1), "\n"), lambda x: ~x.contains("## Internal"))
    return F.concat(F.replace(F.array_join(lines, "\n"), F.lit(old), F.lit(new)), F.lit(suffix))

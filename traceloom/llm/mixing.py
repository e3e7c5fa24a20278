"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). Weights propagate from the root; a child never gets more than
its subtree holds (``epochs`` passes over it), and what it cannot use goes to its siblings before it
goes up. A leaf takes whole epochs and then a token-prefix of one more epoch in that epoch's seeded
order. The prefix's end is found from sums over hash buckets, so no leaf is ever sorted whole, and
rows are picked by comparing a hash with a small table: texts are not shuffled.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"


def share_out(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """``budget`` split by ``weights``, no part above its ``room``; what is over goes to parts with room left."""
    got = [0] * len(room)
    live = [i for i in range(len(room)) if weights[i] > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in live))
    while left > 0 and live:
        total = sum(weights[i] for i in live)
        full = [i for i in live if room[i] - got[i] <= left * weights[i] / total]
        if full:
            for i in full:
                left -= room[i] - got[i]
                got[i] = room[i]
            live = [i for i in live if i not in full]
            continue
        part = {i: int(left * weights[i] / total) for i in live}
        rest = left - sum(part.values())
        for i in live:
            more = 1 if rest > 0 and got[i] + part[i] < room[i] else 0
            got[i] += part[i] + more
            rest -= more
        break
    return got


def budgets(leaves: dict[tuple, int], total: int, weights: dict[tuple, float], epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. ``leaves``: path -> tokens there; ``weights``: path of any node -> weight.

    Children without a weight share by tokens: together they weigh, of all there, what their subtrees hold, and those
    with weights split the rest by them. A weight of 0 shuts its subtree out; no node is granted what it can't use.
    """
    below: dict[tuple, set] = defaultdict(set)
    for path in leaves:
        for k in range(1, len(path) + 1):
            below[path[: k - 1]].add(path[:k])
    held = {p: tokens * epochs for p, tokens in leaves.items()}  # what a subtree can use
    for node in sorted(below, key=len, reverse=True):
        held[node] = sum(held[c] for c in below[node] if weights.get(c) != 0)
    held.setdefault((), 0)
    given = {(): min(total, held[()])}
    for depth in range(max((len(p) for p in leaves), default=0)):
        for node in [n for n in list(given) if len(n) == depth and n in below]:
            children = sorted(below[node])
            named = {c: weights[c] for c in children if weights.get(c) is not None and held[c] > 0}
            whole = sum(named.values())
            part = sum(held[c] for c in named if named[c] > 0) / whole if whole > 0 else 0.0  # tokens a unit of weight
            own = [named[c] * part if c in named else 0.0 if c in weights else float(held[c]) for c in children]
            parts = share_out(given[node], own, [held[c] for c in children])
            given |= dict(zip(children, parts))
    return {p: given.get(p, 0) for p in leaves}


def domain_of_source() -> Column:
    """The leading letters of the source's name."""
    return F.regexp_extract(F.col("source"), r"^([A-Za-z]*)", 1)


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], total: int | None = None, epochs: int = 4, seed: int = 17, buckets: int = 1024, most_leaves: int = 100_000) -> DataFrame:
    """The rows picked, once for each epoch they are in: all columns of ``docs`` and _domain, _tokens, _epoch.

    ``weights``: of languages and of sources, by name; those without any are weighted by their tokens.
    ``total``: tokens wanted, all there are if None. Tokens are words. A null language or source is a leaf
    of its own, "(none)", and a null text has no tokens; a text without tokens goes with the prefix it falls in.
    A null doc_id reads as -1. Rows of a leaf with equal ids stand together: all or none of them end a prefix. Texts
    are counted whole, however long. An empty table gives an empty one. Columns of ``docs`` may have any names: an
    added one that is taken gets underscores before it. A language without a weight beside ones that have some
    keeps the share its tokens have.
    The tree reaches the driver and, with its budgets, every task: more than ``most_leaves`` leaves are an error.
    """
    spark = docs.sparkSession
    names = docs.columns
    added = [free_name(docs, n) for n in ("_domain", "_tokens", "_epoch")]
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"),  # so that no name of theirs meets one of ours
        F.coalesce(F.nullif(domain_of_source(), F.lit("")), F.lit(NONE)).alias("_domain"),
        F.coalesce("lang", F.lit(NONE)).alias("_lang"),
        F.coalesce("source", F.lit(NONE)).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
    )
    leaf = ["_domain", "_lang", "_source"]
    sums = keyed.groupBy(leaf).agg(F.sum("_tokens").alias("t")).limit(most_leaves + 1).collect()  # a row for each leaf of the tree
    if len(sums) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves: group sources first")
    held = {(r._domain, r._lang, r._source): int(r.t) for r in sums}
    if not held:
        return _unpacked(keyed.withColumn("_epoch", F.lit(0)), names, added)
    by_path: dict[tuple, float] = {}
    for d, lang, source in held:
        by_path[d,] = weights.get("domain", {}).get(d)
        by_path[d, lang] = weights.get("lang", {}).get(lang)
        by_path[d, lang, source] = weights.get("source", {}).get(source)
    wanted = budgets(held, sum(held.values()) if total is None else total, {k: v for k, v in by_path.items() if v is not None}, epochs)
    plan = [(*p, *(divmod(wanted[p], t) if t else (0, 0))) for p, t in held.items()]
    plan = spark.createDataFrame(plan, "_domain string, _lang string, _source string, _whole long, _rest long")

    buckets = max(buckets, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    planned = keyed.join(F.broadcast(plan), leaf).withColumn("_order", F.xxhash64(F.lit(seed), "_whole", "_id")).withColumn(
        "_bucket", F.pmod(F.floor(F.col("_order") / float(2**64 // buckets)) + buckets // 2, F.lit(buckets)).cast("int")
    )
    slim = planned.select(*leaf, "_rest", "_order", "_bucket", "_id", "_tokens")
    filled = slim.groupBy(*leaf, "_rest", "_bucket").agg(F.sum("_tokens").alias("t"))
    until = F.sum("t").over(Window.partitionBy(leaf).orderBy("_bucket"))
    edge = (
        filled.withColumn("_until", until).where(F.col("_until") > F.col("_rest"))
        .groupBy(leaf).agg(F.min("_bucket").alias("_edge"), F.min(F.col("_until") - F.col("t")).alias("_before"))
    )
    at_edge = slim.join(F.broadcast(edge), leaf).where(F.col("_bucket") == F.col("_edge"))
    so_far = F.sum("_tokens").over(Window.partitionBy(leaf).orderBy("_order", "_id"))  # equal rows go together
    last = (
        at_edge.withColumn("_sum", so_far + F.col("_before")).where(F.col("_sum") <= F.col("_rest"))
        .groupBy(leaf).agg(F.max(F.struct("_order", "_id")).alias("_last"))
    )
    ends = edge.join(last, leaf, "left").select(*leaf, "_edge", "_last")
    inside = (
        F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge"))
        | ((F.col("_bucket") == F.col("_edge")) & F.coalesce(F.struct("_order", "_id") <= F.col("_last"), F.lit(False)))
    )
    copies = F.col("_whole") + F.when((F.col("_rest") > 0) & inside, 1).otherwise(0)
    picked = planned.join(F.broadcast(ends), leaf, "left").withColumn("_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int")))))
    return _unpacked(picked, names, added)


def _unpacked(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    return df.select(*(F.col("_row").getField(c).alias(c) for c in names), *(F.col(o).alias(n) for o, n in zip(("_domain", "_tokens", "_epoch"), added)))

"""Retrieval, candidate building and sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.ordering import first_n, global_row_number, seeded, seeded_unit


def split_kinds(vectors: DataFrame, is_tactic: Column) -> tuple[DataFrame, DataFrame]:
    """(tactics, premises)."""
    return vectors.where(is_tactic), vectors.where(~is_tactic)


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _best_of_cell(k: int):
    """Of a cell of the grid: the ``k`` best vectors for each query, ties by name."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "name": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("name", ignore_index=True)
            q, v = np.stack(queries["v"]).astype(np.float64), np.stack(vectors["v"]).astype(np.float64)
            names = vectors["name"].to_numpy()
            for lo in range(0, len(q), 256):  # a product of a few megabytes at a time
                near = q[lo : lo + 256] @ v.T
                # the product's last digits depend on the order of its sums: what may be among the best is added up again, in order
                least = np.partition(near, -k, axis=1)[:, -k] if len(v) > k else near.min(axis=1)
                slack = 1e-9 * (np.abs(q[lo : lo + 256]).sum(axis=1) * np.abs(v).max(initial=0) + 1)
                for i, query in enumerate(queries["query"].iloc[lo : lo + 256]):
                    rows = np.flatnonzero(near[i] >= least[i] - slack[i])
                    score = 100 * np.concatenate([np.add.accumulate(v[part] * q[lo + i], axis=1)[:, -1] for part in np.array_split(rows, len(rows) // 4096 + 1)])
                    best = np.lexsort([rows, -score])[:k]
                    out["query"] += [query] * len(best)
                    out["name"] += names[rows[best]].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame({"query": np.array(out["query"], queries["query"].dtype), "name": np.array(out["name"], vectors["name"].dtype), "score": np.array(out["score"], float)})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """R2: query, name, score (100 times the dot product), rank: the ``k`` best of ``vectors`` for each query, ties by name.

    ``queries``: query, v. ``vectors``: name, v, all of one length and without nulls. Both are cut by hash into blocks of about ``block`` rows; every
    block of queries meets every block of vectors in a task's group of its own, as a matrix product, and only ``k`` rows
    a query leave it. One scan of each table whatever their sizes; names in ``queries`` are distinct.
    """
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    q = queries.select("query", "v", _block("query", n_q).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("_v"))
    v = vectors.select("name", "v", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("_q"), _block("name", n_v).alias("_v"))
    kinds = f"query {dict(queries.dtypes)['query']}, name {dict(vectors.dtypes)['name']}, score double"
    met = q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInPandas(_best_of_cell(k), kinds)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_k_of_both(queries: DataFrame, premises: DataFrame, tactics: DataFrame, k: int) -> DataFrame:
    """``k`` premises and ``k // 2`` tactics for each query."""
    a = top_k(queries, premises, k).withColumn("kind", F.lit("premise"))
    return a.unionByName(top_k(queries, tactics, k // 2).withColumn("kind", F.lit("tactic")))


def explained(names: DataFrame, premises: DataFrame, tactics: DataFrame) -> DataFrame:
    """Adds ``explanation``: the premise's, else the tactic's, else empty."""
    p = premises.select("name", F.col("explanation").alias("_p"))
    t = tactics.select("name", F.col("explanation").alias("_t"))
    out = names.join(p, "name", "left").join(t, "name", "left")
    return out.withColumn("explanation", F.coalesce("_p", "_t", F.lit(""))).drop("_p", "_t")


def context(ranked: DataFrame, items: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Ranked rows with their item's text, less the item at work and Primitive ones: fewer than k may be left.

    ``current``: query, current (the item at work, else the query itself). Its name less what follows its last ``_`` goes too.
    """
    named = ranked.withColumn("_current", F.col("query").cast("string")) if current is None else ranked.join(current.select("query", F.col("current").alias("_current")), "query", "left")
    name, last = F.col("name").cast("string"), F.substring_index("_current", "_", -1)
    whole = F.when(F.col("_current").contains("_"), F.left("_current", F.length("_current") - F.length(last) - 1)).otherwise(F.col("_current"))
    kept = named.where(F.col("_current").isNull() | ((name != F.col("_current")) & (name != whole))).drop("_current")
    return kept.join(items.select("name", "kind", "text"), "name").where("kind != 'Primitive'")


def citing_steps(tokens: DataFrame, start: int, theorems: DataFrame) -> DataFrame:
    """Distinct (episode, step) with a token of id >= ``start`` whose name is dotted, in known theorems."""
    hit = tokens.where((F.col("id") >= start) & F.col("name").contains("."))
    return hit.join(theorems.select("episode").distinct(), "episode", "left_semi").select("episode", "step").distinct()


def multiple_choice(ranked: DataFrame, gold: DataFrame, seed: str, items: DataFrame | None = None, skipped: tuple[str, ...] = ("Primitive", "Ltac")) -> DataFrame:
    """Query, choices (names in seeded order), gold_at (from 0), cards. The gold name joins the nearest if it is not there.

    ``cards`` are lines ``ID i: text`` with the places of the choices; with ``items`` (name, kind, text) those of ``skipped`` kinds have no
    card but keep their number, and a name without an item has its name for a text; without ``items``, cards are the names.
    """
    every = ranked.select("query", "name").unionByName(gold.select("query", F.col("gold").alias("name"))).distinct()
    at = F.row_number().over(Window.partitionBy("query").orderBy(seeded(seed, "query", "name"))) - 1
    shuffled = every.withColumn("_at", at).join(gold, "query")
    if items is None:
        shuffled = shuffled.withColumns({"text": F.col("name").cast("string"), "kind": F.lit("")})
    else:
        shuffled = shuffled.join(items.select("name", "kind", "text"), "name", "left").withColumns({"text": F.coalesce("text", F.col("name").cast("string")), "kind": F.coalesce("kind", F.lit(""))})
    card = F.when(~F.col("kind").isin(*skipped), F.concat(F.lit("ID "), "_at", F.lit(": "), "text"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "name", card.alias("card"))))
    return shuffled.groupBy("query").agg(
        F.transform(ordered, lambda x: x["name"]).alias("choices"),
        F.max(F.when(F.col("name") == F.col("gold"), F.col("_at"))).cast("long").alias("gold_at"),
        F.filter(F.transform(ordered, lambda x: x["card"]), lambda c: c.isNotNull()).alias("cards"),
    )


def relation_pairs(references: DataFrame, seed: str, least: int = 3, n: int = 2) -> DataFrame:
    """Item, ref: ``n`` seeded references of each item that has at least ``least``."""
    once = references.distinct()
    count = F.count("*").over(Window.partitionBy("item"))
    rich = once.withColumn("_n", count).where(F.col("_n") >= least).drop("_n").withColumn("_o", seeded(seed, "item", "ref"))
    return first_n(rich, ["item"], ["_o", "ref"], n).drop("_o")


def weighted_sample(df: DataFrame, by: str, item: str, weight: str, k: int, seed: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``k`` items of each group without replacement, by weight: the largest of ln(u) / w; zero weights never."""
    live = df.where((F.col(weight) > 0) & ~F.col(item).isin(*excluded)) if excluded else df.where(F.col(weight) > 0)
    keyed = live.withColumn("_key", F.log(seeded_unit(seed, by, item)) / F.col(weight))
    return first_n(keyed, [by], [F.desc("_key"), item], k).drop("_key")


def example_step(pairs: DataFrame, current: DataFrame, seed: str) -> DataFrame:
    """One seeded step for each concept and tactic, never a current one."""
    others = pairs.join(current.select("step").distinct(), "step", "left_anti").withColumn("_o", seeded(seed, "concept", "tactic", "step"))
    return first_n(others, ["concept", "tactic"], ["_o", "step"], 1).drop("_o")


def concept_sample(df: DataFrame, wanted: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` seeded ids of each item, of those wanted; items left empty draw from the remainder."""
    keyed = df.distinct().withColumn("_o", seeded(seed, "item", "id"))
    first = first_n(keyed.join(wanted.select("id").distinct(), "id", "left_semi"), ["item"], ["_o", "id"], n)
    rest = keyed.join(first.select("item").distinct(), "item", "left_anti")
    return first.unionByName(first_n(rest, ["item"], ["_o", "id"], n).select(*first.columns)).drop("_o")


def kind_sample(df: DataFrame, kinds: list[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` seeded rows of the given kinds (a top-n: each task sends n rows at most)."""
    return df.where(F.col("kind").isin(*kinds)).withColumn("_o", seeded(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def work_list(df: DataFrame, key: str, ratio: float, seed: str, cap: int | None = None) -> DataFrame:
    """A seeded share of the rows, at least one, at most ``cap``."""
    n = max(1, int(df.count() * ratio))
    keyed = df.withColumn("_o", seeded(seed, key))
    if cap is not None and cap <= n:
        return keyed.orderBy("_o", key).limit(cap).drop("_o")
    # the first n by number, without sending them through one task
    return global_row_number(keyed, "_o", key).where(F.col("rn") <= n).drop("_o", "rn")

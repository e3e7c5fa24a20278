"""Resolving tokens to ids, encoding steps, re-decoding after a rename."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.vocabulary import LOCALS, aliases, decoded, encoded
from traceloom.sources.shared import table_in_shared

EITHER = "<ker>"
BEFORE_LOCALS, SIBLING, WALK = 5, 7, 9  # ranks of the rules


def _candidates(name: Column, token: Column) -> Column:
    """rank, rule, source (name or alias) and key under which the token of an item may be known; the least rank wins."""

    def one(rank: int, rule: str, source: str, key: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), F.lit(source).alias("source"), key.alias("key"))

    parts, own = F.split(token, r"\."), F.split(name, r"\.")
    dotted = F.size(parts) > 1
    doubled = dotted & (F.element_at(parts, -1) == F.try_element_at(parts, F.lit(-2)))
    module = F.slice(own, F.lit(1), F.size(own) - 1)
    prefix = F.when(F.size(own) > 1, F.array_join(module, ".")).otherwise(name)
    fixed = F.array(
        one(1, "exact", "name", F.when(dotted, token)),
        one(2, "less", "name", F.when(doubled, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))),
        one(3, "alias", "alias", F.when(dotted, token)),
        one(4, "own", "name", F.when(token == F.element_at(own, -1), name)),
        one(BEFORE_LOCALS, "exact", "name", F.when(~dotted, token)),
        one(SIBLING, "sibling", "name", F.concat_ws(".", prefix, token)),
    )
    # under the item's module unless the token names the item's first part, with fewer and fewer middle parts
    path = F.when(dotted & token.contains(F.get(own, 0)), parts).otherwise(F.concat(module, parts))
    first, last, n = F.get(path, 0), F.element_at(path, -1), F.size(path)
    walk = F.transform(
        F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            (n - 3 - k + WALK).alias("rank"), F.lit("walk").alias("rule"), F.lit("alias").alias("source"),
            F.concat_ws(".", first, F.when(k > 0, F.array_join(F.slice(path, F.lit(2), k), ".")), last).alias("key"),
        ),
    )
    return F.filter(F.concat(fixed, walk), lambda c: c["key"].isNotNull())


def _known(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """name, half, and the best (rank, rule, id) of the rules before locals, of siblings and of the module walk; pairs without any are left out.

    All rules are looked up in one join of their keys with names and aliases.
    """
    lookup = vocabulary.select(F.lit("name").alias("source"), F.col("token").alias("key"), "id").unionByName(
        aliases(vocabulary).select(F.lit("alias").alias("source"), F.col("alias").alias("key"), "id")
    )
    asked = pairs.distinct().select("name", "half", F.explode(_candidates(F.col("name"), F.col("half"))).alias("c")).select("name", "half", "c.*")
    met = asked.join(lookup, ["source", "key"]).withColumn("hit", F.struct("rank", "rule", "id"))
    return met.groupBy("name", "half").agg(
        F.min(F.when(F.col("rank") <= BEFORE_LOCALS, F.col("hit"))).alias("before"), F.min(F.when(F.col("rank") == SIBLING, F.col("hit"))).alias("sibling"),
        F.min(F.when(F.col("rank") >= WALK, F.col("hit"))).alias("walk"),
    )


def _first_made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, half, pos of the new locals of items whose alternatives wait for each other: rows in order of item and pos, token by token."""
    here, made = None, set()
    for batch in batches:
        out = []
        for item, pos, a, makes, b, b_known in zip(*(batch[c].tolist() for c in ("item", "pos", "a", "makes", "b", "b_known"))):
            if item != here:
                here, made = item, set()
            if makes and a not in made and not (b is not None and (b_known or b in made)):
                made.add(a)
                out.append((item, a, pos))
        if out:
            yield pd.DataFrame(out, columns=["item", "half", "pos"])


def resolved(tokens: DataFrame, vocabulary: DataFrame, local: DataFrame | None = None, typed: DataFrame | None = None) -> DataFrame:
    """V7, V8: ``tokens`` (item, pos, token, name of the item) with ``id``, ``rule`` and ``half`` (the part of an alternative that was taken).

    ``vocabulary``: token, id; ``local``: item, token, id; ``typed``: item, token. In order: ``exact`` for a dotted token; ``less``, without
    its last part where that repeats the one before; ``alias``; ``own``, the item's base name; ``exact``; ``local``; ``sibling``, with
    the item's prefix; ``typed``, which opens a new local; ``walk``, an alias under the item's module with fewer and fewer
    middle parts; ``fallback``, which opens a new local too. New locals are numbered after the item's largest by where they first stand,
    and are ``local`` from there on. Of ``a<ker>b``, b is tried where a is known by no rule up to ``sibling``; if b isn't
    either, a goes on. Positions are distinct in an item; no row is lost, names and tokens must not be null.
    """
    either = F.col("token").contains(EITHER)
    split = tokens.select(*tokens.columns, F.substring_index("token", EITHER, 1).alias("_a"), F.when(either, F.get(F.split("token", EITHER), 1)).alias("_b"))
    pairs = split.select("name", F.explode(F.array("_a", "_b")).alias("half")).where("half is not null")
    known = table_in_shared(_known(pairs, vocabulary), "known-tokens")

    def looked_up(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.join(known.select("name", F.col("half").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("before", "sibling", "walk"))), ["name", side], "left")
        if local is None:
            rows = rows.withColumn(f"{side}_local", F.lit(None).cast("long"))
        else:
            rows = rows.join(local.select("item", F.col("token").alias(side), F.col("id").alias(f"{side}_local")), ["item", side], "left")
        there = F.when(F.col(f"{side}_local").isNotNull(), F.struct(F.lit(6).alias("rank"), F.lit("local").alias("rule"), F.col(f"{side}_local").alias("id")))
        return rows.withColumn(f"{side}_hit", F.coalesce(f"{side}_before", there, f"{side}_sibling"))

    # only alternatives have a second half to look up
    plain, both = looked_up(split.where("_b is null"), "_a"), looked_up(looked_up(split.where("_b is not null"), "_a"), "_b")
    split = both.unionByName(plain, allowMissingColumns=True).drop(*(f"{side}_{c}" for side in ("_a", "_b") for c in ("before", "sibling", "local")), "_b_walk")
    if typed is None:
        split = split.withColumn("_typed", F.lit(False))
    else:
        split = split.join(typed.select("item", F.col("token").alias("_a"), F.lit(True).alias("_typed")).distinct(), ["item", "_a"], "left").withColumn("_typed", F.coalesce("_typed", F.lit(False)))
    split = table_in_shared(split.withColumn("_makes", F.col("_typed") | F.col("_a_walk").isNull()), "split-tokens")

    # where each item first opens a new local
    open_ = split.where("_a_hit is null").select("item", "pos", F.col("_a").alias("a"), F.col("_makes").alias("makes"), F.col("_b").alias("b"), F.col("_b_hit").isNotNull().alias("b_known"))
    waiting = open_.where("b is not null and not b_known").select("item").distinct()
    plain = open_.where("makes and b is null").join(waiting, "item", "left_anti").groupBy("item", F.col("a").alias("half")).agg(F.min("pos").alias("pos"))
    kinds = dict(split.dtypes)
    tangled = open_.join(waiting, "item", "left_semi").repartition("item").sortWithinPartitions("item", "pos").mapInPandas(_first_made, f"item {kinds['item']}, half string, pos {kinds['pos']}")
    made = plain.unionByName(tangled).withColumn("made_id", F.row_number().over(Window.partitionBy("item").orderBy("pos")).cast("long"))
    if local is not None:
        top = local.groupBy("item").agg(F.max("id").alias("_top"))
        made = made.join(top, "item", "left").withColumn("made_id", F.col("made_id") + F.coalesce("_top", F.lit(0))).drop("_top")
    made = table_in_shared(made, "new-locals")

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(made.select("item", F.col("half").alias(side), F.col("pos").alias(f"{side}_at"), F.col("made_id").alias(f"{side}_made")), ["item", side], "left")

    # what is known needs no local
    plain, both = numbered(split.where("_a_hit is null and _b is null"), "_a"), numbered(numbered(split.where("_a_hit is null and _b is not null"), "_a"), "_b")
    split = both.unionByName(plain, allowMissingColumns=True).unionByName(split.where("_a_hit is not null"), allowMissingColumns=True)

    def pick(condition: Column, rule: Column | str, number: Column, half: str) -> tuple[Column, Column]:
        return condition, F.struct(number.alias("id"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.col(half).alias("half"))

    order = [
        pick(F.col("_a_hit").isNotNull(), F.col("_a_hit.rule"), F.col("_a_hit.id"), "_a"),
        pick(F.col("_a_at") < F.col("pos"), "local", F.col("_a_made"), "_a"),
        pick(F.col("_b_hit").isNotNull(), F.col("_b_hit.rule"), F.col("_b_hit.id"), "_b"),
        pick(F.col("_b_at") < F.col("pos"), "local", F.col("_b_made"), "_b"),
        pick(F.col("_typed"), "typed", F.col("_a_made"), "_a"),
        pick(F.col("_a_walk").isNotNull(), "walk", F.col("_a_walk.id"), "_a"),
        pick(F.lit(True), "fallback", F.col("_a_made"), "_a"),
    ]
    picked = F.when(*order[0])
    for condition, value in order[1:]:
        picked = picked.when(condition, value)
    return split.withColumn("_p", picked).select(*tokens.columns, F.col("_p.id").alias("id"), F.col("_p.rule").alias("rule"), F.col("_p.half").alias("half"))


def locals_after(rows: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """item, token, id: the locals given and those that ``resolved`` opened in ``rows``."""
    new = rows.where(F.col("rule").isin("typed", "fallback")).select("item", F.col("half").alias("token"), "id")
    return new if local is None else local.select("item", "token", "id").unionByName(new)


def encoded_steps(tokens: DataFrame, vocabulary: DataFrame, local: DataFrame | None = None, typed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(item, ids of the tactic, retried; item, token, id of all locals).

    ``tokens``: as for ``resolved``, with ``tactic`` (false: of the states around the step, which come first and open locals too). Where all of a
    tactic's ids are local (below 100), its tokens are split at ``_`` too, empty parts included, and resolved anew, with all
    locals so far; these ids replace the first ones.
    """
    first = table_in_shared(resolved(tokens, vocabulary, local, typed), "first-pass")
    so_far = table_in_shared(locals_after(first, local), "locals-so-far")
    ids = encoded(first.where("tactic"))
    again = ids.where((F.size("ids") > 0) & F.forall("ids", lambda i: i < LOCALS)).select("item")
    parts = first.where("tactic").join(again, "item", "left_semi").select("item", "name", "pos", F.posexplode(F.split("token", "_")).alias("_at", "token"))
    order = F.row_number().over(Window.partitionBy("item").orderBy("pos", "_at")).cast("long")
    second = resolved(parts.select("item", "name", "token", order.alias("pos")), vocabulary, so_far, typed)
    second = table_in_shared(second, "second-pass")
    new = encoded(second).withColumnRenamed("ids", "_again")
    both = ids.join(new, "item", "left").select("item", F.coalesce("_again", "ids").alias("ids"), F.col("_again").isNotNull().alias("retried"))
    return both, locals_after(second, so_far)


def renamed(token: Column, temporary: str, identifier: Column) -> Column:
    """A token that holds the temporary file's prefix is what follows it, under the real module; of alternatives, each half."""
    return F.array_join(
        F.transform(F.split(token, EITHER), lambda t: F.when(t.contains(temporary), F.concat(identifier, F.substring_index(t, temporary, -1))).otherwise(t)), EITHER
    )


def redecoded(tokens: DataFrame, vocabulary: DataFrame, temporary: str, identifier: Column, local: DataFrame | None = None, typed: DataFrame | None = None) -> DataFrame:
    """Item, text: the tokens of a re-run episode under their real names, resolved and decoded again."""
    rows = table_in_shared(resolved(tokens.withColumn("token", renamed(F.col("token"), temporary, identifier)), vocabulary, local, typed), "renamed")
    return decoded(rows.select("item", "pos", "id"), vocabulary, locals_after(rows, local))

"""Vocabulary, ids and cross-references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.functions.ordering import first_n, global_row_number, last_wins
from traceloom.sources.shared import table_in_shared

LOCALS = 100  # ids 1 to 100 are local variables
FIRST_GLOBAL = 1000
FIRST_LATE = 1_000_000
BLOCK = 1_000_000  # list elements that share a dictionary, about

# fixed value: delimiters that stay tokens, the longer ones first
DELIMITERS = r"(:=|=>|<=|<-|/\\|\\/|\|-|\+|-\s|\s|\(|\)|\[|\]|\{|\}|\||,|~|%|;|:|@|\?|/)"


def fixed_vocabulary(spark: SparkSession, internal: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """V1: token, id, class. ``internal``: token, ord, and reserved where ``names`` are given; the first occurrence wins; ids follow the locals.

    An internal token that is one of ``names`` (token) loses its place, unless it is reserved.
    """
    local = spark.range(1, LOCALS + 1).select(F.concat(F.lit("local_var_"), "id").alias("token"), "id", F.lit("local").alias("class"))
    if names is not None:
        taken = names.select("token").join(F.broadcast(internal.where("not reserved").select("token")), "token", "left_semi")  # fewer than a thousand tokens
        internal = internal.join(taken, "token", "left_anti")
    once = internal.groupBy("token").agg(F.min("ord").alias("ord"))
    over = Window.orderBy("ord")  # fewer than a thousand tokens
    return local.unionByName(once.select("token", (F.row_number().over(over) + LOCALS).cast("long").alias("id"), F.lit("internal").alias("class")))


def definition_names(definitions: DataFrame) -> DataFrame:
    """V2: token, ord of definitions (name, kind, ord): tactic definitions go by their base name, unnamed ones have none."""
    base = F.element_at(F.split("name", r"\."), -1)
    return definitions.where("name != ''").select(F.when(F.col("kind") == "Ltac", base).otherwise(F.col("name")).alias("token"), "ord")


def first_seen(names: DataFrame) -> DataFrame:
    return names.groupBy("token").agg(F.min("ord").alias("ord"))


def global_ids(names: DataFrame, internal: DataFrame, current: int = FIRST_GLOBAL) -> DataFrame:
    """V2: token, id: distinct names in first-seen order after max(current, 1000).

    ``internal``: token, and reserved where not all are. Reserved tokens (built-in tactics and signs) never become names; a name that equals
    another internal token gets an id here, and ``fixed_vocabulary`` drops the token.
    """
    kept = internal.where("reserved") if "reserved" in internal.columns else internal
    new = first_seen(names).join(F.broadcast(kept.select("token")), "token", "left_anti")  # fewer than a thousand tokens
    return global_row_number(new, "ord", "token").select("token", (F.col("rn") + max(current, FIRST_GLOBAL) - 1).alias("id"))


def extended(vocabulary: DataFrame, names: DataFrame, late: bool = False) -> DataFrame:
    """V3: the vocabulary and its new names. Ids continue after the largest; a late batch starts at a million at least."""
    top = vocabulary.agg(F.max("id")).first()[0] or FIRST_GLOBAL - 1
    start = max(top + 1, FIRST_LATE if late else FIRST_GLOBAL)
    new = first_seen(names).join(vocabulary.select("token"), "token", "left_anti")
    ids = global_row_number(new, "ord", "token").select("token", (F.col("rn") + start - 1).alias("id"))
    return vocabulary.select("token", "id").unionByName(ids)


def aliases(vocabulary: DataFrame) -> DataFrame:
    """V4: alias, id: a name of n > 2 parts also answers to its first part, fewer and fewer middles, and its last. The later name wins."""
    parts = F.split("token", r"\.")
    n = F.size(parts)
    kept = F.sequence(F.lit(0), n - 3)
    short = F.transform(kept, lambda k: F.concat_ws(".", F.slice(parts, F.lit(1), k + 1), F.element_at(parts, -1)))
    return vocabulary.where(n > 2).select("id", F.explode(short).alias("alias")).groupBy("alias").agg(F.max("id").alias("id"))


def symbol_tokens(text: Column) -> Column:
    """V5: tokens with delimiters kept and single blanks dropped; ``3!x`` gives 3 and x, ``!x`` gives ! and x."""
    marked = F.regexp_replace(text, DELIMITERS, "\u0001$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: (p != "") & (p != " "))

    def halves(p: Column) -> Column:
        before = F.substring_index(p, "!", 1)
        after = F.substr(p, F.length(before) + 2)
        numbered = (F.length(p) > 1) & p.rlike("^[0-9]") & p.contains("!")
        return (
            F.when(numbered & (after == ""), F.array(before, F.lit("!")))
            .when(numbered, F.array(before, after))
            .when((F.length(p) > 1) & p.startswith("!"), F.array(F.lit("!"), F.substr(p, F.lit(2))))
            .otherwise(F.array(p))
        )

    return F.flatten(F.transform(parts, halves))


def blank_tokens(text: Column) -> Column:
    """V6."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """item, pos (from 1), token."""
    return df.select(F.col(key).alias("item"), F.posexplode(tokens).alias("pos", "token")).select("item", (F.col("pos") + 1).cast("long").alias("pos"), "token")


def local_ids(seen: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """V9: item, token, id: numbered by first appearance (``seen``: item, token, ord), after each item's largest id in ``after``."""
    once = seen.groupBy("item", "token").agg(F.min("ord").alias("ord"))
    ranked = once.withColumn("id", F.row_number().over(Window.partitionBy("item").orderBy("ord", "token")).cast("long"))
    if after is not None:
        top = after.groupBy("item").agg(F.max("id").alias("_top"))
        ranked = ranked.join(top, "item", "left").withColumn("id", F.col("id") + F.coalesce("_top", F.lit(0)))
    return ranked.select("item", "token", "id")


def attached_types(*sources: DataFrame) -> DataFrame:
    """Item, token, type: the first non-empty of the sources, in the order given."""
    every = None
    for rank, s in enumerate(sources):
        one = s.where("type is not null and type != ''").select("item", "token", "type", F.lit(rank).alias("_rank"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("item", "token").agg(F.min_by("type", F.struct("_rank", "type")).alias("type"))


def encoded(rows: DataFrame) -> DataFrame:
    """Item, ids: the ids of each item's tokens in order (``rows``: item, pos, id), unresolved ones left out."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    return rows.groupBy("item").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))


def item_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """item, list: the blank-separated tokens of each item; rows of one item are merged by position. Items without a token go."""
    rows = df.groupBy(F.col(key).alias("item")).agg(F.collect_list(text).alias("_texts"))
    at = F.transform("_texts", lambda t: F.transform(blank_tokens(t), lambda w, i: F.struct(i.alias("i"), w.alias("w"))))
    tokens = F.when(F.size("_texts") == 1, blank_tokens(F.get("_texts", 0))).otherwise(F.transform(F.sort_array(F.flatten(at)), lambda x: x["w"]))
    return rows.select("item", tokens.alias("list")).where(F.size("list") > 0)


def exchanged(lists: DataFrame, key: str, to: str, table: DataFrame, missing: Column | None = None) -> DataFrame:
    """``lists`` (item, list) with each element, ``key`` of ``table``, replaced by its ``to``; elements that ``table`` lacks go, or are ``missing``.

    Lists are coded by dictionaries of blocks of about ``BLOCK`` elements. Only the dictionaries meet ``table``: an element
    costs a row for each block that holds it, not for each place. Keys of ``table`` must be distinct.
    """
    kinds = dict(lists.dtypes)
    element, out = kinds["list"].removeprefix("array<").removesuffix(">"), dict(table.dtypes)[to]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            while len(batch):
                upto = np.cumsum(pc.list_value_length(batch.column("list")).to_numpy(zero_copy_only=False))
                end = int(np.searchsorted(upto, BLOCK - size)) + 1
                held.append(batch.slice(0, end))
                size += int(upto[min(end, len(batch)) - 1])
                batch = batch.slice(end)
                if size >= BLOCK:
                    yield from block(task + n, held)
                    n, held, size = n + 1, [], 0
        if held:
            yield from block(task + n, held)

    def block(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists_ = pa.concat_arrays(rows["list"].chunks)
        coded = lists_.flatten().dictionary_encode()
        codes = pa.ListArray.from_arrays(_offsets(lists_), coded.indices.cast(pa.int32()))
        item = pa.concat_arrays(rows["item"].chunks)
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        names = ["block", "item", "codes", "words"]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(item), pa.int64()), item, codes, pa.nulls(len(item), words.type)], names)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, item.type), pa.nulls(1, codes.type), words], names)

    def fill(rows: pa.Table, words: pa.Table) -> pa.Table:
        values = pa.concat_arrays(words["_to"].chunks).take(pa.array(np.argsort(words["k"].to_numpy())))
        codes = pa.concat_arrays(rows["codes"].chunks)
        picked, at = values.take(codes.flatten()), _offsets(codes).to_numpy()
        there = np.r_[0, np.cumsum(pc.is_valid(picked).to_numpy(zero_copy_only=False))]
        return pa.table({"item": rows["item"], "list": pa.ListArray.from_arrays(pa.array(there[at].astype(np.int32)), picked.drop_null())})

    coded = table_in_shared(lists.mapInArrow(code, f"block long, item {kinds['item']}, codes array<int>, words array<{element}>"), "coded-lists")
    words = coded.where("words is not null").select("block", F.posexplode("words").alias("k", key))
    met = words.join(table.select(key, F.col(to).alias("_to")), key, "left")
    found = F.col("_to") if missing is None else F.coalesce("_to", missing)
    rows = coded.where("words is null").select("block", "item", "codes")
    both = rows.groupBy("block").cogroup(met.select(F.col("block").alias("of"), "k", found.alias("_to")).groupBy("of"))
    return both.applyInArrow(fill, f"item {kinds['item']}, list array<{out}>").where(F.size("list") > 0)


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int32))


def encoded_lists(lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """V11 for whole lists (item, list of tokens): item, ids of the tokens in order, unresolved ones left out; items with none go."""
    return exchanged(lists, "token", "id", vocabulary).withColumnRenamed("list", "ids")


def decoded_lists(lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """V14 for whole lists (item, ids) without locals: item, text. An unknown id is an error."""
    error = F.raise_error(F.concat(F.lit("no token for id "), F.col("id"))).cast("string")
    words = exchanged(lists.select("item", F.col("ids").alias("list")), "id", "token", vocabulary, error)
    return words.select("item", F.array_join("list", " ").alias("text"))


def looked_up(episodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds ``found``: the definition by name, else by the text before the first ``_``."""
    d = definitions.select("name", "value")
    by_name = d.select("name", F.col("value").alias("_v1"))
    by_base = d.select(F.col("name").alias("_base"), F.col("value").alias("_v2"))
    out = episodes.withColumn("_base", F.substring_index("name", "_", 1)).join(by_name, "name", "left").join(by_base, "_base", "left")
    return out.withColumn("found", F.coalesce("_v1", "_v2")).drop("_v1", "_v2", "_base")


def decoded(rows: DataFrame, vocabulary: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Item, text from (item, pos, id); ids up to 100 are the item's locals. An unknown id is an error."""
    out = rows.join(vocabulary.select("id", F.col("token").alias("_g")), "id", "left")
    if local is not None:
        out = out.join(local.select("item", "id", F.col("token").alias("_l")), ["item", "id"], "left")
    else:
        out = out.withColumn("_l", F.lit(None).cast("string"))
    word = F.when(F.col("id") <= LOCALS, F.col("_l")).otherwise(F.col("_g"))
    word = F.coalesce(word, F.raise_error(F.concat(F.lit("no token for id "), F.col("id"))).cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", word.alias("w"))))
    return out.groupBy("item").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("text"))


def free_text_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Item, pos, id of tokens with a global id; the others go."""
    return tokens.join(vocabulary, "token").where(F.col("id") > FIRST_GLOBAL).select("item", "pos", "id")


def definition_ids(definitions: DataFrame, vocabulary: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each id of 1000 or more, with ``def_id``; rows whose name has no id)."""
    named = vocabulary.select(F.col("token").alias("name"), F.col("id").alias("def_id"))
    met = definitions.join(named, "name").where(F.col("def_id") >= FIRST_GLOBAL)
    return first_n(met, ["def_id"], [F.col(order)], 1), definitions.join(named, "name", "left_anti")


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """Total, fallback (unresolved) and their ratio, 0 where there is nothing."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("id").isNull()).alias("fallback")).withColumn(
        "ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("fallback") / F.col("total"))
    )


def referenced(definitions: DataFrame, start: int) -> DataFrame:
    """Item, ids: distinct ids of content, body and types, from ``start`` on, the item's own left out, ascending."""
    every = F.array_union(F.array_union(F.coalesce("content", F.array()), F.coalesce("body", F.array())), F.coalesce("types", F.array()))
    return definitions.select("item", F.array_sort(F.filter(F.array_distinct(every), lambda i: (i >= start) & (i != F.col("item")))).alias("ids"))


def fetched(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """Item, id and the definition's columns; Primitive ones skipped, a missing one is an error."""
    met = wanted.distinct().join(definitions, "id", "left")
    checked = met.withColumn("kind", F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("no definition "), F.col("id"))).cast("string")).otherwise(F.col("kind")))
    return checked.where("kind != 'Primitive'")


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """Concept, tactic, n, steps (ascending, distinct). ``pairs``: concept, tactic, step."""
    return pairs.groupBy("concept", "tactic").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("step")).alias("steps"))


def merged(base: DataFrame, late: DataFrame, key: str) -> DataFrame:
    """Late rows replace those with their key, others are added."""
    both = base.withColumn("_new", F.lit(0)).unionByName(late.withColumn("_new", F.lit(1)))
    return last_wins(both, key, [F.desc("_new")]).drop("_new")

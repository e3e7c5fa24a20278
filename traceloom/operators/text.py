"""Text shaping and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.json import is_json


def definition_text(mode: str | Column, origin: Column, content: Column, body: Column) -> Column:
    """By mode: origin, internal (content, then ``body: ...``), mixed (both) or empty."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    internal = F.concat_ws("\n", content, F.when(body.isNotNull(), F.concat(F.lit("body: "), body)))
    return (
        F.when(mode == "origin", origin).when(mode == "internal", internal)
        .when(mode == "mixed", F.concat_ws("\n", origin, internal)).otherwise(F.lit(""))
    )


def head_and_tail(text: Column, most: int, keep: int, marker: str = "...") -> Column:
    """Texts over ``most`` characters keep ``keep`` at each end."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit(marker), F.right(text, F.lit(keep)))).otherwise(text)


def valid_input(df: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """Without empty texts and Primitive rows."""
    return df.where(F.coalesce(F.col(text), F.lit("")) != "").where(F.coalesce(F.col(kind), F.lit("")) != "Primitive")


def prompt(template: str, *values: Column) -> Column:
    """The template's ``{}`` filled in order."""
    parts, out = template.split("{}"), []
    for k, part in enumerate(parts):
        out.append(F.lit(part))
        if k < len(parts) - 1:
            out.append(F.coalesce(values[k].cast("string"), F.lit("")))
    return F.concat(*out)


def path_after(path: Column, mark: str) -> Column:
    return F.substring_index(path, mark, -1)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """E5: rows whose key is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def enriched(df: DataFrame, scorer: Callable[[str], str], key: str, prompt_column: str, settle: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, reply) where the scorer gave one, (key, prompt, error) where it failed, and one row of totals: processed, succeeded, failed.

    Rows go by Arrow batch. ``settle`` writes a table and reads it again, so that each row is scored once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[prompt_column]):
                try:
                    rows.append((k, p, scorer(p), None))
                except Exception as e:  # a row's failure is a result
                    rows.append((k, p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "prompt", "reply", "error"])

    kind = dict(df.dtypes)[key]
    out = settle(df.select(key, prompt_column).mapInPandas(run, f"{key} {kind}, prompt string, reply string, error string"))
    totals = out.agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return out.where("error is null").select(key, "reply"), out.where("error is not null").select(key, "prompt", "error"), totals


def clean_reply(text: Column) -> Column:
    """After the thinking part, without code fences, from the first ``{`` to the last ``}``."""
    after = F.substring_index(text, "</think>", -1)
    bare = F.trim(F.regexp_replace(after, r"```[a-z]*", ""))
    return F.when(bare.contains("{") & bare.contains("}"), F.regexp_extract(bare, r"(?s)\{.*\}", 0)).otherwise(bare)


def repaired_escapes(text: Column) -> Column:
    """Backslashes that begin no JSON escape are doubled."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def has_keys(reply: Column, keys: tuple[str, ...]) -> Column:
    """The reply is a JSON object with all the keys."""
    return F.coalesce(F.size(F.array_except(F.array(*(F.lit(k) for k in keys)), F.json_object_keys(reply))) == 0, F.lit(False))


# fixed values: the keys that each kind of reply must have
REQUIRED = {
    "enrichment": ("mathematical_domains", "key_concepts", "concept_relations", "intuitive_explanation", "dependent_premises", "potential_applications"),
    "tactics": ("tactics",), "refinement": ("refined_tactic", "reason"), "generation": (), "selection": ("states",), "notes": ("add", "remove"),
    "explanation": ("before", "after", "tactic"), "strategy": ("proof_trace", "steps", "score"),
}
TACTIC, LANGUAGES, MOST_STATES = ("tactic", "reason"), ("zh", "en"), 3
ANY_CASE = ("tactics", "refinement", "generation")  # kinds whose keys may be in any case


def reply_problem(reply: Column, kind: str, reasons: bool = True) -> Column:
    """What is wrong with a JSON reply of a kind (of ``REQUIRED``), null if nothing is.

    Beside the required keys: every item of ``tactics`` is an object with a tactic and a reason (with ``reasons`` off, a list is enough);
    a generation has info or tactics; a selection lists three states at most; each part of an explanation is an object
    with a text in both languages. Of keys that differ in case alone the last counts, where case doesn't matter. A null reply is no object.
    """
    pairs = F.map_entries(F.from_json(reply, "map<string,string>"))  # nested values as JSON texts

    def value(key: str) -> Column:
        own = F.filter(pairs, lambda e: (F.lower(e["key"]) if kind in ANY_CASE else e["key"]) == key)
        return F.try_element_at(F.transform(own, lambda e: F.coalesce(e["value"], F.lit("null"))), F.lit(-1))

    def lacks(keys: tuple[str, ...], objects: Column) -> Column:
        return F.exists(objects, lambda o: F.coalesce(~_all_keys(o, keys), F.lit(True)))

    def _all_keys(o: Column, keys: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.map_contains_key(o, F.lit(k))
        return out

    problem = F.when(pairs.isNull() | reply.isNull() | ~is_json(reply), F.lit("no JSON object"))
    for key in REQUIRED[kind]:
        problem = problem.when(value(key).isNull(), F.lit(f"no {key}"))
    if kind == "generation":
        problem = problem.when(value("info").isNull() & value("tactics").isNull(), F.lit("no info or tactics"))
    if kind in ("tactics", "generation"):
        tactics = value("tactics")
        is_list = F.ltrim(tactics).startswith("[")
        problem = problem.when(tactics.isNotNull() & ~is_list, F.lit("tactics are no list"))
        if reasons:
            items = F.from_json(tactics, "array<map<string,string>>")
            incomplete = F.coalesce(lacks(TACTIC, items), F.lit(True))
            problem = problem.when(tactics.isNotNull() & incomplete, F.lit("a tactic without tactic and reason"))
    if kind == "selection":
        states = F.from_json(value("states"), "array<string>")
        problem = problem.when(~F.ltrim(value("states")).startswith("[") | states.isNull(), F.lit("states are no list")).when(F.size(states) > MOST_STATES, F.lit("more than three states"))
    if kind == "explanation":
        for key in REQUIRED[kind]:
            problem = problem.when(lacks(LANGUAGES, F.array(F.from_json(value(key), "map<string,string>"))), F.lit(f"{key} lacks a language"))
    return problem


def lower_keys(values: Column) -> Column:
    """E10."""
    return F.transform_keys(values, lambda k, _: F.lower(k))


def strategy_tail(text: Column, mark: str = "brief strategy") -> Column:
    return F.trim(F.substring_index(text, mark, -1))


def loose_pairs(text: Column, keys: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    """What ``"key": value`` says for each key, as lists of strings; a text is a list of one."""
    out = []
    for k in keys:
        if k in lists:
            inner = F.regexp_extract(text, rf'(?s)"{k}"\s*:\s*\[(.*?)\]', 1)
            value = F.regexp_extract_all(inner, F.lit(r'"([^"]*)"'), 1)
        else:
            value = F.regexp_extract_all(text, F.lit(rf'(?s)"{k}"\s*:\s*"([^"]*)"'), 1)
        out += [F.lit(k), value]
    return F.create_map(*out)


def or_default(parsed: Column, default: Column) -> Column:
    """E12."""
    return F.coalesce(parsed, default)


def embedding_input(instruction: str, text: Column, enrichment: Column) -> Column:
    """E13."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text, F.lit("\n"), F.to_json(enrichment))


def unit_vector(v: Column) -> Column:
    """Divided by its length, in double precision; a zero vector stays."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(wide, lambda x: F.when(n == 0, x).otherwise(x / n)))[0]


def by_mode(mode: str | Column, origin: Column, internal: Column) -> Column:
    """A term as written, as the machine has it, or both; any other mode is an error."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(mode == "origin", origin).when(mode == "internal", internal).when(mode == "mixed", F.concat(internal, F.lit(" (written: "), origin, F.lit(")")))
        .otherwise(F.raise_error(F.concat(F.lit("no such mode: "), mode)).cast("string"))
    )


def state_text(state: Column, mode: str | Column = "origin") -> Column:
    """``name : term`` of each hypothesis in order, then the goal.

    ``state``: struct of hyps (array of struct name, origin, internal, ids) and goal (struct origin, internal, ids); null hyps are none.
    """
    hyps = F.coalesce(state["hyps"], F.array().cast("array<struct<name:string,origin:string,internal:string,ids:array<bigint>>>"))
    each = F.transform(hyps, lambda h: F.concat(h["name"], F.lit(" : "), by_mode(mode, h["origin"], h["internal"])))
    return F.concat(F.lit("hypotheses:\n"), F.array_join(each, "\n"), F.lit("\ngoal: "), by_mode(mode, state["goal"]["origin"], state["goal"]["internal"]))


def state_ids(state: Column, extra: Column | None = None) -> Column:
    """The distinct token ids of a state's hypotheses and goal, and of ``extra``, ascending."""
    ids = F.flatten(F.array_append(F.transform(F.coalesce(state["hyps"], F.array()), lambda h: h["ids"]), state["goal"]["ids"]))
    return F.array_sort(F.array_distinct(ids if extra is None else F.concat(ids, extra)))


def after_texts(after: Column, mode: str | Column = "origin") -> Column:
    """The texts of the states after a step, in order."""
    return F.transform(after, lambda s: state_text(s, mode))


def tactic_text(tactic: Column, before: Column, after: Column, mode: str | Column = "origin") -> Column:
    """A step with the state before it and those after it."""
    return F.concat_ws("\n", F.concat(F.lit("tactic: "), tactic), F.lit("before:"), state_text(before, mode), F.lit("after:"), F.array_join(after_texts(after, mode), "\n"))


def card(name: Column, text: Column, intuition: Column | None = None) -> Column:
    """E16."""
    out = F.concat(F.lit("## Name: "), name, F.lit("\n## Text: "), text)
    return out if intuition is None else F.concat(out, F.coalesce(F.concat(F.lit("\n## Intuition: "), intuition), F.lit("")))


def joined_cards(df: DataFrame, by: str, order: str, card_: Column) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(order, card_.alias("c"))))
    return df.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "\n\n").alias("cards"))


def assembled_prompt(blocks: dict[str, tuple[Column, Column]]) -> Column:
    """The blocks in order, each where its flag is set and it has a text."""
    return F.concat_ws("\n\n", *(F.when(flag, F.concat(F.lit(f"# {name}\n"), text)) for name, (flag, text) in blocks.items()))


# fixed values: ablation case -> (origin mode, intuition, definitions, plain prompt); null keeps the row's own setting
CASES = {
    "no_ref_ps_all": ("mixed", None, False, False), "no_ref_ps_origin": ("origin", None, False, False),
    "origin_only": ("origin", False, True, False), "internal_only": ("internal", False, True, False), "intuition_only": ("empty", True, True, False),
    "origin_internal": ("mixed", False, True, False), "origin_intuition": ("origin", True, True, False), "internal_intuition": ("internal", True, True, False),
    "origin_internal_intuition": ("mixed", True, True, False), "zh_explanation": (None, None, True, False), "base": (None, None, True, True),
}
CASE = T.StructType([
    T.StructField("case", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("intuition", T.BooleanType()),
    T.StructField("definitions", T.BooleanType()), T.StructField("plain", T.BooleanType()),
])


def with_case(df: DataFrame, case: str, mode: str = "mixed", intuition: bool = True, scope: str = "all") -> DataFrame:
    """Adds mode, intuition, definitions and plain of the row's ablation case, and state_mode; a case that is not known keeps the settings given.

    ``scope``: with ``all`` the case's mode holds for states too, with ``def_only`` states keep the ``mode`` given. A state is never empty.
    """
    if scope not in ("all", "def_only"):
        raise ValueError(f"no such scope: {scope}")
    cases = df.sparkSession.createDataFrame([(k, *v) for k, v in CASES.items()], CASE)
    met = df.join(F.broadcast(cases.withColumnRenamed("case", case)), case, "left")  # eleven rows
    met = met.fillna({"mode": mode, "intuition": intuition, "definitions": True, "plain": False}, ["mode", "intuition", "definitions", "plain"])
    return met.withColumn("state_mode", F.when(F.lit(scope == "all") & (F.col("mode") != "empty"), F.col("mode")).otherwise(F.lit(mode)))


def ranking_card(df: DataFrame, by: str, order: str, tactics: Column, goals: Column) -> DataFrame:
    """Adds ``card``: the state's number from 0 within its group, the tactics so far, the goals left."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.withColumn("card", F.concat(F.lit("State "), at, F.lit("\nTactics: "), F.array_join(tactics, "; "), F.lit("\nGoals: "), goals))


def trace_summary(df: DataFrame, by: str, order: str, block: Column) -> DataFrame:
    """A block for each past step in order; ``Initial state`` where there is none."""
    ordered = F.sort_array(F.collect_list(F.when(block.isNotNull(), F.struct(order, block.alias("b")))))
    text = F.array_join(F.transform(ordered, lambda x: x["b"]), "\n")
    return df.groupBy(by).agg(F.when(text == "", F.lit("Initial state")).otherwise(text).alias("summary"))

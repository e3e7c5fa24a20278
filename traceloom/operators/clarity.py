"""Clarity (definition-recovery) evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.ordering import first_n, seeded
from traceloom.operators.traces import short_names

# fixed values: item prefixes -> fields, section marks
PREFIXES = {
    "## Name:": "name", "## Type:": "type", "## Origin:": "origin", "## Content:": "origin", "## Internal:": "internal", "## Intuition:": "intuition",
}
FULL_CASE = ("origin", "internal", "intuition")


def prompt_text(raw: Column, field: str = "prompt") -> Column:
    """The field of a JSON object, else the raw text."""
    return F.coalesce(F.get_json_object(raw, f"$.{field}"), raw)


def sections(text: Column, marks: list[str]) -> Column:
    """A map from mark to the text after it, up to the next mark; ``before`` holds what precedes them. Missing marks are empty."""
    any_mark = "|".join(rf"\Q{m}\E" for m in marks)
    out = [F.lit("before"), F.regexp_extract(text, rf"(?s)^(.*?)(?:{any_mark}|$)", 1)]
    for m in marks:
        out += [F.lit(m), F.regexp_extract(text, rf"(?s)\Q{m}\E(.*?)(?:{any_mark}|$)", 1)]
    return F.create_map(*out)


def items(lines: DataFrame, least: int = 3) -> DataFrame:
    """File, item (from 1), and a column for each field: a name line opens an item; other ``##`` lines end a field.

    Items with fewer than ``least`` fields go.
    """
    head = F.lit(None).cast("string")
    rest = F.col("line")
    for mark, field in PREFIXES.items():
        head = F.when(F.col("line").startswith(mark), F.lit(field)).otherwise(head)
        rest = F.when(F.col("line").startswith(mark), F.trim(F.substring(F.col("line"), len(mark) + 1, 2**30))).otherwise(rest)
    head = F.when(head.isNull() & F.col("line").startswith("##"), F.lit("other")).otherwise(head)
    over = Window.partitionBy("file").orderBy("line_no")
    each = lines.withColumn("_rest", rest).withColumn("_head", head)
    each = each.withColumn("item", F.sum(F.when(F.col("_head") == "name", 1).otherwise(0)).over(over)).where("item > 0")
    each = each.withColumn("_field", F.last("_head", ignorenulls=True).over(over)).where("_field != 'other'")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_rest"))), lambda x: x["_rest"])
    texts = each.groupBy("file", "item", "_field").agg(F.array_join(ordered, "\n").alias("text"))
    fields = list(dict.fromkeys(PREFIXES.values()))
    wide = texts.groupBy("file", "item").agg(*(F.max(F.when(F.col("_field") == f, F.col("text"))).alias(f) for f in fields))
    present = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return wide.where(present >= least)


def sliced(df: DataFrame, by: str, order: str, key: str, first: int, last: int, n: int, seed: str) -> DataFrame:
    """C4: of prompts numbered ``first`` to ``last`` (``order``), ``n`` seeded items each."""
    part = df.where(F.col(order).between(first, last)).withColumn("_o", seeded(seed, by, key))
    return first_n(part, [by], ["_o", key], n).drop("_o")


def crossed(df: DataFrame, cases: DataFrame, excluded: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """Every item with every case (a table of ``most`` rows at most, else an error), without excluded (item, case) pairs."""
    rows = cases.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cases")
    kinds = f"array<{cases.schema.simpleString()}>"
    each = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(cases.schema, r))) for r in rows)).cast(kinds)
    out = df.select(*df.columns, F.inline(each))
    return out if excluded is None else out.join(excluded, [c for c in excluded.columns], "left_anti")


def case_fields(case: Column, fields: dict[str, Column]) -> Column:
    """The texts of the fields that the case names, joined by lines; none for ``no_ref`` cases."""
    parts = F.array_compact(F.array(*(F.when(case.contains(name), text) for name, text in fields.items())))
    return F.when(case.startswith("no_ref"), F.lit("")).otherwise(F.array_join(parts, "\n"))


def rewritten(text: Column, explanation: Column) -> Column:
    """Without Internal lines, names short, the explanation line replaced where there is another one."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.contains("Internal"))
    swapped = F.transform(lines, lambda x: F.when(x.startswith("## Intuition:") & explanation.isNotNull(), F.concat(F.lit("## Intuition: "), explanation)).otherwise(x))
    return F.array_join(F.transform(swapped, lambda x: short_names(x)), "\n")


def fenced(text: Column) -> Column:
    """The first fenced block, else the whole reply."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```[a-z]*\s*(.*?)\s*```", 1), F.lit("")), text)


def yes_no_score(first: Column, yes: Column, no: Column) -> Column:
    """e^yes / (e^yes + e^no), to 2 places; a missing alternative counts 0; null unless the first token is YES or NO."""
    a = F.when(yes.isNull(), 0.0).otherwise(F.exp(yes))
    b = F.when(no.isNull(), 0.0).otherwise(F.exp(no))
    return F.when(F.upper(F.trim(first)).isin("YES", "NO") & (a + b > 0), F.round(a / (a + b), 2))


def scored_only(df: DataFrame, score: str = "score") -> DataFrame:
    """C10."""
    return df.where(F.col(score).isNotNull())


def case_means(df: DataFrame, cases: DataFrame) -> DataFrame:
    """C11: case, mean score (0.0 where none), n, for every case."""
    sums = df.groupBy("case").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    return cases.join(sums, "case", "left").select("case", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def examples(df: DataFrame, n: int, order: str, answer: str | None = None) -> DataFrame:
    """The first ``n`` rows of each case, of one answer if asked."""
    part = df if answer is None else df.where(F.upper("result").startswith(answer))
    return first_n(part, ["case"], [order], n)

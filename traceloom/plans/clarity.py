"""Queries of clarity evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import clarity as op
from traceloom.plans.registry import query, table
from traceloom.sources.files import numbered_lines

BOTH = "case when event_id % 3 = 0 then null else -value / 10 end"


@query("c1_prompt_text", "select doc_id, case when doc_id % 2 = 0 then source else lang end as prompt from documents")
def c1(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("source").alias("prompt"), "lang"))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", op.prompt_text(raw).alias("prompt"))


@query("c2_sections", "select doc_id, 'intro ' || lang as before, source as definitions, text as premises, '' as tactics from documents")
def c2(spark, sf_dir):
    whole = F.concat(F.lit("intro "), "lang", F.lit("# Defs:"), "source", F.lit("# Prem:"), "text")
    s = op.sections(whole, ["# Defs:", "# Prem:", "# Tac:"])
    return table(spark, sf_dir, "documents").select("doc_id", s["before"].alias("before"), s["# Defs:"].alias("definitions"), s["# Prem:"].alias("premises"), s["# Tac:"].alias("tactics"))


@query(
    "c3_items",
    "select doc_id as file, 1::bigint as item, 'a' || doc_id as name, lang as type, source || chr(10) || 'more' as origin from documents union all select doc_id, 3, 'c' || doc_id, 'x', 'y' from documents",
)
def c3(spark, sf_dir):
    text = F.concat(
        F.lit("preface\n## Name: a"), "doc_id", F.lit("\n## Type: "), "lang", F.lit("\n## Origin: "), "source", F.lit("\nmore\n## Note: skip\nskipped\n## Name: b\n## Type: only\n## Name: c"), "doc_id",
        F.lit("\n## Type: x\n## Content: y"),
    )
    lines = numbered_lines(table(spark, sf_dir, "documents").withColumn("text", text), "doc_id", "text")
    return op.items(lines).select("file", "item", "name", "type", "origin")


@query("c4_sliced", "select source, doc_id from documents where cast(substr(source, 4) as bigint) between 3 and 9 qualify row_number() over (partition by source order by md5('2:' || source || ':' || doc_id), doc_id) <= 5")
def c4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("source", 4, 9).cast("long").alias("no"))
    return op.sliced(docs, "source", "no", "doc_id", 3, 9, 5, "2").select("source", "doc_id")


@query("c5_items_by_case", "select doc_id, r_name as case_ from documents, region where not (r_name = 'ASIA' and doc_id in (select doc_id from labels))")
def c5(spark, sf_dir):
    cases = table(spark, sf_dir, "region").select(F.col("r_name").alias("case_"))
    excluded = table(spark, sf_dir, "labels").select("doc_id", F.lit("ASIA").alias("case_"))
    return op.crossed(table(spark, sf_dir, "documents").select("doc_id"), cases, excluded)


@query(
    "c6_case_fields",
    "select doc_id, case doc_id % 4 when 0 then '' when 1 then source when 2 then source || chr(10) || lang else lang end as fields from documents",
)
def c6(spark, sf_dir):
    k = F.col("doc_id") % 4
    case = F.when(k == 0, "no_ref_origin").when(k == 1, "origin").when(k == 2, "origin_intuition").otherwise("intuition_only")
    return table(spark, sf_dir, "documents").select("doc_id", op.case_fields(case, {"origin": F.col("source"), "intuition": F.col("lang")}).alias("fields"))


@query(
    "c7_rewritten",
    "select doc_id, '## Name: ' || source || chr(10) || case when doc_id % 2 = 0 then '## Intuition: ' || lang else '## Intuition: old' end || chr(10) || 'tail' as context from documents",
)
def c7(spark, sf_dir):
    text = F.concat(F.lit("## Name: a.b."), "source", F.lit("\n## Internal: secret\n## Intuition: old\nx.y.tail"))
    return table(spark, sf_dir, "documents").select("doc_id", op.rewritten(text, F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("context"))


@query("c8_fenced_block", "select doc_id, case when doc_id % 2 = 0 then source || ' ' || lang else 'no fence ' || source end as block from documents")
def c8(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure:\n```text\n"), "source", F.lit(" "), "lang", F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("no fence "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", op.fenced(reply).alias("block"))


def scored(spark, sf_dir):
    first = F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "NO").otherwise("maybe")
    no = F.when(F.col("event_id") % 3 == 0, None).otherwise(-F.col("value") / 10)
    score = op.yes_no_score(first, -F.col("event_id") % 7, no)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("case"), F.col("user_id") % 12).alias("case"), first.alias("result"), score.alias("score"))


SCORED = f"""(select event_id, 'case' || user_id % 12 as case_, case event_type when 'view' then 'yes' when 'click' then 'NO' else 'maybe' end as result,
    case when event_type in ('view', 'click') then round(exp(-(event_id % 7)) / (exp(-(event_id % 7)) + coalesce(exp({BOTH}), 0)), 2) end as score from events)"""


@query("c9_yes_no_scores", f"select event_id, score from {SCORED}")
def c9(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "score")


@query("c10_scored_only", f"select event_id, score from {SCORED} where score is not null")
def c10(spark, sf_dir):
    return op.scored_only(scored(spark, sf_dir)).select("event_id", "score")


@query(
    "c11_case_means",
    f"with c as (select 'case' || i as case_ from range(0, 15) t(i)) select c.case_ as case_name, round(coalesce(avg(score), 0), 6) as mean, count(score)::bigint as n from c left join {SCORED} s on s.case_ = c.case_ group by 1",
)
def c11(spark, sf_dir):
    cases = spark.range(15).select(F.concat(F.lit("case"), "id").alias("case"))
    out = op.case_means(scored(spark, sf_dir), cases)
    return out.select(F.col("case").alias("case_name"), F.round("mean", 6).alias("mean"), "n")


@query("c12_examples", f"select case_ as case_name, event_id from {SCORED} where upper(result) like 'YES%' qualify row_number() over (partition by case_ order by event_id) <= 4")
def c12(spark, sf_dir):
    return op.examples(scored(spark, sf_dir), 4, "event_id", "YES").select(F.col("case").alias("case_name"), "event_id")

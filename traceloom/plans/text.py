"""Queries of text shaping and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import text as op
from traceloom.plans.registry import query, table
from traceloom.sources.shared import table_in_shared


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "e1_definition_text",
    """select doc_id, case doc_id % 4 when 0 then text when 1 then lang || chr(10) || 'body: ' || source when 2 then text || chr(10) || lang else '' end as shown from documents""",
)
def e1(spark, sf_dir):
    k = F.col("doc_id") % 4
    mode = F.when(k == 0, "origin").when(k == 1, "internal").when(k == 2, "mixed").otherwise("empty")
    return docs(spark, sf_dir).select("doc_id", op.definition_text(mode, F.col("text"), F.col("lang"), F.when(k == 1, F.col("source"))).alias("shown"))


@query("e2_head_and_tail", "select doc_id, case when length(text) > 4000 then left(text, 2000) || '...' || right(text, 2000) else text end as cut, length(text) > 6000 as long from documents")
def e2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", op.head_and_tail(F.col("text"), 4000, 2000).alias("cut"), (F.length("text") > 6000).alias("long"))


@query("e3_valid_input", "select doc_id from documents where coalesce(text, '') != '' and source != 'src3'")
def e3(spark, sf_dir):
    kind = F.when(F.col("source") == "src3", "Primitive").otherwise(F.col("source"))
    return op.valid_input(docs(spark, sf_dir).withColumn("kind", kind)).select("doc_id")


@query("e4_prompt", "select doc_id, 'Explain src/' || source || ' in ' || lang || ': ' || text as prompt from documents")
def e4(spark, sf_dir):
    path = op.path_after(F.concat(F.lit("/data/train/src/"), "source"), "train/")
    return docs(spark, sf_dir).select("doc_id", op.prompt("Explain {} in {}: {}", path, F.col("lang"), F.col("text")).alias("prompt"))


@query("e5_remaining", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def e5(spark, sf_dir):
    return op.remaining(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def _length_reply(prompt: str) -> str:
    if len(prompt) > 3000:
        raise ValueError("too long")
    return str(len(prompt))


@query(
    "e6_enrichment",
    "select doc_id, case when length(text) <= 3000 then length(text)::varchar end as reply, case when length(text) > 3000 then 'ValueError: too long' end as error from documents",
)
def e6(spark, sf_dir):
    good, bad, _ = op.enriched(docs(spark, sf_dir), _length_reply, "doc_id", "text", lambda df: table_in_shared(df, "enriched"))
    return good.unionByName(bad.select("doc_id", "error"), allowMissingColumns=True)


@query("e7_clean_reply", """select event_id, props as reply from events""")
def e7(spark, sf_dir):
    raw = F.concat(F.lit("<think>maybe {x}</think>\n```json\nHere: "), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", op.clean_reply(raw).alias("reply"))


@query("e8_repair_escapes", r"""select doc_id, '{"a": "\\alpha \n ' || source || '"}' as fixed from documents""")
def e8(spark, sf_dir):
    raw = F.concat(F.lit('{"a": "\\alpha \\n '), "source", F.lit('"}'))
    return docs(spark, sf_dir).select("doc_id", op.repaired_escapes(raw).alias("fixed"))


@query("e9_required_keys", "select event_id, event_id % 3 != 2 as valid from events")
def e9(spark, sf_dir):
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.regexp_replace("props", r"\}$", ', "reason": "x"}')).when(k == 1, F.lit('{"reason": 1, "k": null, "more": []}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", op.has_keys(reply, ("k", "reason")).alias("valid"))


KINDS_OF_REPLY = list(op.REQUIRED)
# replies of every kind, good and bad: %k stands for a number
REPLIES = [
    '{"mathematical_domains": [%k], "key_concepts": [], "concept_relations": "", "intuitive_explanation": null, "dependent_premises": [], "potential_applications": "x"}',
    '{"mathematical_domains": [%k], "key_concepts": [], "concept_relations": "", "Intuitive_explanation": "", "dependent_premises": [], "potential_applications": "x"}',
    '{"tactics": [{"tactic": "a %k", "reason": "b"}, {"tactic": "c", "reason": null, "more": 1}]}', '{"Tactics": [{"tactic": "a", "reason": "b"}], "x": %k}',
    '{"tactics": [{"tactic": "a"}, {"tactic": "c", "reason": "d"}]}', '{"tactics": {"tactic": "a", "reason": "b"}}', '{"tactics": []}', '{"tactics": ["auto %k"]}', '{"tactics": "auto"}',
    '{"info": "need %k"}', '{"INFO": null}', '{"info": "x", "tactics": [{"reason": "only"}]}', '{"refined_tactic": "a", "Reason": "b %k"}', '{"refined_tactic": "a"}',
    '{"states": [%k, 2, 3]}', '{"states": [1, 2, 3, %k]}', '{"states": "1"}', '{"states": []}', '{"add": [], "remove": [%k]}', '{"add": []}',
    '{"before": {"zh": "1", "en": "2"}, "after": {"zh": "1", "en": "2"}, "tactic": {"zh": "", "en": "%k"}}', '{"before": {"zh": "1", "en": "2"}, "after": {"zh": "1"}, "tactic": {"zh": "", "en": "2"}}',
    '{"before": {"zh": "1", "en": "2"}, "after": ["zh", "en"], "tactic": {"zh": "", "en": "2"}}', '{"proof_trace": "", "steps": [], "score": %k}', '{"proof_trace": "", "steps": []}',
    '{"tactics": [', 'no object %k', '[{"tactics": []}]', '', '{}',
]


@query(
    "e9_reply_problems",
    f"""with e as (select event_id, [{", ".join(f"'{k}'" for k in KINDS_OF_REPLY)}][1 + event_id % 8] as kind, replace([{", ".join(f"'{r}'" for r in REPLIES)}][1 + (event_id // 8) % {len(REPLIES)}], '%k', user_id::varchar) as r from events),
    s as (select event_id, kind, json_valid(r) and r[1] = '{{' as ok, case when json_valid(r) and r[1] = '{{' then r else '{{}}' end as r from e), o as (select *, json_keys(r) as keys from s),
    p as (select *, case when kind in ('tactics', 'refinement', 'generation') then list_transform(keys, lambda k: lower(k)) else keys end as own, list_filter(keys, lambda k: lower(k) = 'tactics')[-1] as tk from o),
    v as (select *, case when ok and tk is not null then json_extract(r, '$."' || tk || '"') end as t from p)
    select event_id, kind, ok and case kind
      when 'enrichment' then list_has_all(own, ['mathematical_domains', 'key_concepts', 'concept_relations', 'intuitive_explanation', 'dependent_premises', 'potential_applications'])
      when 'refinement' then list_has_all(own, ['refined_tactic', 'reason']) when 'notes' then list_has_all(own, ['add', 'remove']) when 'strategy' then list_has_all(own, ['proof_trace', 'steps', 'score'])
      when 'selection' then coalesce(json_type(r, '$.states') = 'ARRAY' and json_array_length(r, '$.states') <= 3, false)
      when 'explanation' then coalesce(list_has_all(json_keys(r, '$.before'), ['zh', 'en']) and list_has_all(json_keys(r, '$.after'), ['zh', 'en']) and list_has_all(json_keys(r, '$.tactic'), ['zh', 'en']), false)
      else (t is null and kind = 'generation' and list_contains(own, 'info')) or coalesce(json_type(t) = 'ARRAY' and len(list_filter(json_extract(t, '$[*]'), lambda i: not coalesce(json_type(i) = 'OBJECT' and list_has_all(json_keys(i), ['tactic', 'reason']), false))) = 0, false)
      end as valid from v""",
)
def e9_problems(spark, sf_dir):
    kinds, replies = (F.array(*(F.lit(x) for x in own)) for own in (KINDS_OF_REPLY, REPLIES))
    reply = F.replace(F.get(replies, (F.floor(F.col("event_id") / 8) % len(REPLIES)).cast("int")), F.lit("%k"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % 8).cast("int")).alias("kind"), reply.alias("reply"))
    valid = F.when(F.lit(False), F.lit(False))
    for kind in KINDS_OF_REPLY:
        valid = valid.when(F.col("kind") == kind, op.reply_problem(F.col("reply"), kind).isNull())
    return rows.select("event_id", "kind", valid.alias("valid"))


@query("e10_lower_keys", "select doc_id, source as a, lang as strategy from documents")
def e10(spark, sf_dir):
    m = op.lower_keys(F.create_map(F.lit("KEY"), "source"))
    tail = op.strategy_tail(F.concat(F.lit("long talk, brief strategy  "), "lang"))
    return docs(spark, sf_dir).select("doc_id", F.element_at(m, "key").alias("a"), tail.alias("strategy"))


@query("e11_loose_pairs", "select doc_id, source || '|' || lang as concepts, 'about ' || lang as relation from documents")
def e11(spark, sf_dir):
    raw = F.concat(F.lit('junk "key_concepts": ["'), "source", F.lit('", "'), "lang", F.lit('"], "concept_relations" : "about '), "lang", F.lit('" and so on'))
    found = op.loose_pairs(raw, ("key_concepts", "concept_relations"), ("key_concepts",))
    return docs(spark, sf_dir).select("doc_id", F.array_join(found["key_concepts"], "|").alias("concepts"), F.array_join(found["concept_relations"], "|").alias("relation"))


@query("e12_default_row", "select event_id, case when event_id % 5 = 0 then -1 else cast(json_extract(props, '$.k') as bigint) end as k from events")
def e12(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no reply")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k long")
    good = F.when(parsed["k"].isNotNull(), parsed)
    return table(spark, sf_dir, "events").select("event_id", op.or_default(good, F.struct(F.lit(-1).cast("long").alias("k")))["k"].alias("k"))


@query("e13_embedding_input", """select doc_id, 'Instruct: find' || chr(10) || 'Query: ' || lang || chr(10) || '{"source":"' || source || '"}' as input from documents""")
def e13(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", op.embedding_input("find", F.col("lang"), F.struct("source")).alias("input"))


@query(
    "e14_unit_vectors",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * 3)) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double * 9))), 6) as total from embeddings",
)
def e14(spark, sf_dir):
    v = op.unit_vector(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def term_sql(mode: str, origin: str, internal: str) -> str:
    return f"case {mode} when 'origin' then {origin} when 'internal' then {internal} else {internal} || ' (written: ' || {origin} || ')' end"


# the states of a conversation as a step: before it all its turns, after it a state for each turn but the first
MODE_SQL = "['origin', 'internal', 'mixed'][1 + conv_id % 3]"
STATE_SQL = f"""(with t as (select conv_id, turn, role || turn || ' : ' || {term_sql(MODE_SQL, "'len ' || length(text)", "'n' || turn || ' ' || role")} as hyp, {term_sql(MODE_SQL, "text", "'g' || turn")} as goal from conversations),
 b as (select conv_id, 'hypotheses:' || chr(10) || string_agg(hyp, chr(10) order by turn) || chr(10) || 'goal: ' || arg_max(goal, turn) as before from t group by conv_id),
 a as (select conv_id, string_agg('hypotheses:' || chr(10) || hyp || chr(10) || 'goal: ' || goal, chr(10) order by turn) as after from t where turn > 0 group by conv_id)
 select b.conv_id, before, coalesce(after, '') as after from b left join a using (conv_id))"""


def states(spark, sf_dir):
    """conv_id, mode, before, after."""
    ids = lambda *x: F.array(*(c.cast("long") for c in x))
    hyp = F.struct(F.concat("role", "turn").alias("name"), F.concat(F.lit("len "), F.length("text")).alias("origin"), F.concat(F.lit("n"), "turn", F.lit(" "), "role").alias("internal"), ids(F.length("text"), F.col("turn")).alias("ids"))
    goal = F.struct(F.col("text").alias("origin"), F.concat(F.lit("g"), "turn").alias("internal"), ids(F.col("turn"), F.lit(3)).alias("ids"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", hyp.alias("h"), goal.alias("g")))).alias("t"))
    before = F.struct(F.transform("t", lambda x: x["h"]).alias("hyps"), F.element_at("t", -1)["g"].alias("goal"))
    after = F.transform(F.filter("t", lambda x: x["turn"] > 0), lambda x: F.struct(F.array(x["h"]).alias("hyps"), x["g"].alias("goal")))
    mode = F.get(F.array(F.lit("origin"), F.lit("internal"), F.lit("mixed")), (F.col("conv_id") % 3).cast("int"))
    return rows.select("conv_id", mode.alias("mode"), before.alias("before"), after.alias("after"))


@query("e15_state_text", f"select conv_id, before as state from {STATE_SQL}")
def e15(spark, sf_dir):
    return states(spark, sf_dir).select("conv_id", op.state_text(F.col("before"), F.col("mode")).alias("state"))


@query("e15_after_states", f"select conv_id, after from {STATE_SQL}")
def e15_after(spark, sf_dir):
    return states(spark, sf_dir).select("conv_id", F.array_join(op.after_texts(F.col("after"), F.col("mode")), "\n").alias("after"))


@query("e15_tactic_view", f"select conv_id, 'tactic: t' || conv_id || chr(10) || 'before:' || chr(10) || before || chr(10) || 'after:' || chr(10) || after as step from {STATE_SQL}")
def e15_tactic(spark, sf_dir):
    tactic = F.concat(F.lit("t"), "conv_id")
    return states(spark, sf_dir).select("conv_id", op.tactic_text(tactic, F.col("before"), F.col("after"), F.col("mode")).alias("step"))


@query(
    "e15_state_ids",
    """select conv_id, string_agg(id::varchar, ',' order by id) as ids from (select conv_id, length(text) as id from conversations union select conv_id, turn from conversations
    union select conv_id, 3 from conversations union select conv_id, -1 from conversations) group by conv_id""",
)
def e15_ids(spark, sf_dir):
    ids = op.state_ids(F.col("before"), F.array(F.lit(-1).cast("long"), F.lit(3).cast("long")))
    return states(spark, sf_dir).select("conv_id", F.array_join(ids, ",").alias("ids"))


@query(
    "e16_definition_cards",
    """select doc_id // 25 as batch, string_agg('## Name: ' || doc_id || chr(10) || '## Text: ' || lang || case when n_chars > 1000 then chr(10) || '## Intuition: ' || n_chars else '' end, chr(10) || chr(10) order by doc_id) as cards from documents group by doc_id // 25""",
)
def e16(spark, sf_dir):
    c = op.card(F.col("doc_id").cast("string"), F.col("lang"), F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("string")))
    return op.joined_cards(docs(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 25)), "batch", "doc_id", c)


@query(
    "e17_prompt_assembly",
    "select conv_id, turn, concat_ws(chr(10) || chr(10), '# state' || chr(10) || text, case when turn > 0 then '# trace' || chr(10) || turn end, case when role = 'user' then '# hint' || chr(10) || role end) as prompt from conversations",
)
def e17(spark, sf_dir):
    blocks = {
        "state": (F.lit(True), F.col("text")), "trace": (F.col("turn") > 0, F.col("turn").cast("string")),
        "retrieval": (F.lit(False), F.lit("x")), "hint": (F.col("role") == "user", F.col("role")),
    }
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.assembled_prompt(blocks).alias("prompt"))


CASE_NAMES = [*op.CASES, "unknown"]


@query(
    "e18_ablation_cases",
    """with c as (select custkey, c from (select c_custkey as custkey, ['no_ref_ps_all', 'no_ref_ps_origin', 'origin_only', 'internal_only', 'intuition_only', 'origin_internal', 'origin_intuition',
    'internal_intuition', 'origin_internal_intuition', 'zh_explanation', 'base', 'unknown'][1 + c_custkey % 12] as c from customer))
    select *, case when scope = 'all' and mode != 'empty' then mode else 'internal' end as state_mode from (select custkey, scope, case when c in ('origin_only', 'origin_intuition', 'no_ref_ps_origin') then 'origin'
    when c in ('internal_only', 'internal_intuition', 'zh_explanation', 'base', 'unknown') then 'internal' when c = 'intuition_only' then 'empty' else 'mixed' end as mode,
    c not in ('origin_only', 'internal_only', 'origin_internal') as intuition, not starts_with(c, 'no_ref') as definitions, c = 'base' as plain from c, (select unnest(['all', 'def_only']) as scope))""",
)
def e18(spark, sf_dir):
    names = F.array(*(F.lit(c) for c in CASE_NAMES))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.get(names, (F.col("c_custkey") % 12).cast("int")).alias("case"))
    each = lambda scope: op.with_case(rows, "case", "internal", scope=scope).withColumn("scope", F.lit(scope))
    return each("all").unionByName(each("def_only")).drop("case")


@query(
    "e19_ranking_cards",
    "select conv_id, turn, 'State ' || (row_number() over (partition by conv_id order by turn) - 1) || chr(10) || 'Tactics: ' || role || '; x' || chr(10) || 'Goals: ' || length(text) as card from conversations",
)
def e19(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return op.ranking_card(rows, "conv_id", "turn", F.array("role", F.lit("x")), F.length("text").cast("string")).select("conv_id", "turn", "card")


@query(
    "e20_trace_summary",
    "select conv_id, coalesce(string_agg(case when turn > 1 then 'step ' || turn || ': ' || role end, chr(10) order by turn), 'Initial state') as summary from conversations group by conv_id",
)
def e20(spark, sf_dir):
    block = F.when(F.col("turn") > 1, F.concat(F.lit("step "), "turn", F.lit(": "), "role"))
    return op.trace_summary(table(spark, sf_dir, "conversations"), "conv_id", "turn", block)

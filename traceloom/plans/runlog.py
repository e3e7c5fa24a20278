"""Queries of run-log and search-table analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.ordering import seeded
from traceloom.operators import runlog as op
from traceloom.plans.registry import query, table
from traceloom.sources.files import numbered_lines

STATUS = "case event_type when 'purchase' then 'COMPLETED' when 'signup' then 'SUBCOM' when 'error' then 'FAIL' when 'view' then 'SUCCESS' end"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("status", F.expr(STATUS)).withColumn("grp", F.floor(F.col("event_id") / 4)).withColumn("depth", F.col("event_id") % 9)


@query("b1_pruned_layer", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by md5('1:' || event_id), event_id) <= 3")
def b1(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("_o", seeded("1", "event_id"))
    return op.pruned_layer(e, ["user_id", "event_type"], 3, ["_o", "event_id"]).select("user_id", "event_type", "event_id")


OUTCOME = """select grp, min(case when status in ('COMPLETED', 'SUBCOM') then o end) as winner, arg_min(status, o) filter (status in ('COMPLETED', 'SUBCOM')) as status,
    bool_and(status != 'FAIL') as all_success, count(*)::bigint as n from e where status is not null group by grp"""


@query("b2_group_outcome", f"with e as (select event_id // 4 as grp, event_id as o, {STATUS} as status from events) {OUTCOME}")
def b2(spark, sf_dir):
    return op.group_outcome(events(spark, sf_dir), "grp", "event_id")


@query(
    "b3_merged_outcome",
    f"""with e as (select event_id // 4 as grp, event_id + case when event_id % 2 = 1 then 1099511627776 else 0 end as o, {STATUS} as status from events) {OUTCOME}""",
)
def b3(spark, sf_dir):
    e = events(spark, sf_dir).select("grp", "event_id", "status")
    return op.merged_outcome(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "grp", "event_id")


@query(
    "b4_try_outcome",
    "select event_id, case when event_type = 'error' then 'FAIL' when event_id % 4 = 0 then 'COMPLETED' when event_id % 4 < user_id % 4 then 'SUBCOM' when event_id % 4 = user_id % 4 then 'NO_CHANGE' else 'SUCCESS' end as outcome from events",
)
def b4(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", "failed")
    return table(spark, sf_dir, "events").select("event_id", op.try_outcome(F.col("user_id") % 4, F.col("event_id") % 4, error).alias("outcome"))


@query(
    "b5_node_paths",
    "select conv_id, turn, 'c' || conv_id || '@' || row_number() over (partition by conv_id order by turn) || case when turn % 4 > 1 then '-1/' || turn % 4 else '' end as node from conversations",
)
def b5(spark, sf_dir):
    return op.node_paths(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat(F.lit("c"), "conv_id"), F.col("turn") % 4).select("conv_id", "turn", "node")


@query("b6_popped_goals", "select conv_id, case when count(*) > 1 then string_agg(turn::varchar, ',' order by turn) || '|' || string_agg(case when turn > 0 then turn::varchar end, ',' order by turn) else '0' end as left_ from conversations group by conv_id")
def b6(spark, sf_dir):
    turns = F.sort_array(F.collect_list("turn"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    left = op.popped(F.array("t", "t"))
    return rows.select("conv_id", F.array_join(F.transform(left, lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("left_"))


@query(
    "b7_updated_notes",
    """with n as (select conv_id, row_number() over (partition by conv_id order by part, turn) - 1 as pos, note from (
    select conv_id, turn, 0 as part, role || turn as note from conversations where turn not in (1, 9) union all select distinct conv_id, 0, 1, 'new' from conversations))
    select conv_id, string_agg(note, ',' order by pos) as notes from (select * from n qualify row_number() over (partition by conv_id order by md5('3:' || conv_id || ':' || pos), pos) <= 4) group by conv_id""",
)
def b7(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", "turn").alias("note"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["note"]).alias("notes"))
    rows = rows.withColumns({"remove": F.array(F.lit(9), F.lit(1)), "add": F.array(F.lit("new"))})
    return op.updated_notes(rows, "conv_id", 4, "3").withColumn("notes", F.array_join("notes", ","))


@query("b8_note_candidates", "select conv_id, 'Note from trace: ' || arg_max(role || turn, turn) as note from conversations group by conv_id")
def b8(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", "turn").alias("t"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["t"]).alias("traces"))
    return rows.select("conv_id", op.note_candidate(F.col("traces"), "Note from trace: %s").alias("note"))


@query(
    "b9_flattened_log",
    """select event_id, 'p' as path, unnest(['a', 'b']) as node, unnest(['fail', 'success']) as status, unnest([json_extract(props, '$.k')::bigint, 1]) as depth, unnest([2, 1])::bigint as ord from events""",
)
def b9(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit('{"p": {"items_info": {"a": {"status": "fail", "depth": '), k, F.lit('}, "b": {"status": "success", "depth": 1}}}}'))
    return op.flattened_log(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line", "event_id")


@query(
    "b10_outcome_records",
    "select doc_id as file, case when doc_id % 2 = 0 then 'SUCCEEDED' else 'FAILED' end as status, 'd' || doc_id as name, source || '.log' as log_file, n_chars % 7 as depth from documents where doc_id % 5 != 0",
)
def b10(spark, sf_dir):
    state = F.when(F.col("doc_id") % 2 == 0, "SUCCEEDED").otherwise("FAILED")
    last = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("depth: "), F.col("n_chars") % 7)).otherwise(F.lit("cut off"))
    text = F.concat_ws("\n", F.lit("noise"), F.concat(state, F.lit(": d"), "doc_id", F.lit(" more")), F.concat(F.lit("log_file: "), "source", F.lit(".log")), F.lit("proof_time: 3 seconds"), last)
    docs = table(spark, sf_dir, "documents").withColumn("text", text)
    return op.outcome_records(numbered_lines(docs, "doc_id", "text"))


@query(
    "b11_resume",
    "select o_orderkey, 'new' as why from orders where o_orderkey not in (select l_orderkey from lineitem) union all select o_orderkey, 'failed' from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having not bool_or(l_returnflag = 'R'))",
)
def b11(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select("o_orderkey")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "SUCCEEDED").otherwise("FAILED").alias("status"))
    return op.resumed(work, log, "o_orderkey").withColumn("why", F.lit("new")).unionByName(op.resumed(work, log, "o_orderkey", True).withColumn("why", F.lit("failed")))


@query(
    "b12_stratified",
    f"""with e as (select event_id, {STATUS} as status, case when event_id % 40 = 0 then user_id % 5 else 3 + user_id % 6 end as depth, md5('2:' || event_id) as o from events),
    r as (select *, row_number() over (partition by status, depth order by o, event_id) as r from e),
    own as (select event_id, status, depth, depth as stratum from r where depth <= 4 and r <= 60),
    short as (select status, stratum, 60 - count(*) as n from own group by all having count(*) < 60),
    more as (select r.event_id, r.status, r.depth, r.depth - 2 as stratum from r join short s on s.status is not distinct from r.status and s.stratum = r.depth - 2 where (r.depth > 4 or r.r > 60)
    qualify row_number() over (partition by r.status, r.depth order by o, event_id) <= s.n) select * from own union all select * from more""",
)
def b12(spark, sf_dir):
    depth = F.when(F.col("event_id") % 40 == 0, F.col("user_id") % 5).otherwise(3 + F.col("user_id") % 6)
    e = events(spark, sf_dir).select("event_id", "status", depth.alias("depth"))
    return op.stratified(e, "event_id", 60, 4, "2")


@query(
    "b13_prompt_at_depth",
    """with n as (select conv_id, turn as depth, turn as ord, [role, 't' || turn, 'last'] as tactics from conversations), w as (select conv_id, max(turn) as d from conversations group by 1)
    select n.conv_id, n.depth, arg_min(tactics[1] || ',' || tactics[2], ord) as tactics, min(ord) as ord from n join w on n.conv_id = w.conv_id and n.depth = case when d > 4 then d - 2 else d end group by all""",
)
def b13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    nodes = rows.select("conv_id", F.col("turn").alias("depth"), F.col("turn").alias("ord"), F.array("role", F.concat(F.lit("t"), "turn"), F.lit("last")).alias("tactics"))
    wanted = rows.groupBy("conv_id").agg(F.max("turn").alias("depth"))
    return op.prompt_at_depth(nodes, wanted, "conv_id").withColumn("tactics", F.array_join("tactics", ","))


@query("b14_prompt_sample", "select conv_id, turn from conversations order by md5('7:' || conv_id || ':' || turn), conv_id, turn limit 200")
def b14(spark, sf_dir):
    return op.prompt_sample(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 200, "7")


@query(
    "b15_plain_prompt",
    "select doc_id, replace(array_to_string(list_filter(string_split(split_part(text || chr(10) || 'x ## Internal y', 'zz', 1), chr(10)), lambda x: not contains(x, '## Internal')), chr(10)), 'the', 'THE') || ' end.' as prompt from documents",
)
def b15(spark, sf_dir):
    text = F.concat("text", F.lit("\nx ## Internal y"))
    return table(spark, sf_dir, "documents").select("doc_id", op.plain_prompt(text, "zz", " end.", "the", "THE").alias("prompt"))

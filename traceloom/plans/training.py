"""Queries of training-pair preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import training as op
from traceloom.plans.registry import query, table


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(
    "f1_proofs",
    "select c_custkey, o_orderkey, true as has from customer join orders on o_custkey = c_custkey where c_mktsegment = 'HOUSEHOLD' union all select c_custkey, null, false from customer where c_mktsegment = 'HOUSEHOLD' and c_custkey not in (select o_custkey from orders)",
)
def f1(spark, sf_dir):
    d = table(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").select("c_custkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    met, missing = op.proofs(d, e, "c_custkey")
    return met.withColumn("has", F.lit(True)).unionByName(missing.withColumn("has", F.lit(False)), allowMissingColumns=True)


@query("f2_open_steps", "select conv_id as episode, turn + 1 as i from conversations where turn + 1 > conv_id % 4")
def f2(spark, sf_dir):
    steps = turns(spark, sf_dir).select(F.col("conv_id").alias("episode"), (F.col("turn") + 1).alias("i"))
    return op.open_steps(steps, steps.where("i <= episode % 4"))


@query("f3_history", "select conv_id, turn, coalesce(string_agg(role || turn, ';') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as history from conversations")
def f3(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("v", F.concat("role", "turn"))
    return op.with_history(rows, "conv_id", "turn", "v").select("conv_id", "turn", F.array_join("history", ";").alias("history"))


@query("f4_notes", "select conv_id, turn, string_agg('note ' || turn || ': ' || role, chr(10)) over (partition by conv_id order by turn) as notes from conversations")
def f4(spark, sf_dir):
    return op.with_notes(turns(spark, sf_dir), "conv_id", "turn", F.format_string("note %d: %s", "turn", "role")).select("conv_id", "turn", "notes")


@query("f5_pairs", "select text as prompt, role as target from conversations")
def f5(spark, sf_dir):
    return op.pairs(turns(spark, sf_dir).select(F.col("text").alias("prompt"), F.col("role").alias("tactic")))


WORDS = "list_filter(string_split(text, ' '), lambda x: x != '')"


def words():
    return F.filter(F.split("text", " "), lambda x: x != "")


@query(
    "f6_length_control",
    f"""select conv_id, turn, case when len(p) > room then array_to_string(list_concat(p[1:room // 2], p[len(p) - (room - room // 2) + 1:]), ' ') else array_to_string(p, ' ') end as prompt, array_to_string(t, ' ') as target
    from (select conv_id, turn, p, p[1:10] as t, 30 - least(len(p), 10) as room from (select conv_id, turn, {WORDS} as p from conversations))""",
)
def f6(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", words().alias("w"))
    p, t = op.fitted(F.col("w"), F.col("w"), 32, 10)
    return rows.select("conv_id", "turn", F.array_join(p, " ").alias("prompt"), F.array_join(t, " ").alias("target"))


@query("f7_long_share", f"select round(avg(case when len({WORDS}) > 40 then 1.0 else 0.0 end), 8) as share from conversations")
def f7(spark, sf_dir):
    return op.long_share(turns(spark, sf_dir), words(), 40).select(F.round("share", 8).alias("share"))


@query(
    "f8_sequences",
    """with s as (select conv_id, turn, list_concat([1], range(100, 100 + turn), [7, 8], [2]) as i, list_concat(list_transform(range(0, turn + 1), lambda x: -100), [7, 8], [2]) as l from conversations),
    m as (select *, max(len(i)) over (partition by conv_id) - len(i) as gap from s)
    select conv_id, turn, array_to_string(list_concat(i, list_transform(range(0, gap), lambda x: 0)), ',') as ids, array_to_string(list_concat(list_transform(i, lambda x: 1), list_transform(range(0, gap), lambda x: 0)), ',') as mask,
    array_to_string(list_concat(l, list_transform(range(0, gap), lambda x: -100)), ',') as labels from m""",
)
def f8(spark, sf_dir):
    prompt = F.when(F.col("turn") > 0, F.sequence(F.lit(100).cast("long"), F.col("turn") + 99)).otherwise(F.array().cast("array<bigint>"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", prompt.cast("array<int>").alias("p"), F.array(F.lit(7), F.lit(8)).alias("t"))
    out = op.sequences(rows, "conv_id", "p", "t", 512)
    return out.select("conv_id", "turn", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "mask", "labels")))


@query("f9_whitened", "select event_id, round((value - m) / sqrt(v + 1e-6), 6) as white from events, (select avg(value) as m, var_pop(value) as v from events where event_type != 'error')")
def f9(spark, sf_dir):
    return op.whitened(table(spark, sf_dir, "events"), "value", F.col("event_type") != "error").select("event_id", F.round("white", 6).alias("white"))


WEIGHTS = "(select l_suppkey as s, l_partkey as p, sum(l_quantity) / 50 as w from lineitem group by all)"


def weights(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg((F.sum("l_quantity") / 50).alias("w"))


@query(
    "f10_softmax_nucleus",
    f"""with e as (select s, p, exp(w - max(w) over (partition by s)) as e from {WEIGHTS}), q as (select s, p, e / sum(e) over (partition by s) as prob from e),
    n as (select *, sum(prob) over (partition by s order by round(prob, 9) desc, p rows unbounded preceding) - prob as b, row_number() over (partition by s order by round(prob, 9) desc, p) as r from q),
    h as (select s, -sum(prob * ln(prob)) as h from q group by s)
    select n.s, count(*)::bigint as n, round(max(prob) / sum(prob), 4) as top, round(max(h), 5) as entropy from n join h using (s) where b < 0.5003 or r <= 2 group by n.s""",
)
def f10(spark, sf_dir):
    logs = op.log_softmax(weights(spark, sf_dir), "s", "w")
    items = logs.withColumnRenamed("p", "part").withColumn("prob", F.exp("logp"))
    kept = op.nucleus(items, "s", "part", "prob", 0.5003, 2)
    summary = kept.groupBy("s").agg(F.count("*").alias("n"), F.round(F.max("p"), 4).alias("top"))
    return summary.join(op.group_entropy(logs, "s").withColumn("entropy", F.round("entropy", 5)), "s")


@query("f11_perplexity", "select event_type, round(avg(value / 100), 6) as loss, round(exp(avg(value / 100)), 4) as perplexity from events group by event_type")
def f11(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("loss", F.col("value") / 100)
    return op.perplexity(rows, "loss", "event_type").select("event_type", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))

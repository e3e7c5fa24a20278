"""Queries of retrieval, candidates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import retrieval as op
from traceloom.plans.registry import query, table

DOT = "100 * list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double))"
RANKED = f"""(select q.vec_id as query, e.vec_id as name, {DOT} as score, e.label from embeddings q, embeddings e where q.vec_id % 50 = 0)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"), "label")


def asked(spark, sf_dir):
    return vectors(spark, sf_dir).where("name % 50 = 0").select(F.col("name").alias("query"), "v")


def kinds(spark, sf_dir):
    return op.split_kinds(vectors(spark, sf_dir), F.col("label") == 0)


@query("r1_split_kinds", "select vec_id as name, case when label = 0 then 'tactic' else 'premise' end as kind from embeddings")
def r1(spark, sf_dir):
    t, p = kinds(spark, sf_dir)
    return t.select("name", F.lit("tactic").alias("kind")).unionByName(p.select("name", F.lit("premise").alias("kind")))


@query("r2_top_k", f"select query, name, round(score, 6) as score, row_number() over (partition by query order by score desc, name) as rank from {RANKED} where label != 0 qualify rank <= 10")
def r2(spark, sf_dir):
    return op.top_k(asked(spark, sf_dir), kinds(spark, sf_dir)[1], 10).withColumn("score", F.round("score", 6))


@query(
    "r3_top_k_of_both",
    f"""select query, name, case when label = 0 then 'tactic' else 'premise' end as kind, row_number() over (partition by query, label = 0 order by score desc, name) as rank
    from {RANKED} qualify rank <= case when label = 0 then 5 else 10 end""",
)
def r3(spark, sf_dir):
    t, p = kinds(spark, sf_dir)
    return op.top_k_of_both(asked(spark, sf_dir), p, t, 10).select("query", "name", "kind", "rank")


@query(
    "r4_explanations",
    "select d.doc_id as name, case when d.doc_id % 3 = 0 then 'p ' || lang when l.doc_id is not null then 't ' || quality else '' end as explanation from documents d left join (select distinct doc_id, quality from labels) l using (doc_id)",
)
def r4(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    premises = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("name"), F.concat(F.lit("p "), "lang").alias("explanation"))
    tactics = labels.select(F.col("doc_id").alias("name"), F.concat(F.lit("t "), "quality").alias("explanation")).distinct()
    return op.explained(docs.select(F.col("doc_id").alias("name")), premises, tactics)


@query(
    "r5_context",
    f"""select query, 'v' || name as name, 'vector ' || label as text from (select *, row_number() over (partition by query order by score desc, 'v' || name) as rank from {RANKED} qualify rank <= 10)
    where name != case when query % 3 = 0 then query + 1 else query end and label != 3""",
)
def r5(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), "name"))
    items = v.select("name", F.when(F.col("label") == 3, "Primitive").otherwise("Definition").alias("kind"), F.concat(F.lit("vector "), "label").alias("text"))
    own = asked(spark, sf_dir)
    k = F.col("query") % 3
    # the item at work: the query's own, one of its parts, or, in every third, another
    at_work = F.when(k == 0, F.concat(F.lit("v"), F.col("query") + 1)).when(k == 1, F.concat(F.lit("v"), "query")).otherwise(F.concat(F.lit("v"), "query", F.lit("_subproof2")))
    return op.context(op.top_k(own, v, 10), items, own.select("query", at_work.alias("current"))).select("query", "name", "text")


@query(
    "r6_citing_steps",
    "select distinct l_orderkey as episode, l_linenumber::bigint as step from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_partkey >= 100 and l_suppkey % 2 = 0",
)
def r6(spark, sf_dir):
    name = F.when(F.col("l_suppkey") % 2 == 0, "a.b").otherwise("ab")
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").cast("long").alias("step"), F.col("l_partkey").alias("id"), name.alias("name"))
    theorems = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("episode"))
    return op.citing_steps(tokens, 100, theorems)


@query(
    "r7_multiple_choice",
    f"""with n as (select query, name from {RANKED} qualify row_number() over (partition by query order by score desc, name) <= 10), g as (select distinct query, (query * 7) % 100 as gold from n),
    c as (select query, name from n union select query, gold from g), s as (select c.*, gold, row_number() over (partition by query order by md5('9:' || query || ':' || name)) - 1 as pos from c join g using (query))
    select query, string_agg(name::varchar, ',' order by pos) as choices, max(case when name = gold then pos end) as gold_at,
      coalesce(string_agg('ID ' || pos || ': DEFINITION v' || name || ' of ' || label, chr(10) order by pos) filter (where label not in (3, 0)), '') as cards
    from s join embeddings e on e.vec_id = s.name group by query""",
)
def r7(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ranked = op.top_k(asked(spark, sf_dir), v, 10)
    gold = asked(spark, sf_dir).select("query", ((F.col("query") * 7) % 100).alias("gold"))
    kind = F.when(F.col("label") == 3, "Primitive").when(F.col("label") == 0, "Ltac").otherwise("Definition")
    items = v.select("name", kind.alias("kind"), F.concat(F.lit("DEFINITION v"), "name", F.lit(" of "), "label").alias("text"))
    return op.multiple_choice(ranked, gold, "9", items).withColumns({"choices": F.array_join("choices", ","), "cards": F.array_join("cards", "\n")})


REFS = "(select distinct l_orderkey as item, l_partkey as ref from lineitem)"


def references(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("ref"))


@query(
    "r8_relation_pairs",
    f"select item, ref from (select *, count(*) over (partition by item) as n from {REFS}) where n > 2 qualify row_number() over (partition by item order by md5('4:' || item || ':' || ref), ref) <= 2",
)
def r8(spark, sf_dir):
    return op.relation_pairs(references(spark, sf_dir), "4")


@query(
    "r9_weighted_sample",
    """select s, p, w from (select l_suppkey as s, l_partkey as p, count(*)::bigint as w from lineitem where l_partkey != 7 group by all)
    qualify row_number() over (partition by s order by ln((cast('0x' || substr(md5('2:' || s || ':' || p), 1, 13) as bigint) + 0.5) / 4503599627370496.0) / w desc, p) <= 5""",
)
def r9(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("w"))
    return op.weighted_sample(counts, "s", "p", "w", 5, "2", (7,))


@query(
    "r10_example_steps",
    """select l_partkey as concept, l_returnflag as tactic, l_orderkey as step from (select distinct l_partkey, l_returnflag, l_orderkey from lineitem where l_orderkey % 5 != 0)
    qualify row_number() over (partition by l_partkey, l_returnflag order by md5('6:' || l_partkey || ':' || l_returnflag || ':' || l_orderkey), l_orderkey) = 1""",
)
def r10(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_returnflag").alias("tactic"), F.col("l_orderkey").alias("step")).distinct()
    current = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("step"))
    stray = pairs.where("step % 5 = 0").select("step")
    return op.example_step(pairs, current.unionByName(stray), "6").select("concept", "tactic", "step")


@query(
    "r11_concept_sample",
    f"""with k as (select item, ref as id, md5('8:' || item || ':' || ref) as o from {REFS}),
    a as (select item, id from k where id % 4 = 0 qualify row_number() over (partition by item order by o, id) <= 2),
    b as (select item, id from k where item not in (select item from a) qualify row_number() over (partition by item order by o, id) <= 2) select * from a union all select * from b""",
)
def r11(spark, sf_dir):
    refs = references(spark, sf_dir).withColumnRenamed("ref", "id")
    wanted = refs.where("id % 4 = 0").select("id")
    return op.concept_sample(refs, wanted, 2, "8").select("item", "id")


@query("r12_kind_sample", "select doc_id, lang as kind from documents where lang in ('en', 'de') order by md5('3:' || doc_id), doc_id limit 100")
def r12(spark, sf_dir):
    return op.kind_sample(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind")), ["en", "de"], "doc_id", 100, "3")


@query(
    "r13_work_list",
    "select o_orderkey from orders where o_orderpriority like '1-%' order by md5('5:' || o_orderkey), o_orderkey limit (select greatest(1, floor(count(*) * 0.1))::bigint from orders where o_orderpriority like '1-%')",
)
def r13(spark, sf_dir):
    return op.work_list(table(spark, sf_dir, "orders").where("o_orderpriority like '1-%'").select("o_orderkey"), "o_orderkey", 0.1, "5")

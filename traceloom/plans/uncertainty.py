"""Queries of uncertainty metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import uncertainty as op
from traceloom.plans.registry import query, table

STATUS = "case event_type when 'purchase' then 'completed' when 'error' then 'fail' else 'normal' end"


@query(
    "u1_token_entropy",
    """with l as (select l_orderkey, list(-l_quantity / 10 order by l_partkey, l_suppkey, l_quantity) as a from lineitem group by 1), e as (select l_orderkey, a, list_transform(a, lambda x: exp(x - list_max(a))) as e from l)
    select l_orderkey, round(-list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e) + 1e-8))), 6) + 0.0 as entropy, round(list_stddev_pop(a), 6) as std from e""",
)
def u1(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(ordered, lambda x: -x["l_quantity"] / 10).alias("a"))
    return rows.select("l_orderkey", (F.round(op.entropy_of_logs(F.col("a")), 6) + 0.0).alias("entropy"), F.round(op.array_std(F.col("a")), 6).alias("std"))


@query(
    "u2_meaningful_span",
    """select doc_id, array_to_string(list_filter(string_split('pre [ " ' || source || ' : ' || lang || ' , x ] post', ' '), lambda t: t not in ('pre', '[', '"', ':', ',', ']', 'post')), ' ') as span from documents""",
)
def u2(spark, sf_dir):
    tokens = F.split(F.concat(F.lit('pre [ " '), "source", F.lit(" : "), "lang", F.lit(" , x ] post")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(op.meaningful(tokens), " ").alias("span"))


@query(
    "u3_response_means",
    """with l as (select conv_id, list(length(text)::double order by turn) as a from conversations group by 1)
    select conv_id, round(list_avg(a), 6) as all_, a[1] as first_, round(list_avg(a[1:5]), 6) as five from l""",
)
def u3(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["n"]).alias("a"))
    m = op.response_means(F.col("a"))
    return rows.select("conv_id", F.round(m["all"], 6).alias("all_"), m["first"].alias("first_"), F.round(m["five"], 6).alias("five"))


@query("u4_nested_mean", "select user_id, round(avg(m), 6) as mean from (select user_id, event_type, avg(value) as m from events group by all) group by user_id")
def u4(spark, sf_dir):
    return op.mean_of_means(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("u5_flatten", "select conv_id, string_agg(role || ',' || turn || ',' || role || ',' || turn, ',' order by turn) as flat from conversations group by conv_id")
def u5(spark, sf_dir):
    pair = F.array("role", F.col("turn").cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.array(pair, pair).alias("x"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["x"]).alias("n"))
    return rows.select("conv_id", F.array_join(op.flattened(F.col("n"), 2), ",").alias("flat"))


MEANS = """x as (select label, vec_id, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as d from embeddings), m as (select label, d, avg(x) as m from x group by all)"""


@query(
    "u6_semantic_entropy",
    f"""with {MEANS}, c as (select label, vec_id, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) as c from x join m using (label, d) group by all), z as (select label, sum(exp(c)) as z from c group by 1)
    select label, round(-sum(exp(c) / z * ln(exp(c) / z + 1e-8)), 5) as entropy from c join z using (label) group by label""",
)
def u6(spark, sf_dir):
    return op.semantic_entropy(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("entropy", F.round("entropy", 5))


COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)) / sqrt(list_sum(list_transform(a.embedding, lambda p: p::double * p::double)) * list_sum(list_transform(b.embedding, lambda p: p::double * p::double)))"


@query(
    "u7_pairwise_cosine",
    f"""with c as (select a.vec_id // 20 as g, {COS} as c from embeddings a join embeddings b on a.vec_id // 20 = b.vec_id // 20 and a.vec_id < b.vec_id)
    select g, round(avg(c), 6) as mean, round(max(c), 6) as max, round(min(c), 6) as min, round(median(c), 6) as median, round(stddev_pop(c), 6) as std from c group by g""",
)
def u7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 20))
    return op.pairwise_cosine(rows, "g", "vec_id", "embedding").select("g", *(F.round(c, 6).alias(c) for c in ("mean", "max", "min", "median", "std")))


@query("u8_cluster_entropy")
def u8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 50))
    return op.cluster_entropy(rows, "g", "vec_id", "embedding")


@query("u8_cluster_entropy_of_all")
def u8_all(spark, sf_dir):
    return op.cluster_entropy_of_all(table(spark, sf_dir, "embeddings"), "embedding", 4)


@query("u9_edit_similarity")
def u9(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("g", F.floor(F.col("item_id") / 8))
    return op.edit_similarity(rows, "g", "item_id", "text")


@query("u10_text_clusters")
def u10(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("g", F.floor(F.col("item_id") / 10))
    return op.text_clusters(rows, "g", "item_id", "text")


@query("u11_levenshtein_pairs", "select a.p_partkey as a, b.p_partkey as b, levenshtein(a.p_name, b.p_name) as distance from part a join part b on a.p_partkey // 20 = b.p_partkey // 20 and a.p_partkey < b.p_partkey")
def u11(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("g", F.floor(F.col("p_partkey") / 20))
    return op.levenshtein_pairs(rows, "g", "p_partkey", "p_name")


@query(
    "u12_grouping_sets",
    f"""with e as (select {STATUS} as status, user_id % 6 as depth, value from events where event_id % 10 != 0)
    select status, depth, grouping_id(status, depth)::bigint as level, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*)::bigint as n from e group by grouping sets ((), (status), (depth), (depth, status))""",
)
def u12(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr(STATUS).alias("status"), (F.col("user_id") % 6).alias("depth"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    return op.grouped_metrics(e, "value").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("u13_side_by_side", "select event_id, unnest(['full', 'plain']) as metric, unnest([value, value / 2]) as value from events")
def u13(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("full"), (F.col("value") / 2).alias("plain"))
    return op.side_by_side(rows, "event_id", ["full", "plain"])


@query(
    "u14_digit_distribution",
    """with w as (select l_suppkey as g, l_linenumber as d, sum(l_quantity) as w from lineitem group by all), f as (select g, d from (select distinct g from w), (select unnest(range(0, 10)) as d)),
    p as (select g, coalesce(w, 0) / sum(w) over (partition by g) as p from f left join w using (g, d)), m as (select g, avg(p) as m from p group by g)
    select g, round(-sum(p * ln(p + 1e-8)), 6) as entropy, round(avg(pow(p - m, 4)) / pow(avg(pow(p - m, 2)), 2) - 3, 5) as kurtosis from p join m using (g) group by g""",
)
def u14(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").cast("string").alias("t"), "l_quantity")
    return op.digit_distribution(rows, "g", "t", "l_quantity").select("g", F.round("entropy", 6).alias("entropy"), F.round("kurtosis", 5).alias("kurtosis"))


PROBS = "(select vec_id, unnest(range(1, len(embedding) + 1)) as item, unnest(embedding)::double as prob, label as gold from embeddings)"


def probabilities(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("gold"), F.posexplode("embedding").alias("item", "prob"))
    return rows.select("vec_id", "gold", (F.col("item") + 1).cast("long").alias("item"), F.col("prob").cast("double").alias("prob"))


@query("u15_gold_in_top", f"select vec_id, bool_or(r <= 3 and item = gold) as hit from (select *, row_number() over (partition by vec_id order by prob desc, item) as r from {PROBS} where prob > 0) group by vec_id")
def u15(spark, sf_dir):
    return op.in_top(probabilities(spark, sf_dir), "vec_id", "item", "prob", "gold")


@query(
    "u16_method_report",
    """select lang as method, round(avg(quality::double), 6) as accuracy, round(avg(case when quality + toxic > 0 then 1.0 else 0 end), 6) as top3, round(avg(n_chars / 1000), 6) as entropy, round(stddev_pop(n_chars / 1000), 6) as entropy_std, count(*)::bigint as n
    from documents join labels using (doc_id) group by lang""",
)
def u16(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("lang").alias("method"), (F.col("quality") == 1).alias("right"), (F.col("quality") + F.col("toxic") > 0).alias("top3"), (F.col("n_chars") / 1000).alias("entropy")
    )
    return op.method_report(rows, "method").withColumns({c: F.round(c, 6) for c in ("accuracy", "top3", "entropy", "entropy_std")})


@query("u17_positional_resume", "select event_id, user_id from events order by event_id offset 100")
def u17(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    last = e.orderBy("event_id").limit(100).agg(F.max_by("user_id", "event_id")).first()[0]
    return op.resumed_after(e, "user_id", "event_id", 100, last)


@query(
    "u18_dashboard",
    f"""with c as (select a.label as g, {COS} as c from embeddings a join embeddings b on a.vec_id // 20 = b.vec_id // 20 and a.vec_id < b.vec_id)
    select g, round(avg(c), 6) as c_mean, round(stddev_pop(c), 6) as c_std, round(avg(c * 2), 6) as d_mean, round(stddev_pop(c * 2), 6) as d_std from c group by g""",
)
def u18(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("b", F.floor(F.col("vec_id") / 20))
    other = v.select("b", F.col("vec_id").alias("_o"), F.col("embedding").alias("_e"))
    pairs = v.join(other, "b").where("vec_id < _o").select(F.col("label").alias("g"), op.cosine(F.col("embedding"), F.col("_e")).alias("c"))
    out = op.dashboard(pairs.withColumn("d", F.col("c") * 2), "g", ["c", "d"])
    return out.select("g", *(F.round(c, 6).alias(c) for c in ("c_mean", "c_std", "d_mean", "d_std")))


@query(
    "u19_complete_samples",
    "select user_id, event_type, event_id from events where user_id in (select user_id from events where event_type in ('view', 'click', 'purchase', 'error') group by user_id having count(distinct event_type) = 4)",
)
def u19(spark, sf_dir):
    return op.complete(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase", "error"]).select("user_id", "event_type", "event_id")

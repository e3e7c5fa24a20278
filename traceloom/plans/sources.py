"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.operators import sources as op
from traceloom.plans.registry import LINES_SQL, query, table
from traceloom.sources import files
from traceloom.sources.shared import scratch

EVENT = "event_id long, user_id long, event_type string, value double"


@query("s1_read_jsonl", "select event_id, user_id, event_type, value from events")
def s1(spark, sf_dir):
    path = scratch(spark, "s1")
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_jsonl(spark, path, EVENT)


@query(
    "s2_read_json",
    """select n_nationkey as key, n_name as name, null as n from nation union all select r_regionkey, r_name, 2 from region
    union all select s_suppkey, s_name, null from supplier where s_suppkey % 10 != 3""",
)
def s2(spark, sf_dir):
    """A folder with documents in one line, pretty ones that hold one-line objects, and JSON Lines with bad lines."""
    path = scratch(spark, "s2")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    nation.agg(F.to_json(F.collect_list(F.struct("key", "name")))).coalesce(1).write.text(f"{path}/a")
    items = F.lit('"items": [\n{"at": 1},\n{"at": 2}\n]')
    pretty = F.concat(F.lit('{\n"key": '), "r_regionkey", F.lit(',\n"name": "'), "r_name", F.lit('",\n'), items, F.lit("\n}\n"))
    table(spark, sf_dir, "region").select(pretty.alias("value"), "r_regionkey").repartitionByRange("r_regionkey").write.partitionBy("r_regionkey").text(f"{path}/b")
    line = F.when(F.col("s_suppkey") % 10 == 3, F.lit('{"key": ')).otherwise(F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))))
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(f"{path}/c")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("items", T.ArrayType(T.StructType([T.StructField("at", T.LongType())])))])
    rows = files.read_json(spark, f"{path}/*/*.txt", schema).unionByName(files.read_json(spark, f"{path}/b/*", schema))
    return rows.select("key", "name", F.when(F.col("items").isNotNull(), F.size("items")).alias("n"))


@query("s3_numbered_lines", f"select file, line_no, line from {LINES_SQL}")
def s3(spark, sf_dir):
    return files.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("s4_read_tree", "select r_regionkey, r_name from region union all select n_nationkey, n_name from nation")
def s4(spark, sf_dir):
    path = scratch(spark, "s4")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.json(f"{path}/a/b")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")).write.json(f"{path}/c")
    return files.read_tree(spark, path, "r_regionkey int, r_name string")


@query("s5_write_jsonl", "select s_suppkey, s_name, 2::bigint as n from supplier")
def s5(spark, sf_dir):
    path, rows = scratch(spark, "s5"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files.write_jsonl(rows, path)
    files.write_jsonl(rows, path, append=True)
    return files.read_jsonl(spark, path, rows.schema).groupBy("s_suppkey", "s_name").agg(F.count("*").alias("n"))


@query("s6_write_document", "select '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as document from nation")
def s6(spark, sf_dir):
    path = scratch(spark, "s6")
    files.write_document(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query(
    "s7_flag_table",
    """select r_name as package, (row_number() over (partition by r_name order by n_name)) - 1 as ordinal,
    case when n_nationkey % 3 = 1 then '-Q' else '-R' end as flag, 'dir' || n_nationkey as dir, n_name as alias
    from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 < 2 or true qualify n_nationkey % 3 < 2""",
)
def s7(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flag = F.when(F.col("n_nationkey") % 3 == 1, "-Q").when(F.col("n_nationkey") % 3 == 2, "-I").otherwise("-R")
    rule = F.concat(flag, F.lit(" dir"), F.col("n_nationkey"), F.lit(" "), F.col("n_name"))
    rules = nation.groupBy(F.col("r_name").alias("package")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_name", rule.alias("rule")))), lambda x: x["rule"]).alias("rules")
    )
    return op.flag_table(rules)


@query(
    "s8_tolerant_json",
    "select event_id, case when event_id % 4 = 3 then null else cast(json_extract(props, '$.k') as bigint) end as k from events",
)
def s8(spark, sf_dir):
    props = F.col("props")
    text = (
        F.when(F.col("event_id") % 4 == 1, F.translate(props, '"', "'"))
        .when(F.col("event_id") % 4 == 2, F.translate(props, '"', ""))
        .when(F.col("event_id") % 4 == 3, F.concat(F.lit("{"), props))
        .otherwise(props)
    )
    parsed = op.tolerant_json(text, T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "s9_list_codec",
    "select vec_id, len(embedding)::bigint as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings",
)
def s9(spark, sf_dir):
    decoded = op.decode_list(op.encode_list(F.col("embedding")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", decoded.alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query(
    "s10_contiguous_shards",
    "select doc_id, least((row_number() over (order by doc_id) - 1) // greatest(1, (select count(*) from documents) // 7), 6)::bigint as shard from documents",
)
def s10(spark, sf_dir):
    return op.contiguous_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query(
    "s11_shuffled_shards",
    "select o_orderkey, least((row_number() over (order by md5('17:' || o_orderkey), o_orderkey) - 1) // greatest(1, (select count(*) from orders) // 5), 4)::bigint as shard from orders",
)
def s11(spark, sf_dir):
    return op.shuffled_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, "17")


@query(
    "s12_split_log",
    f"""select file, line_no, part::bigint as part, path from (
    select file, line_no, line, sum(case when h then 1 else 0 end) over w as part,
    last_value(case when h then regexp_extract(line, '^Th([a-z]+)', 1) end ignore nulls) over w as path
    from (select *, regexp_matches(line, '^Th([a-z]+)') as h from {LINES_SQL})
    window w as (partition by file order by line_no rows between unbounded preceding and current row)) where part > 0""",
)
def s12(spark, sf_dir):
    lines = files.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return op.split_log(lines, "^Th([a-z]+)").select("file", "line_no", "part", "path")

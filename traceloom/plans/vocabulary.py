"""Queries of vocabulary, ids and cross-references."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import resolution as res
from traceloom.operators import traces as tr
from traceloom.operators import vocabulary as op
from traceloom.plans.registry import query, table
from traceloom.plans.traces import DEFS_SQL, EDGES_SQL, STEPS_SQL, defs, edges, steps
from traceloom.sources.shared import table_in_shared

TOK = r"(select item, pos, token from (select doc_id as item, unnest(range(1, len(t) + 1)) as pos, unnest(t) as token from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x != '') as t from documents)))"
SEEN = f"(select token, min(item * 1000000 + pos) as ord from {TOK} group by token)"
VOCAB = f"(select token, row_number() over (order by ord) + 999 as id from {SEEN} where token not in ('the', 'of', 'and'))"


def tokens(spark, sf_dir):
    return op.token_rows(table(spark, sf_dir, "documents"), "doc_id", op.blank_tokens(F.col("text")))


def names(spark, sf_dir):
    return tokens(spark, sf_dir).select("token", (F.col("item") * 1_000_000 + F.col("pos")).alias("ord"))


def internal(spark):
    return spark.createDataFrame([("the", 1), ("of", 2), ("and", 3)], "token string, ord long")


def vocabulary(spark, sf_dir):
    return op.global_ids(names(spark, sf_dir), internal(spark))


@query(
    "v1_fixed_vocabulary",
    """select 'local_var_' || i as token, i as id, 'local' as class from range(1, 101) t(i) union all
    select token, row_number() over (order by ord) + 100, 'internal' from (select p_type as token, min(p_partkey) as ord from part group by 1)""",
)
def v1(spark, sf_dir):
    return op.fixed_vocabulary(spark, table(spark, sf_dir, "part").select(F.col("p_type").alias("token"), F.col("p_partkey").alias("ord")))


@query("v2_global_ids", f"select token, id from {VOCAB}")
def v2(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query(
    "v2_names_of_kinds",
    f"""with n as (select doc_id as ord, case when doc_id % 3 = 0 then 'd' || doc_id else name end as token from {DEFS_SQL} union all select 1000000000, 'd3'),
    internal as (select unnest(['M1.d1', 'd3', 'd6', 'intros', 'd3']) as token, unnest([1, 2, 3, 4, 5]) as ord, unnest([false, true, false, true, true]) as reserved)
    select 'local_var_' || i as token, i as id, 'local' as class from range(1, 101) t(i)
    union all select token, row_number() over (order by min(ord)) + 100, 'internal' from internal where reserved or token not in (select token from n) group by token
    union all select token, row_number() over (order by min(ord)) + 999, 'global' from n where token not in (select token from internal where reserved) group by token""",
)
def v2_kinds(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "Ltac").otherwise("Definition")
    rows = defs(spark, sf_dir).select("name", kind.alias("kind"), F.col("doc_id").alias("ord"))
    n = op.definition_names(rows.unionByName(spark.createDataFrame([("A.b.d3", "Ltac", 10**9)], "name string, kind string, ord long")))
    own = spark.createDataFrame([("M1.d1", 1, False), ("d3", 2, True), ("d6", 3, False), ("intros", 4, True), ("d3", 5, True)], "token string, ord long, reserved boolean")
    return op.fixed_vocabulary(spark, own, n).unionByName(op.global_ids(n, own).withColumn("class", F.lit("global")))


@query(
    "v3_extended",
    """with n as (select p_brand || ' ' || p_type as token, p_partkey as ord from part), h as (select max(ord) / 50 as cut from n),
    a as (select token, row_number() over (order by min(ord)) + 999 as id from n, h where ord < cut group by token),
    b as (select token, min(ord) as ord from n where token not in (select token from a) group by token)
    select token, id from a union all select token, row_number() over (order by ord) + 999999 from b""",
)
def v3(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("token"), F.col("p_partkey").alias("ord"))
    cut = n.agg(F.max("ord")).first()[0] / 50
    return op.extended(op.global_ids(n.where(F.col("ord") < cut), internal(spark)), n, late=True)


@query(
    "v4_aliases",
    """with v as (select page_id as id, string_split(regexp_extract(url, '//([^/]*)', 1), '.') as p from pages)
    select array_to_string(list_slice(p, 1, k + 1), '.') || '.' || p[-1] as alias, max(id) as id from (select id, p, unnest(range(0, len(p) - 2)) as k from v where len(p) > 2) group by 1""",
)
def v4(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return op.aliases(table(spark, sf_dir, "pages").select(host.alias("token"), F.col("page_id").alias("id")))


@query(
    "v5_symbol_tokens",
    rf"""select doc_id, len(t)::bigint as n, array_to_string(t, chr(2)) as tokens from (select doc_id, flatten(list_transform(list_filter(string_split(regexp_replace(text || ' 3!x 4! !y', '{op.DELIMITERS}', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p != '' and p != ' '),
    lambda p: case when length(p) > 1 and regexp_matches(p, '^[0-9]') and contains(p, '!') and substr(p, instr(p, '!') + 1) = '' then [split_part(p, '!', 1), '!']
    when length(p) > 1 and regexp_matches(p, '^[0-9]') and contains(p, '!') then [split_part(p, '!', 1), substr(p, instr(p, '!') + 1)]
    when length(p) > 1 and p[1] = '!' then ['!', substr(p, 2)] else [p] end)) as t from documents)""",
)
def v5(spark, sf_dir):
    t = op.symbol_tokens(F.concat("text", F.lit(" 3!x 4! !y")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "\u0002").alias("tokens"))


@query("v6_blank_tokens", f"select item, pos, token from {TOK}")
def v6(spark, sf_dir):
    return tokens(spark, sf_dir)


PART_NAME = "'M' || p_size || '.' || p_brand || '.' || replace(p_name, ' ', '.')"
#: token, id: names of parts, a peer beside each, and one deep name for each size.
NAMED = f"""(with n as (select {PART_NAME} as name, p_partkey, p_size from part), b as (select name, regexp_extract(name, '^(.*)\\.[^.]*$', 1) as module, p_partkey, p_size from n)
 select name as token, min(p_partkey) + 1000 as id from b group by name union all select module || '.peer', min(p_partkey) + 2000000 from b group by module
 union all select 'M' || p_size || '.deep.er.below', p_size + 900000 from part group by p_size)"""
#: item, pos, name, token: tokens of each part that reach every rule.
ITEMS = f"""(select p_partkey as item, name, unnest(range(1, len(t) + 1)) as pos, unnest(t) as token from (select p_partkey, name, last,
 [name, name || '.' || last, first || '.' || last, last, 'local', 'peer', 'ty', 'below', 'plain' || p_partkey % 3, 'ty', 'none.at.all', 'plain' || p_partkey % 3 || '<ker>' || name,
  'nothing<ker>' || name, 'un<ker>deux', 'un', 'below<ker>ty', 'deux<ker>un', first || '.of.below'] as t
 from (select p_partkey, {PART_NAME} as name, string_split({PART_NAME}, '.')[1] as first, string_split({PART_NAME}, '.')[-1] as last from part)))"""
#: item, pos, id, rule of these tokens: the rules one by one, new locals numbered by where each first falls through.
RESOLVED = f"""(with recursive v as materialized {NAMED}, s as (select id, token, string_split(token, '.') as p from v),
 al as materialized (select array_to_string(list_slice(p, 1, k + 1), '.') || '.' || p[-1] as alias, max(id) as id from (select id, p, unnest(range(0, len(p) - 2)) as k from s where len(p) > 2) group by 1),
 i as materialized (select item, pos, name, token, split_part(token, '<ker>', 1) as a, nullif(split_part(token, '<ker>', 2), '') as b from {ITEMS}),
 h as (select distinct name, half, contains(half, '.') as dotted, string_split(half, '.') as p, string_split(name, '.') as o from (select name, a as half from i union all select name, b from i where b is not null)),
 w as (select name, half, case when dotted and contains(half, o[1]) then p else list_concat(o[1:-2], p) end as path from h),
 walk as (select name, half, arg_max(al.id, k) as id from (select name, half, path, unnest(range(0, len(path) - 2)) as k from w where len(path) > 2) q
   join al on al.alias = array_to_string(list_concat(list_slice(path, 1, k + 1), [path[-1]]), '.') group by name, half),
 k as materialized (select h.name, h.half, case when dotted and e.id is not null then 'exact' when dotted and l.id is not null then 'less' when dotted and al.id is not null then 'alias' when n.id is not null then 'own'
     when e.id is not null then 'exact' when h.half = 'local' then 'local' when g.id is not null then 'sibling' end as rule,
   coalesce(case when dotted then coalesce(e.id, l.id, al.id) end, n.id, e.id, case when h.half = 'local' then 7 end, g.id) as id, walk.id as walk_id
   from h left join v e on e.token = h.half left join v l on h.dotted and p[-1] = p[-2] and l.token = array_to_string(p[1:-2], '.') left join al on h.dotted and al.alias = h.half
   left join v n on h.half = o[-1] and n.token = h.name left join v g on g.token = array_to_string(o[1:-2], '.') || '.' || h.half left join walk on walk.name = h.name and walk.half = h.half),
 f as (select i.*, ka.id as ia, ka.rule as ra, ka.walk_id as wa, kb.id as ib, kb.rule as rb from i join k ka on ka.name = i.name and ka.half = i.a left join k kb on kb.name = i.name and kb.half = i.b),
 made as (select item, half, 7 + row_number() over (partition by item order by pos) as id, pos from (select item, a as half, min(pos) as pos from f where ia is null and ib is null and (a = 'ty' or wa is null) group by item, a)),
 z as (select f.*, ma.id as ma, ma.pos as pa, mb.id as mb, mb.pos as pb from f left join made ma on ma.item = f.item and ma.half = f.a left join made mb on mb.item = f.item and mb.half = f.b)
 select item, pos, token, case when ia is not null then ia when pa < pos then ma when ib is not null then ib when pb < pos then mb when a = 'ty' then ma when wa is not null then wa else ma end as id,
   case when ia is not null then ra when pa < pos then 'local' when ib is not null then rb when pb < pos then 'local' when a = 'ty' then 'typed' when wa is not null then 'walk' else 'fallback' end as rule from z)"""


def named_parts(spark, sf_dir):
    name = F.concat(F.lit("M"), "p_size", F.lit("."), "p_brand", F.lit("."), F.translate("p_name", " ", "."))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"))


def part_items(spark, sf_dir):
    parts = F.split("name", r"\.")
    first, last, plain = F.get(parts, 0), F.element_at(parts, -1), F.concat(F.lit("plain"), F.col("p_partkey") % 3)
    tokens = F.array(
        F.col("name"), F.concat_ws(".", "name", last), F.concat_ws(".", first, last), last, F.lit("local"), F.lit("peer"), F.lit("ty"), F.lit("below"), plain, F.lit("ty"), F.lit("none.at.all"),
        F.concat_ws("<ker>", plain, "name"), F.concat_ws("<ker>", F.lit("nothing"), "name"), F.lit("un<ker>deux"), F.lit("un"), F.lit("below<ker>ty"), F.lit("deux<ker>un"), F.concat(first, F.lit(".of.below")),
    )
    rows = named_parts(spark, sf_dir).select(F.col("p_partkey").alias("item"), "name", F.posexplode(tokens).alias("pos", "token"))
    return rows.select("item", (F.col("pos") + 1).cast("long").alias("pos"), "name", "token")


def part_vocabulary(spark, sf_dir):
    named = named_parts(spark, sf_dir)
    module = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    names = named.groupBy(F.col("name").alias("token")).agg((F.min("p_partkey") + 1000).alias("id"))
    peers = named.groupBy(F.concat(module, F.lit(".peer")).alias("token")).agg((F.min("p_partkey") + 2_000_000).alias("id"))
    deep = named.select(F.concat(F.lit("M"), "p_size", F.lit(".deep.er.below")).alias("token"), (F.col("p_size") + 900_000).cast("long").alias("id")).distinct()
    return names.unionByName(peers).unionByName(deep)


def resolved_parts(spark, sf_dir):
    items = part_items(spark, sf_dir)
    local = items.where("token = 'local'").select("item", "token", F.lit(7).cast("long").alias("id"))
    return res.resolved(items, part_vocabulary(spark, sf_dir), local, items.where("token = 'ty'").select("item", "token"))


@query("v7_resolve", f"select item, pos, id, rule from {RESOLVED} where not contains(token, '<ker>')")
def v7(spark, sf_dir):
    return resolved_parts(spark, sf_dir).where("not contains(token, '<ker>')").select("item", "pos", "id", "rule")


@query("v7_rule_coverage", f"select rule, count(*) as n, count(distinct item) as items from {RESOLVED} group by rule")
def v7_coverage(spark, sf_dir):
    return resolved_parts(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))


@query("v8_alternatives", f"select item, pos, id, rule from {RESOLVED} where contains(token, '<ker>')")
def v8(spark, sf_dir):
    return resolved_parts(spark, sf_dir).where("contains(token, '<ker>')").select("item", "pos", "id", "rule")


CONV = r"(select conv_id as item, turn * 100000 + unnest(range(1, len(t) + 1)) as ord, unnest(t) as token from (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x != '') as t from conversations))"


def conversation_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(op.blank_tokens(F.col("text"))).alias("pos", "token"))
    return rows.select(F.col("conv_id").alias("item"), (F.col("turn") * 100_000 + F.col("pos") + 1).alias("ord"), "token")


@query(
    "v9_local_ids",
    f"select item, token, (row_number() over (partition by item order by min(ord)) + case when item % 2 = 0 then 5 else 0 end)::bigint as id from {CONV} group by item, token",
)
def v9(spark, sf_dir):
    seen = conversation_tokens(spark, sf_dir)
    after = seen.where("item % 2 = 0").select("item", F.lit(5).alias("id")).distinct()
    return op.local_ids(seen, after)


@query(
    "v10_attach_types",
    f"""with c as {CONV} select item, token, coalesce(min(case when ord < 100000 and item % 2 = 0 then 'before ' || length(token) end), 'after ' || length(token)) as type from c
    group by item, token""",
)
def v10(spark, sf_dir):
    seen = conversation_tokens(spark, sf_dir)
    before = seen.where("ord < 100000").withColumn("type", F.when(F.col("item") % 2 == 0, F.concat(F.lit("before "), F.length("token"))).otherwise(F.lit("")))
    after = seen.withColumn("type", F.concat(F.lit("after "), F.length("token")))
    return op.attached_types(before, after)


@query("v11_encode_definitions", f"select item, string_agg(id::varchar, ',' order by pos) as ids from {TOK} t join {VOCAB} v using (token) group by item")
def v11(spark, sf_dir):
    lists = op.item_lists(table(spark, sf_dir, "documents"), "doc_id", "text")
    return op.encoded_lists(lists, vocabulary(spark, sf_dir)).select("item", F.array_join("ids", ",").alias("ids"))


#: item, name, at, tactic, token: words of each turn's text (a state), then a tactic of its first and last word, joined by _ in every other turn.
STEP_TOKENS = """(with w as (select conv_id * 1000 + turn as item, 'conv' || conv_id as name, turn, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x != '') as t from conversations)
 select item, name, turn, unnest(range(1, len(t) + 1)) as pos, false as tactic, unnest(t) as token from w
 union all select item, name, turn, len(t) + unnest([1, 2]), true, unnest([case when turn % 2 = 0 then t[1] || '_' || t[-1] else t[1] end, case when turn % 3 = 0 then ':=' else 'x_' || t[-1] end]) from w where len(t) > 0)"""


@query(
    "v12_encode_steps",
    f"""with t as materialized {STEP_TOKENS}, n as (select token, min(item * 1000000 + pos) as ord from t where not tactic and turn % 2 = 0 group by token),
    v as materialized (select token, row_number() over (order by ord) + 999 as id from n),
    made as (select item, token, row_number() over (partition by item order by min(pos)) as id from t where token not in (select token from v) group by item, token),
    first as (select t.*, coalesce(v.id, m.id) as id from t left join v using (token) left join made m on m.item = t.item and m.token = t.token),
    again as (select item from first where tactic group by item having bool_and(id < 100)),
    parts as (select item, pos, unnest(range(1, len(p) + 1)) as sub, unnest(p) as token from (select item, pos, string_split(token, '_') as p from first where tactic and item in (select item from again))),
    numbered as (select item, token, row_number() over (partition by item order by pos, sub) as pos from parts),
    top as (select item, max(id) as top from made group by item),
    late as (select q.item, q.token, row_number() over (partition by q.item order by min(q.pos)) + coalesce(any_value(top.top), 0) as id from numbered q left join top on top.item = q.item
      where q.token not in (select token from v) and not exists (select 1 from made m where m.item = q.item and m.token = q.token) group by q.item, q.token),
    second as (select q.item, string_agg(coalesce(v.id, m.id, l.id)::varchar, ',' order by q.pos) as ids from numbered q left join v using (token) left join made m on m.item = q.item and m.token = q.token
      left join late l on l.item = q.item and l.token = q.token group by q.item)
    select f.item, coalesce(s.ids, f.ids) as ids, s.ids is not null as retried, (select count(*) from made m where m.item = f.item) + (select count(*) from late l where l.item = f.item) as locals
    from (select item, string_agg(id::varchar, ',' order by pos) as ids from first where tactic group by item) f left join second s on s.item = f.item""",
)
def v12(spark, sf_dir):
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda x: x != "")
    w = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.concat(F.lit("conv"), "conv_id").alias("name"), "turn", words.alias("t"))
    first, last = F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(-1))
    tactic = F.array(F.when(F.col("turn") % 2 == 0, F.concat_ws("_", first, last)).otherwise(first), F.when(F.col("turn") % 3 == 0, ":=").otherwise(F.concat(F.lit("x_"), last)))
    every = F.concat("t", F.when(F.size("t") > 0, tactic).otherwise(F.array().cast("array<string>")))
    rows = w.select("item", "name", "turn", F.size("t").alias("_n"), F.posexplode(every).alias("at", "token"))
    rows = rows.select("item", "name", "turn", "token", (F.col("at") + 1).cast("long").alias("pos"), (F.col("at") >= F.col("_n")).alias("tactic"))
    seen = rows.where("not tactic and turn % 2 = 0").select("token", (F.col("item") * 1_000_000 + F.col("pos")).alias("ord"))
    none = spark.createDataFrame([], "token string, ord long")
    ids, local = res.encoded_steps(rows.drop("turn"), op.global_ids(seen, none))
    opened = local.groupBy("item").agg(F.count("*").alias("locals"))
    return ids.join(opened, "item", "left").select("item", F.array_join("ids", ",").alias("ids"), "retried", F.coalesce("locals", F.lit(0)).alias("locals"))


@query(
    "v13_lookup",
    "select c_custkey, case when c_custkey % 3 = 2 then null else c_acctbal end as found from customer",
)
def v13(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat("c_name", F.lit("_sub_1"))).otherwise(F.concat(F.lit("x"), "c_name"))
    episodes = customer.select("c_custkey", name.alias("name"))
    return op.looked_up(episodes, customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))).select("c_custkey", "found")


@query("v14_decode", f"select item, string_agg(token, ' ' order by pos) as text from {TOK} where token not in ('the', 'of', 'and') group by item")
def v14(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    lists = op.item_lists(table(spark, sf_dir, "documents"), "doc_id", "text")
    return op.decoded_lists(op.encoded_lists(lists, v), v)


@query("v15_free_text_ids", f"select item, pos, id from {TOK} join {VOCAB} using (token) where id > 1000")
def v15(spark, sf_dir):
    return op.free_text_ids(tokens(spark, sf_dir), vocabulary(spark, sf_dir))


@query(
    "v16_definition_ids",
    "select source as name, 1000 + cast(substr(source, 4) as bigint) as def_id, min(doc_id) as doc_id from documents where cast(substr(source, 4) as bigint) < 15 group by source",
)
def v16(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    v = docs.select(F.col("name").alias("token")).distinct().select("token", (F.substring("token", 4, 9).cast("long") + 1000).alias("id")).where("id < 1015")
    kept, _ = op.definition_ids(docs, v, "doc_id")
    return kept.select("name", "def_id", "doc_id")


@query("v17_coverage", f"select item, count(*)::bigint as total, count(*) filter (token in ('the', 'of', 'and'))::bigint as fallback, round(count(*) filter (token in ('the', 'of', 'and')) / count(*), 8) as ratio from {TOK} group by item")
def v17(spark, sf_dir):
    rows = tokens(spark, sf_dir).join(vocabulary(spark, sf_dir), "token", "left")
    return op.coverage(rows, "item").withColumn("ratio", F.round("ratio", 8))


@query("v18_rename", f"select doc_id as item, name || ' ' || split_part(name, '.', 1) || '.loc ' || source || ' ' || name || ' ' || split_part(name, '.', 1) || '.loc' as text from {DEFS_SQL}")
def v18(spark, sf_dir):
    own = defs(spark, sf_dir)
    tokens = F.array(F.concat(F.lit("tmp_1.d"), "doc_id"), F.lit("tmp_1.loc"), F.col("source"), F.concat(F.lit("tmp_1.none<ker>tmp_1.d"), "doc_id"), F.lit("tmp_1.loc"))
    rows = own.select(F.col("doc_id").alias("item"), "name", F.posexplode(tokens).alias("pos", "token"))
    names = op.global_ids(own.select(F.col("name").alias("token"), F.col("doc_id").alias("ord")), internal(spark))
    return res.redecoded(rows, names, "tmp_1", F.substring_index("name", ".", 1))


@query(
    "v19_referenced_ids",
    """select item, string_agg(id::varchar, ',' order by id) as ids from (select distinct l_orderkey as item, l_partkey as id from lineitem where l_partkey >= 50 and l_partkey != l_orderkey
    union select distinct l_orderkey, l_suppkey + 1000 from lineitem where l_suppkey + 1000 != l_orderkey) group by item""",
)
def v19(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(
        F.collect_list("l_partkey").alias("content"), F.collect_list(F.col("l_suppkey") + 1000).alias("body"), F.collect_set("l_partkey").alias("types")
    )
    return op.referenced(line, 50).select("item", F.array_join("ids", ",").alias("ids")).where("ids != ''")


@query(
    "v20_expand_late_ids",
    f"with recursive e as (select src, dst from {EDGES_SQL} where dst > 2), r as (select src as start, dst as node from e union select r.start, e.dst from r join e on r.node = e.src) select start, node from r",
)
def v20(spark, sf_dir):
    e = edges(spark, sf_dir).where("dst > 2")  # ids up to two are no late ones
    return tr.closure(e, e.select(F.col("src").alias("start")).distinct(), lambda df: table_in_shared(df, "expand"))


@query(
    "v21_fetch_definitions",
    "select distinct l_orderkey as item, l_partkey as id, p_name as name from lineitem join part on p_partkey = l_partkey where p_type != 'SMALL'",
)
def v21(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("id"))
    kind = F.when(F.col("p_type") == "SMALL", "Primitive").otherwise(F.col("p_type"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"))
    return op.fetched(wanted, d).select("item", "id", "name")


@query(
    "v22_cooccurrence",
    "select l_partkey as concept, l_returnflag as tactic, count(*)::bigint as n, string_agg(distinct l_orderkey::varchar, ',' order by l_orderkey::varchar) as steps from lineitem group by all",
)
def v22(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_returnflag").alias("tactic"), F.col("l_orderkey").cast("string").alias("step"))
    return op.cooccurrence(pairs).withColumn("steps", F.array_join("steps", ","))


@query("v23_step_table", f"select episode || '@' || path as step_id, tactic from {STEPS_SQL}")
def v23(spark, sf_dir):
    return steps(spark, sf_dir).select(F.concat_ws("@", "episode", "path").alias("step_id"), "tactic")


@query(
    "v24_merge_late",
    "select doc_id, case when doc_id % 3 = 0 then upper(lang) else lang end as lang from documents union all select doc_id + 1000000, 'new' from documents where doc_id % 10 = 0",
)
def v24(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    late = docs.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"))
    late = late.unionByName(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("new").alias("lang")))
    return op.merged(docs, late, "doc_id")

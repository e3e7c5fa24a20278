"""Queries of trace parsing (P1-P33), over traces that Spark writes from ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.operators import traces as op
from traceloom.plans.registry import LINES_SQL, query, table
from traceloom.sources.files import numbered_lines
from traceloom.sources.shared import table_in_shared

# names, kinds and files of the definitions that each document stands for
DEFS_SQL = """(select doc_id, doc_id % 97 as file, 'M' || doc_id % 7 || '.d' || doc_id as name, source, lang, n_chars, text,
case lang when 'en' then 'Definition' when 'fr' then 'Proof' when 'de' then 'Inductive' else 'Fixpoint' end as kind from documents)"""
CLEAN = "regexp_replace(left(text, 200), '[^a-zA-Z]+', ' ', 'g')"


def defs(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "Definition").when(F.col("lang") == "fr", "Proof").when(F.col("lang") == "de", "Inductive").otherwise("Fixpoint")
    return table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 97).alias("file"), F.concat(F.lit("M"), F.col("doc_id") % 7, F.lit(".d"), "doc_id").alias("name"),
        "source", "lang", "n_chars", "text", kind.alias("kind"),
    )


def document_trace(spark, sf_dir):
    """Trace lines: a surface block and an internal block for each document, with stray lines between."""
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) and not v.startswith("$") else F.col(v[1:]) for v in x))
    let = F.when(F.col("kind") == "Fixpoint", F.lit("Let ")).otherwise(F.lit(""))
    rows = F.array(
        c("Vernac Begin ", "$kind"), F.concat(let, c("$kind", " ", "$name", " : ", "$source")), c("  ", "$lang"), c("Vernac End ", "$kind"),
        F.lit("stray text"), F.lit("   "),
        c("Constr Begin ", "$kind"), c("Name: ", "$name"), F.lit("Type:"), c("pure constr: T", "$source"), c("constr: C", "$source"), c("more ", "$lang"),
        c("processed: Variable _definition : ", "$lang"), c("Constr End ", "$kind"),
    )
    each = defs(spark, sf_dir).select("file", "doc_id", F.posexplode(rows).alias("at", "line"))
    return each.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("doc_id", "at")).cast("long"))


def conversation_trace(spark, sf_dir):
    """A proof for each conversation: turns are steps, every turn k with k % 3 = 1 is nested in the one before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    name = F.concat(F.lit("conv"), F.col("conv_id"))
    tactic = F.concat(F.lit("<T>tac"), F.col("turn"), F.lit(" "), F.col("role"), F.lit("</T>"))
    begin = F.concat(F.lit("PS Begin of t"), F.col("turn"), F.lit(" "), tactic, F.lit(" in proof of "), name)
    head = F.array(
        begin, F.concat(F.lit("PS Before t"), F.col("turn"), F.lit(" "), tactic, F.lit(" in proof of "), name, F.lit(": Goal 1/1")),
        F.lit("PS Begin Hyps"), F.lit("PS Begin Context"), F.concat(F.lit("Name: H"), F.col("turn")), F.concat(F.lit("Original: "), F.col("role")), F.lit("PS End Context"), F.lit("PS End Hyps"),
        F.lit("PS Begin Goal"), F.concat(F.lit("Original: G"), F.col("turn")), F.lit("PS End Goal"),
    )
    tail = F.array(
        F.concat(F.lit("PS After t"), F.col("turn"), F.lit(" "), tactic, F.lit(": in proof of "), name), F.lit("PS Current subgoal Completed"),
        F.concat(F.lit("PS End of t"), F.col("turn"), F.lit(" "), tactic, F.lit(" with 0 remaining goals in proof of "), name),
    )
    inner = F.col("turn") % 3 == 1
    top = F.col("turn") - F.when(inner, 1).otherwise(0)
    parts = turns.select("conv_id", "turn", top.alias("top"), F.posexplode(F.concat(head, tail)).alias("at", "line"))
    phase = F.when(F.col("turn") != F.col("top"), 1).when(F.col("at") < 11, 0).otherwise(2)
    marks = turns.select("conv_id").distinct().select(
        "conv_id", F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("top"), F.lit(0).alias("phase"), F.lit(0).alias("at"), F.concat(F.lit("ProofState Begin proof of "), name).alias("line")),
            F.struct(F.lit(10**6).cast("long").alias("top"), F.lit(0).alias("phase"), F.lit(0).alias("at"), F.concat(F.lit("ProofState End proof of "), name).alias("line")),
        )).alias("x")).select("conv_id", "x.*")
    lines = parts.select("conv_id", "top", phase.alias("phase"), "at", "line").unionByName(marks)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("top", "phase", "at"))
    return lines.select(F.col("conv_id").alias("file"), number.cast("long").alias("line_no"), "line")


def episodes(spark, sf_dir):
    return op.blocks(conversation_trace(spark, sf_dir)).where("type = 'ProofState'").select(F.concat(F.lit("conv"), F.col("file")).alias("episode"), "lines", "finished")


# steps of the proofs, from the turns: path, tactic
STEPS_SQL = """(with t as (select conv_id, turn, role, turn % 3 = 1 as inner_, 'tac' || turn || ' ' || role as tactic from conversations),
top as (select *, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from t where not inner_)
select 'conv' || conv_id as episode, i || '/' || n as path, 1::bigint as depth, tactic, turn from top
union all select 'conv' || t.conv_id, top.i || '/' || top.n || '-1/1', 2::bigint, t.tactic, t.turn from t join top on t.conv_id = top.conv_id and top.turn = t.turn - 1 where t.inner_)"""


def steps(spark, sf_dir):
    return op.step_tree(episodes(spark, sf_dir))


@query("p1_blocks", f"select file, name, kind, unnest(['Vernac', 'Constr']) as type, unnest([2, 6])::bigint as n_lines from {DEFS_SQL}")
def p1(spark, sf_dir):
    found = op.blocks(document_trace(spark, sf_dir))
    name = F.coalesce(F.regexp_extract(F.array_join("lines", "\n"), r"(M\d\.d\d+)", 1), F.lit(""))
    return found.select("file", name.alias("name"), F.col("kind_word").alias("kind"), "type", F.size("lines").cast("long").alias("n_lines"))


@query("p2_unfinished", "select file, max(doc_id) as n from (select doc_id, doc_id % 97 as file from documents) group by file")
def p2(spark, sf_dir):
    cut = document_trace(spark, sf_dir)
    last = Window.partitionBy("file").orderBy(F.desc("line_no"))
    cut = cut.withColumn("_r", F.row_number().over(last)).where("_r > 1")  # the last block of each file loses its end
    open_ = op.blocks(cut).where("not finished")
    return open_.select("file", F.regexp_extract(F.array_join("lines", "\n"), r"\.d(\d+)", 1).cast("long").alias("n"))


KIND_WORDS = [*op.KINDS, "Record", "Class", "Prof", ""]


@query(
    "p3_kinds",
    """select word, word in ('Definition', 'Proof', 'Assumption', 'Inductive', 'Fixpoint', 'CoFixpoint', 'Instance', 'Context', 'Ltac', 'TacticNotation', 'Primitive', 'Arguments') as known, count(*)::bigint as n
    from (select ['Definition', 'Proof', 'Assumption', 'Inductive', 'Fixpoint', 'CoFixpoint', 'Instance', 'Context', 'Ltac', 'TacticNotation', 'Primitive', 'Arguments', 'Record', 'Class', 'Prof', ''][1 + doc_id % 16] as word from documents) group by all""",
)
def p3(spark, sf_dir):
    words = F.array(*(F.lit(k) for k in KIND_WORDS))
    header = F.concat(F.lit("Vernac Begin "), F.get(words, (F.col("doc_id") % 16).cast("int")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), header.alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("text").alias("line")))).alias("x"))
    found = op.blocks(rows.select("file", "x.*"))
    word = F.when(F.col("kind_word") == "Begin", "").otherwise(F.col("kind_word"))
    return found.select(word.alias("word")).withColumn("known", op.known_kind(F.col("word"))).groupBy("word", "known").agg(F.count("*").alias("n"))


@query("p4_surface_fields", f"select file, name, name || ' : ' || source || ' ' || lang as content from {DEFS_SQL}")
def p4(spark, sf_dir):
    return op.surface_fields(op.blocks(document_trace(spark, sf_dir)).where("type = 'Vernac'")).select("file", "name", "content")


@query("p5_context_names", "select doc_id, source || '!'[1:0] || lang as name from documents")
def p5(spark, sf_dir):
    wrapped = F.concat(F.lit("`{"), F.col("source"), F.lit("!"), F.col("lang"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", op.context_name(wrapped).alias("name"))


@query("p6_tactic_definition", r"select doc_id, source as name, regexp_replace(text, '^[ \t\n\x0B\f\r]+', '') as body from documents")
def p6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name, body = op.tactic_definition(F.concat(F.lit("Name: "), F.col("source"), F.lit(" Body: "), F.col("text")))
    return docs.select("doc_id", name.alias("name"), body.alias("body"))


@query("p7_tactic_notation", "select doc_id, source as name, source || ' x ' || lang as content from documents")
def p7(spark, sf_dir):
    text = F.concat(F.lit("Name: "), F.col("source"), F.lit("_ab LocalName: "), F.col("source"), F.lit(" x Body: "), F.col("lang"))
    name, content = op.tactic_notation(text)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), content.alias("content"))


@query("p8_internal_fields", f"select name, 'pure constr: T' || source || chr(10) || 'constr: C' || source || chr(10) || 'more ' || lang || chr(10) || 'processed: Variable _definition : ' || lang as content from {DEFS_SQL}")
def p8(spark, sf_dir):
    return op.internal_fields(op.blocks(document_trace(spark, sf_dir)).where("type = 'Constr'")).select("name", "content")


@query("p9_term_fields", f"select 'T' || source as pure, 'C' || source || ' more ' || lang as constr, 'Variable _definition : ' || lang as processed, '_definition' as variable, count(*)::bigint as n from {DEFS_SQL} group by all")
def p9(spark, sf_dir):
    found = op.term_fields(op.blocks(document_trace(spark, sf_dir)).where("type = 'Constr'"))
    return found.groupBy("pure", "constr", "processed", "variable").agg(F.count("*").alias("n"))


@query("p10_constructors", "select page_id, 'c1' as name, url as type, 1::bigint as at from pages union all select page_id, 'c2', 'A -> B : C', 2 from pages")
def p10(spark, sf_dir):
    text = F.concat(F.lit("P := @IND Constructors Begin c1 : "), F.col("url"), F.lit(" @IND Constructors End x @IND Constructors Begin c2 :> A -> B : C @IND Constructors End"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(op.constructors(text)).alias("at", "c")).select(
        "page_id", "c.name", "c.type", (F.col("at") + 1).cast("long").alias("at")
    )


@query("p11_step_tree", f"select episode, path, depth, tactic from {STEPS_SQL}")
def p11(spark, sf_dir):
    return steps(spark, sf_dir).select("episode", "path", "depth", "tactic")


@query("p12_step_fields", f"select episode, path, tactic, 1::bigint as n_after, 1::bigint as before_at from {STEPS_SQL}")
def p12(spark, sf_dir):
    found = op.step_fields(steps(spark, sf_dir), episodes(spark, sf_dir))
    return found.select("episode", "path", "tactic", "n_after", (F.col("before_line") - F.col("first")).alias("before_at"))


@query("p13_state_fields", f"select episode, path, 'H' || turn as hyps, 'G' || turn as goal from {STEPS_SQL}")
def p13(spark, sf_dir):
    met = steps(spark, sf_dir).join(episodes(spark, sf_dir).select("episode", "lines"), "episode")
    hyps, goal = op.state_fields(F.slice(F.col("lines"), F.col("first") + 2, F.lit(11)))
    return met.select("episode", "path", F.array_join(hyps, ",").alias("hyps"), goal.alias("goal"))


@query(
    "p14_author_parts",
    f"""select authored, count(*)::bigint as n from (select file, line, sum(case when line like 'A%' then 1 when line like 'T%' then -1 else 0 end)
    over (partition by file order by line_no rows unbounded preceding) > 0 as authored from {LINES_SQL}) where line not like 'A%' and line not like 'T%' group by all""",
)
def p14(spark, sf_dir):
    lines = numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return op.author_parts(lines, "A", "T").groupBy("authored").agg(F.count("*").alias("n"))


@query("p15_flatten", f"select episode, path, (row_number() over (partition by episode order by turn))::bigint as at from {STEPS_SQL}")
def p15(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("episode").orderBy(op.path_key(F.col("path"))))
    return steps(spark, sf_dir).select("episode", "path", at.cast("long").alias("at"))


@query(
    "p16_rebuild_nesting",
    f"with s as {STEPS_SQL} select episode, path, (select count(*) from s c where c.episode = s.episode and c.path = s.path || '-1/1')::bigint as n_children from s",
)
def p16(spark, sf_dir):
    whole, orphans = op.nested(steps(spark, sf_dir).select("episode", "path"))
    return whole.join(orphans.select("episode", "path"), ["episode", "path"], "left_anti").select("episode", "path", "n_children")


@query(
    "p17_episode_facts",
    f"select episode, string_agg(tactic, ';' order by turn) as tactics, count(*)::bigint as n, arg_max(tactic, turn) as last from {STEPS_SQL} where depth = 1 group by episode",
)
def p17(spark, sf_dir):
    return op.episode_facts(steps(spark, sf_dir)).withColumn("tactics", F.array_join("tactics", ";"))


@query(
    "p18_open_goals",
    """with recursive e as (select user_id, case event_type when 'view' then 1 when 'click' then 0 when 'purchase' then 2 else 1 end as r,
    row_number() over (partition by user_id order by event_id) as i from events),
    f as (select user_id, 0::bigint as i, 1::bigint as s from (select distinct user_id from events)
    union all select f.user_id, e.i, case when f.s < 1 then f.s - (case when e.r = 0 then 1 else 0 end) else f.s + e.r - 1 end from f join e on e.user_id = f.user_id and e.i = f.i + 1)
    select user_id, arg_max(s, i) as left_open from f group by user_id""",
)
def p18(spark, sf_dir):
    r = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("event_id", r.alias("r"))))
    results = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(ordered, lambda x: x["r"]).alias("results"))
    return results.select("user_id", op.open_goals(F.col("results")).alias("left_open"))


@query(
    "p19_assemble",
    f"""select d.name, d.kind, d.source as content, l.quality::bigint as quality, l.toxic::bigint as toxic from {DEFS_SQL} d left join labels l using (doc_id) where d.kind != 'Fixpoint'
    union all select 'd' || doc_id, 'Ltac', source, null, null from {DEFS_SQL} where kind = 'Fixpoint'""",
)
def p19(spark, sf_dir):
    d = defs(spark, sf_dir)
    kind = F.when(F.col("kind") == "Fixpoint", "Ltac").otherwise(F.col("kind"))
    surface = d.select("name", kind.alias("kind"), F.col("source").alias("content"), F.col("doc_id").alias("ord"))
    internal = d.where("kind != 'Fixpoint'").select("name", F.col("lang").alias("internal"), F.col("doc_id").alias("ord"))
    labels = table(spark, sf_dir, "labels").join(d.select("doc_id", "name"), "doc_id")
    types = labels.select(F.col("name").alias("parent"), F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (local, type)"))
    out = op.assembled(surface, internal, types)
    return out.select("name", "kind", "content", *(F.element_at("types", k).cast("long").alias(k) for k in ("quality", "toxic")))


@query(
    "p20_holdout_gate",
    "select doc_id, source, source not in (select 'src' || (length(text) % 5) from benchmark) as steps_allowed from documents where source not in ('src7', 'src11')",
)
def p20(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.length("text") % 5).alias("source"))
    excluded = spark.createDataFrame([("src7",), ("src11",)], "source string")
    return op.gated(table(spark, sf_dir, "documents").select("doc_id", "source"), held, excluded, "source")


@query(
    "p21_trailing_run",
    "select user_id, event_id from (select *, sum(case when event_type in ('view', 'click') then 0 else 1 end) over (partition by user_id order by event_id desc rows unbounded preceding) as miss from events) where miss = 0",
)
def p21(spark, sf_dir):
    return op.trailing_run(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("view", "click")).select("user_id", "event_id")


@query("p22_failed_files", "select distinct source || '.v' as failed from documents where n_chars > 3000")
def p22(spark, sf_dir):
    line = F.when(F.col("n_chars") > 3000, F.concat(F.lit("Error in file "), F.col("source"), F.lit(".v: at line 3"))).otherwise(F.lit("ok"))
    return op.failed_files(table(spark, sf_dir, "documents").select(line.alias("line")))


NO_USE = """'Compiled library', 'Cannot find a physical path bound to logical path matching suffix', 'makes inconsistent assumptions', 'error loading shared library:', 'File not found', 'Unable to locate library',
    'Error: Native compiler exited', 'Error: Unknown interpretation for notation', 'Error: This command does not support this attribute', 'cmxs', 'Uncaught exception Not_found'"""


@query("p23_useful_errors", f"""select doc_id, len(list_filter([{NO_USE}], lambda p: contains(said, p))) = 0 as useful
    from (select doc_id, text || chr(10) || 'File x, line 3' || chr(10) || [{NO_USE}, 'Syntax error: no such goal', ''][1 + doc_id % 13] || ' here' as said from documents)""")
def p23(spark, sf_dir):
    shown = F.array(*(F.lit(e) for e in (*op.USELESS_ERRORS, "Syntax error: no such goal", "")))
    text = F.concat("text", F.lit("\nFile x, line 3\n"), F.get(shown, (F.col("doc_id") % 13).cast("int")), F.lit(" here"))
    return table(spark, sf_dir, "documents").select("doc_id", op.useful_error(text).alias("useful"))


STARTS_SQL = """(select event_id, user_id, ['Axiom', 'Definition', 'Fixpoint', 'Lemma', 'Theorem', 'Instance', 'Corollary', 'Inductive', 'Variable', 'Parameter', 'Notation', 'Ltac', 'Record', 'apply', 'Qed.', 'Lemmas', 'x', 'y', 'z'][1 + event_id % 19] as word,
    event_id % 19 < 12 as starts from events)"""


@query(
    "p24_enclosing",
    f"""select e.event_id, 'n' || b.event_id as before, 'n' || a.event_id as after from {STARTS_SQL} e
    asof left join (select * from {STARTS_SQL} where starts) b on e.user_id = b.user_id and e.event_id >= b.event_id
    asof left join (select * from {STARTS_SQL} where starts) a on e.user_id = a.user_id and e.event_id <= a.event_id""",
)
def p24(spark, sf_dir):
    words = F.array(*(F.lit(w) for w in (*op.STARTS, "Record", "apply", "Qed.", "Lemmas", "x", "y", "z")))
    line = F.concat(F.lit("  "), F.get(words, (F.col("event_id") % 19).cast("int")), F.lit(" n"), "event_id", F.lit(" : t."))
    name = op.start_name(F.col("line"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))
    return op.enclosing(rows, "user_id", "event_id", name.isNotNull(), name).select("event_id", "before", "after")


@query(
    "p25_module_names",
    """select path, case k when 0 then 'Root.' || rest when 1 then 'Sub.' || rest when 2 then 'Root.theories.' || rest when 5 then 'Early.' || rest end as module,
    case k when 3 then 'no rule for the path' when 4 then 'no package in the path' end as problem
    from (select doc_id % 6 as k, 'S.F' || doc_id as rest, ['/a/coq-old/coq-one/', '/a/coq-one/src/', '/a/coq-two/theories/', '/a/coq-none/', '/a/b/', '/a/coq-old.1/coq-o/'][1 + doc_id % 6] || 'S/F' || doc_id || '.v' as path from documents)""",
)
def p25(spark, sf_dir):
    folders = F.array(*(F.lit(f) for f in ("/a/coq-old/coq-one/", "/a/coq-one/src/", "/a/coq-two/theories/", "/a/coq-none/", "/a/b/", "/a/coq-old.1/coq-o/")))
    path = F.concat(F.get(folders, (F.col("doc_id") % 6).cast("int")), F.lit("S/F"), "doc_id", F.lit(".v"))
    rules = spark.createDataFrame(
        [("coq-one.2.1", 2, 0, "src", "Sub"), ("coq-one.2.1", 2, 1, ".", "Root"), ("coq-two.dev", 1, 0, "lib/x", "Lib"), ("coq-two.dev", 1, 1, ".", "Root"), ("x-coq-none", 3, 0, "lib", "None"),
         ("coq-old", 0, 0, ".", "Early"), ("coq-one", 4, 0, ".", "Late"), ("coq-two", 5, 0, ".", "Late")], "package string, place int, ordinal int, dir string, alias string"
    )
    return op.module_name(table(spark, sf_dir, "documents").select(path.alias("path")), rules)


# each supplier needs the ones whose numbers its parts point to: a third as large at most, so chains stay short
EDGES_SQL = "(select distinct l_suppkey as src, l_suppkey // (2 + l_partkey % 3) as dst from lineitem)"


def edges(spark, sf_dir):
    dst = F.floor(F.col("l_suppkey") / (2 + F.col("l_partkey") % 3)).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), dst.alias("dst")).distinct()


@query(
    "p26_dependencies",
    f"with recursive e as {EDGES_SQL}, r as (select src as start, dst as node from e union select r.start, e.dst from r join e on r.node = e.src) select start, node from r",
)
def p26(spark, sf_dir):
    e = edges(spark, sf_dir)
    starts = e.select(F.col("src").alias("start")).distinct()
    return op.closure(e, starts, lambda df: table_in_shared(df, "closure"))


# files need those their parts point to, in falling order of number; the first is not followed
DEPS_SQL = f"""(select 'g' || src % 5 || '/f' || src || '.v' as file, src as place, row_number() over (partition by src order by dst desc) as ordinal, 'g' || dst % 5 || '/f' || dst || '.v' as dep from {EDGES_SQL} where dst != src)"""


@query(
    "p26_packages",
    f"""with recursive d as materialized {DEPS_SQL}, s as (select distinct file as start, '/root/' || file as path from d where place % 3 = 0 union select file, substr(file, 4) from d where place % 3 = 1),
    m as (select path, start from s where path[1] = '/' union select path, file from (select path, file from s join d on path[1] != '/' and contains(file, path) qualify row_number() over (partition by path order by place) = 1)),
    r as (select start, start as node from m union select r.start, d.dep from r join d on r.node = d.file and d.ordinal > 1)
    select distinct path, split_part(dep, '/', 1) as package from m join r on r.start = m.start join d on d.file = r.node""",
)
def p26_packages(spark, sf_dir):
    name = lambda k: F.concat(F.lit("g"), F.col(k) % 5, F.lit("/f"), F.col(k), F.lit(".v"))
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dst")))
    deps = edges(spark, sf_dir).where("dst != src").select(name("src").alias("file"), F.col("src").alias("place"), order.alias("ordinal"), name("dst").alias("dep"))
    deps = table_in_shared(deps, "deps")
    file = F.col("file")
    paths = deps.where("place % 3 < 2").select(F.when(F.col("place") % 3 == 0, F.concat(F.lit("/root/"), file)).otherwise(F.substr(file, F.lit(4))).alias("path")).distinct()
    return op.dependencies(deps, paths, lambda df: table_in_shared(df, "closure"))


@query(
    "p27_compile_flags",
    "select distinct r_name as package, '-R' as flag, case when n_nationkey % 2 = 0 then r_name else r_name || '/d' || n_nationkey end as dir, n_name as alias from nation join region on n_regionkey = r_regionkey where r_name != 'ASIA'",
)
def p27(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    d = F.when(F.col("n_nationkey") % 2 == 0, ".").otherwise(F.concat(F.lit("d"), F.col("n_nationkey")))
    flags = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("package"), F.lit("-R").alias("flag"), d.alias("dir"), F.col("n_name").alias("alias")
    )
    return op.compile_flags(region.select(F.col("r_name").alias("package")), flags, ("ASIA",))


@query(
    "p28_missing_packages",
    """select distinct m.id, head, n_nationkey::bigint as package from (select doc_id as id, case when doc_id % 5 = 0 then 'd' else 'NATION_' end || (doc_id % 30) as head from documents where doc_id % 4 != 3) m
    left join nation on contains('-Q d' || n_nationkey || ' ' || n_name, head)""",
)
def p28(spark, sf_dir):
    said = F.when(F.col("doc_id") % 4 == 3, F.lit("Error: no such file")).otherwise(F.lit(op.NO_PATH))
    messages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(said, F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, "d").otherwise("NATION_"), F.col("doc_id") % 30, F.lit(".lib not found.\n")).alias("text")
    )
    rule = F.concat(F.lit("-Q d"), "n_nationkey", F.lit(" "), "n_name")
    rules = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("package"), rule.alias("rule"))
    return op.missing_packages(messages, rules)


INDEX_SQL = "(select event_id, user_id, ['prf', 'var', 'def', 'binder', 'R', 'ind', 'not', ' binder'][1 + event_id % 8] as kind from events)"


@query(
    "p29_declaration_ranges",
    f"""select e.event_id, n.event_id as until from (select *, event_id + 1 as next from {INDEX_SQL} where kind in ('prf', 'var', 'def')) e
    asof left join (select * from {INDEX_SQL} where kind in ('prf', 'var', 'def', 'ind', 'not')) n on e.user_id = n.user_id and e.next <= n.event_id""",
)
def p29(spark, sf_dir):
    kinds = F.array(*(F.lit(k) for k in ("prf", "var", "def", "binder", "R", "ind", "not", " binder")))
    line = F.concat(F.get(kinds, (F.col("event_id") % 8).cast("int")), F.lit(" 12:20 <> name"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))
    return op.declaration_end(rows, "user_id", "event_id", op.declares(F.col("line")), op.ends_declaration(F.col("line"))).select("event_id", "until")


OFFSETS_SQL = f"(select file, line_no, strlen(line) + 1 as n, sum(strlen(line) + 1) over (partition by file order by line_no rows unbounded preceding) as to_byte from {LINES_SQL})"


@query(
    "p30_byte_to_line",
    f"select file, min(line_no) as first_line, max(line_no) as last_line from {OFFSETS_SQL} where to_byte > 100 and (file % 3 = 0 or to_byte - n < 500) group by file",
)
def p30(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranges = docs.select(F.col("doc_id").alias("file"), F.lit(100).alias("a"), F.when(F.col("doc_id") % 3 != 0, 500).alias("b"))
    return op.byte_to_line_range(ranges, numbered_lines(docs, "doc_id", "text")).select("file", "first_line", "last_line")


@query(
    "p31_text_before",
    """select doc_id, case when pos > 0 then substr(text, 1, pos - 1) || split_part(substr(text, pos), '. ', 1) || '.' || chr(10) || 'Proof.' end as cut
    from (select *, instr(text, ' the ') as pos from documents)""",
)
def p31(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.text_before(F.col("text"), " the ", "Proof.").alias("cut"))


@query(
    "p32_short_names",
    """select doc_id, list_aggregate(list_transform(string_split(source || '.a.' || lang || ' (x.y.z. plain. ' || source || '.b', ' '), lambda w:
    regexp_extract(w, '^[(\\[]*') || regexp_extract(regexp_replace(regexp_replace(w, '^[(\\[]*', ''), '\\.*$', ''), '[^.]*$') || regexp_extract(w, '\\.*$')), 'string_agg', ' ') as short from documents""",
)
def p32(spark, sf_dir):
    text = F.concat(F.col("source"), F.lit(".a."), F.col("lang"), F.lit(" (x.y.z. plain. "), F.col("source"), F.lit(".b"))
    return table(spark, sf_dir, "documents").select("doc_id", op.short_names(text).alias("short"))


@query(
    "p33_clean_candidates",
    """with c as (select source as episode, lang || '.' as tactic, lang || doc_id as reason, doc_id as ord from documents
    union all select source, source || ' x', 'cites', doc_id from documents union all select source, 'w' || (doc_id % 30) || '.', 'w' || doc_id, doc_id from documents),
    o as (select episode, tactic, arg_min(reason, ord) as reason, min(ord) as ord from c where not contains(tactic, episode) group by all)
    select episode, tactic, reason from o where ord < 1000000000 qualify row_number() over (partition by episode order by ord, tactic) <= 10""",
)
def p33(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("episode"), F.concat("lang", F.lit(";")).alias("tactic"), F.concat("lang", "doc_id").alias("reason"), F.col("doc_id").alias("ord"))
    cites = docs.select(F.col("source").alias("episode"), F.concat("source", F.lit(" x")).alias("tactic"), F.lit("cites").alias("reason"), F.col("doc_id").alias("ord"))
    more = docs.select(F.col("source").alias("episode"), F.concat(F.lit("w"), F.col("doc_id") % 30, F.lit(";")).alias("tactic"), F.concat(F.lit("w"), "doc_id").alias("reason"), F.col("doc_id").alias("ord"))
    return op.clean_candidates(rows.unionByName(cites).unionByName(more)).select("episode", "tactic", "reason")

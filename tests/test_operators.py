"""Small hand-written cases of the operators: quirks, errors, ties, empty input."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.ordering import global_row_number
from traceloom.operators import clarity, resolution, retrieval, runlog, sources, text, traces, training, uncertainty, vocabulary
from traceloom.sources import files
from traceloom.streaming.incremental import after

GOLDEN = """Vernac Begin Proof
Proof A.left :
  forall (C : Prop), C
Vernac End Proof
outside
Constr Begin Definition
Name: A.left
Type:
pure constr: (A:Prop)Prop
constr: Prod(Name(A))
  more
processed: Variable _definition : forall ( A : Prop ) -> Prop
Constr End Definition
ProofState Begin proof of A.left
PS Begin of t <T>intro; split</T> in proof of A.left
PS Before t <T>intro; split</T> in proof of A.left: Goal 1/1
Type Begin Definition
PS Begin of t <T>intro; split</T> in proof of A.left
PS End of t <T>intro; split</T> with 0 remaining goals in proof of A.left
PS After t <T>intro; split</T>: in proof of A.left
PS Current subgoal Completed
PS End of t <T>intro; split</T> with 0 remaining goals in proof of A.left
PS Begin of t <T>auto</T> in proof of A.left
PS Notice: Tactic <T>auto</T> did not change the proof state
ProofState End proof of B.other
ProofState End proof of A.left
ProofState Begin proof of C.open
PS Begin of t <T>x</T> in proof of C.open"""


def lines_of(spark, text_, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text_.split("\n"), 1)], "file string, line_no long, line string")


def test_blocks_of_golden_trace(spark):
    rows = {r.first_line: r for r in traces.blocks(lines_of(spark, GOLDEN)).collect()}
    assert [(r.type, r.kind_word, r.finished, len(r.lines)) for _, r in sorted(rows.items())] == [
        ("Vernac", "Proof", True, 2), ("Constr", "Definition", True, 6), ("ProofState", "A.left", True, 11), ("ProofState", "C.open", False, 1),
    ]


def test_blocks_of_nothing(spark):
    assert traces.blocks(lines_of(spark, "", "e")).count() == 0
    assert traces.blocks(lines_of(spark, "x").limit(0)).count() == 0


def test_surface_and_terms(spark):
    blocks = traces.blocks(lines_of(spark, GOLDEN))
    surface = traces.surface_fields(blocks.where("type = 'Vernac'")).first()
    assert (surface.name, surface.content) == ("A.left", "A.left : forall (C : Prop), C")
    term = traces.term_fields(blocks.where("type = 'Constr'")).first()
    assert (term.pure, term.constr, term.variable) == ("(A:Prop)Prop", "Prod(Name(A)) more", "_definition")
    inner = traces.internal_fields(blocks.where("type = 'Constr'")).first()
    assert inner.name == "A.left" and inner.body is None


def test_step_tree_counts_equal_tactics_and_drops_noticed(spark):
    blocks = traces.blocks(lines_of(spark, GOLDEN)).where("type = 'ProofState'").select(F.col("kind_word").alias("episode"), "lines")
    steps = [(r.episode, r.path, r.depth, r.tactic) for r in traces.step_tree(blocks).orderBy("episode", "path").collect()]
    assert steps == [("A.left", "1/1", 1, "intro; split"), ("A.left", "1/1-1/1", 2, "intro; split")]
    flat = traces.step_tree(blocks, most_depth=1).count()
    assert flat == 2  # at limit one a compound step is still opened once


def test_paths_sort_by_number(spark):
    df = spark.createDataFrame([("10/12",), ("2/12",), ("2/12-1/2",)], "path string")
    assert [r.path for r in df.orderBy(traces.path_key(F.col("path"))).collect()] == ["2/12", "2/12-1/2", "10/12"]


def test_orphans(spark):
    steps = spark.createDataFrame([("e", "1/1"), ("e", "1/1-1/1"), ("e", "3/3-1/1")], "episode string, path string")
    whole, orphans = traces.nested(steps)
    assert {r.path: r.n_children for r in whole.collect()}["1/1"] == 1
    assert [r.path for r in orphans.collect()] == ["3/3-1/1"]


@pytest.mark.parametrize("goals", [[1, 0], [3, 0, 0, 0], [2, 0, 2, 0, 0], [0, 0], []])
def test_open_goals_match_the_streamed_fold(spark, goals):
    left = 1
    for g in goals:
        left = after(left, g)
    df = spark.createDataFrame([(goals,)], "r array<long>")
    assert df.select(traces.open_goals(F.col("r"))).first()[0] == left


def test_closure_is_cycle_safe(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (4,), (5,)], "start long")
    got = {(r.start, r.node) for r in traces.closure(edges, starts, lambda df: df.cache()).collect()}
    assert got == {(1, 2), (1, 3), (1, 1), (4, 5)}


def test_tactic_definition_without_body_is_an_error(spark):
    df = spark.createDataFrame([("Name: x",)], "t string")
    with pytest.raises(Exception, match="no body"):
        df.select(*traces.tactic_definition(F.col("t"))).collect()


def test_short_names(spark):
    df = spark.createDataFrame([("(A.b.c x.y. plain [Q.r",)], "t string")
    assert df.select(traces.short_names(F.col("t"))).first()[0] == "(c y. plain [r"
    assert df.select(traces.short_names(F.col("t"), 2)).first()[0] == "(b.c x.y. plain [Q.r"


def test_symbol_tokens(spark):
    df = spark.createDataFrame([(r"a:=b /\ f(x) 3!y 3! !z -> w",)], "t string")
    assert df.select(vocabulary.symbol_tokens(F.col("t"))).first()[0] == ["a", ":=", "b", "/\\", "f", "(", "x", ")", "3", "y", "3", "!", "!", "z", "->", "w"]


def test_aliases_and_resolution(spark):
    v = spark.createDataFrame([("A.b.c.d", 1001), ("A.x.d", 1002), ("M.f", 1003), ("M.g", 1004)], "token string, id long")
    assert {r.alias: r.id for r in vocabulary.aliases(v).collect()} == {"A.b.d": 1001, "A.d": 1002}
    tokens = spark.createDataFrame(
        [("i", 1, "A.d", "M.f"), ("i", 2, "f", "M.f"), ("i", 3, "g", "M.f"), ("i", 4, "M.g.g", "M.f"), ("i", 5, "nope", "M.f")], "item string, pos long, token string, name string"
    )
    got = {r.pos: (r.id, r.rule) for r in resolution.resolved(tokens, v).collect()}
    assert got == {1: (1002, "alias"), 2: (1003, "own"), 3: (1004, "sibling"), 4: (1004, "less"), 5: (1, "fallback")}


def one_by_one(items, names, short, given, typed):
    """The rules of token resolution, a token at a time. ``items``: item -> (name, tokens)."""
    out = {}
    for item, (name, tokens) in items.items():
        own, local = name.split("."), dict(given.get(item, {}))
        count = max(local.values(), default=0)

        def known(t):
            p = t.split(".")
            if len(p) > 1:
                keys = [(names, t, "exact")] + [(names, ".".join(p[:-1]), "less")] * (p[-1] == p[-2]) + [(short, t, "alias")]
            else:
                keys = []
            keys += [(names, name, "own")] * (t == own[-1]) + [(names, t, "exact")] * (len(p) == 1)
            keys += [(local, t, "local"), (names, ".".join(own[:-1] or own) + "." + t, "sibling")]
            return next(((table[key], rule) for table, key, rule in keys if key in table), None)

        for pos, token in enumerate(tokens):
            halves = token.split("<ker>")
            hit = next((h for h in map(known, halves) if h), None)
            a = halves[0]
            if hit is None and a not in typed.get(item, ()):
                path = a.split(".") if "." in a and own[0] in a else own[:-1] + a.split(".")
                walk = [".".join([path[0], *path[1 : 1 + k], path[-1]]) for k in range(len(path) - 3, -1, -1)]
                hit = next(((short[w], "walk") for w in walk if w in short), None)
            if hit is None:
                count += 1
                local[a] = count
                hit = (count, "typed" if a in typed.get(item, ()) else "fallback")
            out[item, pos] = hit
    return out


def test_resolution_of_random_items(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "e", "f.g", "M.a", "M.x.c", "M.N.c", "f", "g", "M.h.h", "h", "q", "r", "N.b"]
    names = {"M.N.a": 1001, "M.N.b": 1002, "M.x.y.c": 1003, "M.x.y.z.q": 1004, "a": 1005, "M.N.h": 1006, "f.g": 1007, "M.h": 1008, "K": 1009}
    v = spark.createDataFrame(list(names.items()), "token string, id long")
    short = {r.alias: r.id for r in vocabulary.aliases(v).collect()}
    items, given, typed = {}, {}, {}
    for i in range(300):
        pick = lambda: rng.choice(words) if rng.random() < 0.6 else f"{rng.choice(words)}<ker>{rng.choice(words)}"
        items[i] = (rng.choice(["M.N.a", "M.N.u", "K", "lone", "M.x.c"]), [pick() for _ in range(12)])
        if i % 3 == 0:
            given[i] = {"b": 1, "r": 2}
        if i % 4 == 0:
            typed[i] = ["e", "q"]
    tokens = spark.createDataFrame([(i, pos, t, name) for i, (name, own) in items.items() for pos, t in enumerate(own)], "item long, pos long, token string, name string")
    local = spark.createDataFrame([(i, t, k) for i, own in given.items() for t, k in own.items()], "item long, token string, id long")
    types = spark.createDataFrame([(i, t) for i, own in typed.items() for t in own], "item long, token string")
    got = {(r.item, r.pos): (r.id, r.rule) for r in resolution.resolved(tokens, v, local, types).collect()}
    assert got == one_by_one(items, names, short, given, typed)
    assert {rule for _, rule in got.values()} == {"exact", "less", "alias", "own", "local", "sibling", "typed", "walk", "fallback"}


def test_a_tactic_of_locals_alone_is_split_at_underscores(spark):
    v = spark.createDataFrame([("known", 1000)], "token string, id long")
    rows = [(1, 1, "x", False), (1, 2, "x_known", True), (1, 3, "y__x", True), (2, 1, "known", True), (2, 2, "x_known", True), (3, 1, "a", False)]
    tokens = spark.createDataFrame([(*r, "n") for r in rows], "item long, pos long, token string, tactic boolean, name string")
    ids, local = resolution.encoded_steps(tokens, v)
    assert {r.item: (r.ids, r.retried) for r in ids.collect()} == {1: ([1, 1000, 4, 5, 1], True), 2: ([1000, 1], False)}
    assert sorted((r.item, r.token, r.id) for r in local.collect()) == [(1, "", 5), (1, "x", 1), (1, "x_known", 2), (1, "y", 4), (1, "y__x", 3), (2, "x_known", 1), (3, "a", 1)]


def test_decoding_a_missing_local_is_an_error(spark):
    v = spark.createDataFrame([("a", 1000)], "token string, id long")
    rows = spark.createDataFrame([(1, 1, 7)], "item long, pos long, id long")
    with pytest.raises(Exception, match="no token for id 7"):
        vocabulary.decoded(rows, v).collect()


def test_extension_starts_after_the_largest(spark):
    v = spark.createDataFrame([("a", 1000), ("b", 1001)], "token string, id long")
    names = spark.createDataFrame([("c", 2), ("a", 1), ("d", 3)], "token string, ord long")
    assert {r.token: r.id for r in vocabulary.extended(v, names).collect()} == {"a": 1000, "b": 1001, "c": 1002, "d": 1003}
    assert vocabulary.extended(v, names, late=True).where("id >= 1000000").count() == 2


def test_global_row_number(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(300)], "k long, t long")
    got = [r.rn for r in global_row_number(df, "k", "t").orderBy("k", "t").collect()]
    assert got == list(range(1, 301))
    assert global_row_number(df.limit(0), "k", "t").count() == 0


def test_jsonl_reads_fewer_than_asked(spark, tmp_path):
    files.write_jsonl(spark.range(3), str(tmp_path / "a"))
    assert files.read_jsonl(spark, str(tmp_path / "a"), "id long", 2).count() == 2
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "a"), "id long", 4)


def test_json_document_or_lines(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("a", LongType())])
    (tmp_path / "one.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert files.read_json(spark, str(tmp_path / "one.json"), schema).count() == 2
    assert files.read_json(spark, str(tmp_path / "lines.json"), schema).count() == 3


def test_list_codec(spark):
    df = spark.createDataFrame([("1.0, 2.5",), ("",)], "t string")
    assert [r[0] for r in df.select(sources.decode_list(F.col("t"))).collect()] == [[1.0, 2.5], []]


def test_head_and_tail(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",)], "t string")
    assert [r[0] for r in df.select(text.head_and_tail(F.col("t"), 5, 2)).collect()] == ["ab...ij", "abc"]


def test_gap_in_progress_is_an_error(spark):
    steps = spark.createDataFrame([("e", i) for i in range(1, 5)], "episode string, i long")
    with pytest.raises(Exception, match="gap in the log"):
        training.open_steps(steps, steps.where("i in (1, 3)")).collect()


def test_meaningful_and_entropy(spark):
    df = spark.createDataFrame([(["x", '["', "a", " ", ",", "b", '"]', "y"], [0.0, 0.0])], "t array<string>, l array<double>")
    r = df.select(uncertainty.meaningful(F.col("t")).alias("m"), uncertainty.entropy_of_logs(F.col("l")).alias("e")).first()
    assert r.m == ["a", "b"] and abs(r.e - 0.6931471) < 1e-5


@pytest.mark.parametrize("a,b,ratio,distance", [("kitten", "sitting", 61.5384, 3), ("", "", 100.0, 0), ("abc", "", 0.0, 3), ("same", "same", 100.0, 0)])
def test_edit_measures(spark, a, b, ratio, distance):
    assert abs(uncertainty.indel_ratio(a, uncertainty._places(b), len(b)) - ratio) < 1e-3
    pair = spark.createDataFrame([(0, 1, a), (0, 2, b)], "g long, k long, t string")
    assert uncertainty.levenshtein_pairs(pair, "g", "k", "t").first().distance == distance


def test_common_subsequences_of_random_texts():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = functools.reduce(lambda new, j: [*new, row[j] + 1 if b[j] == x else max(row[j + 1], new[-1])], range(len(b)), [0])  # noqa: B023
        want = 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))
        assert uncertainty.indel_ratio(a, uncertainty._places(b), len(b)) == want


def test_average_linkage_merges_the_nearest():
    rng = np.random.default_rng(1)
    for n in (2, 5, 30):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        label = np.arange(n)
        for a, b in uncertainty._average_linkage(d):
            kinds = np.unique(label)
            mean = {(i, j): d[np.ix_(label == i, label == j)].mean() for i in kinds for j in kinds if i < j}
            assert {label[a], label[b]} == set(min(mean, key=mean.get))
            label[label == label[b]] = label[a]
        assert len(set(label)) == 1


def test_two_thousand_texts_in_a_group(spark):
    texts = spark.range(2000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.concat(F.when(F.col("id") % 2 == 0, "aaaaaa").otherwise("zzzzzz"), F.col("id") % 10).alias("t"))
    alone = spark.createDataFrame([(2, 0, "x")], "g int, k long, t string")
    assert {r.g: r.n for r in uncertainty.text_clusters(texts.unionByName(alone), "g", "k", "t", 4).collect()} == {1: 2, 2: 1}


def test_clusters_of_one_large_group(spark):
    rows = spark.range(3000).select(F.array((F.col("id") % 3 * 10).cast("double"), (F.col("id") % 7 * 0.01).cast("double")).alias("v"))
    got = uncertainty.cluster_entropy_of_all(rows, "v", 5).first()
    assert got.k == 3 and abs(got.entropy - np.log(3)) < 1e-9
    assert uncertainty.cluster_entropy_of_all(rows.limit(2), "v").first() == (0.0, 1)


def test_clusters_are_found(spark):
    rows = [(0, i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(12)]
    got = uncertainty.cluster_entropy(spark.createDataFrame(rows, "g long, k long, v array<double>"), "g", "k", "v").first()
    assert got.k == 2 and abs(got.entropy - 0.693147) < 1e-5
    words = spark.createDataFrame([(0, i, t) for i, t in enumerate(["aaaa", "aaab", "aaba", "zzzz", "zzzy"])], "g long, k long, t string")
    assert uncertainty.text_clusters(words, "g", "k", "t").first().n == 2


def test_yes_no_score(spark):
    df = spark.createDataFrame([("YES", 0.0, None), ("no", -1.0, -1.0), ("well", 0.0, 0.0)], "f string, y double, n double")
    assert [r[0] for r in df.select(clarity.yes_no_score(F.col("f"), F.col("y"), F.col("n"))).collect()] == [1.0, 0.5, None]


def test_outcome_records_by_key(spark):
    log = "SUCCEEDED: a x\nlog_file: l1\nproof_time: 3\ndepth: 2\nFAILED: b\nlog_file: l2"
    rows = runlog.outcome_records(lines_of(spark, log)).collect()
    assert [(r.status, r.name, r.log_file, r.depth) for r in rows] == [("SUCCEEDED", "a", "l1", 2)]


def test_log_split_by_header(spark):
    log = "junk\nCOQC a.v\nx\ny\nCOQC b.v\nz"
    rows = sources.split_log(lines_of(spark, log), r"^COQC (\S+)").collect()
    assert sorted((r.line_no, r.part, r.path) for r in rows) == [(2, 1, "a.v"), (3, 1, "a.v"), (4, 1, "a.v"), (5, 2, "b.v"), (6, 2, "b.v")]


def test_json_is_read_file_by_file(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("items", T.ArrayType(T.StructType([T.StructField("a", T.LongType())])))])
    pretty = '{\n"a": 1,\n"items": [\n {"a": 1},\n {"a": 2}\n]\n}\n'
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "pretty.json").write_text(pretty)
    read = lambda folder: sorted((r.a, None if r["items"] is None else [i.a for i in r["items"]]) for r in files.read_json(spark, str(tmp_path / folder), schema).collect())
    assert read("one") == [(1, [1, 2])]
    mixed = tmp_path / "mixed [1]"
    mixed.mkdir()
    (mixed / "pretty one.json").write_text("\n\n" + pretty)
    (mixed / "lines.json").write_text('{"a": 5}\n\n{"a": \n{"a": 6}\n[{"a": 7}, {"a": 8}]\n')
    (mixed / "bad first.json").write_text('{"a": \n{"a": 9}\n')
    (mixed / "empty.json").write_text("")
    (mixed / "two.json").write_text("{\n}\n{\n}\n")  # neither a document nor lines
    where = "mixed \\[1\\]"
    assert read(where) == [(1, [1, 2]), (5, None), (6, None), (7, None), (8, None), (9, None)]
    assert sorted(r.line for r in files.bad_lines(spark, str(tmp_path / where), schema).collect()) == ["{", "{"] + ['{"a": '] * 2 + ["}", "}"]


def test_deep_steps_and_long_files(spark):
    deep = 3000
    lines = [f"PS Begin of t <T>s{k}</T> in proof of p" for k in range(deep)] + [f"PS End of t <T>s{k}</T> with 0 goals" for k in reversed(range(deep))]
    episodes = spark.createDataFrame([("p", lines)], "episode string, lines array<string>")
    got = traces.step_tree(episodes).agg(F.count("*"), F.max("depth"), F.max(F.length("path"))).first()
    assert tuple(got) == (deep, deep, 4 * deep - 1)
    rows = spark.range(200_000).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), F.when(F.col("id") % 10 == 0, "Vernac Begin Proof").when(F.col("id") % 10 == 9, "Vernac End Proof").otherwise("x").alias("line"))
    found = traces.blocks(rows).agg(F.count("*"), F.sum(F.size("lines")), F.min(F.col("finished").cast("int")), F.max("block")).first()
    assert tuple(found) == (20_000, 160_000, 1, 20_000)


def test_steps_close_like_a_forward_scan(spark):
    import re

    begin, end, notice = (re.compile(p) for p in (r"PS Begin of (\S+) <T>(.*?)</T>", r"PS End of (\S+) <T>(.*?)</T>", r"PS Notice.*<T>(.*?)</T>"))

    def scan(lines, lo, hi, prefix, depth):
        k, found = lo, []
        while k < hi:
            if m := begin.match(lines[k]):
                count = 1
                for j in range(k + 1, hi):
                    b, e, n = begin.match(lines[j]), end.match(lines[j]), notice.match(lines[j])
                    count += bool(b and b[2] == m[2]) - bool((e and e[2] == m[2]) or (n and n[1] == m[2]))
                    if not count:
                        break
                else:
                    k += 1
                    continue
                if not n:
                    found.append((k, j, m[2]))
                k = j
            k += 1
        out = set()
        for i, (a, b, t) in enumerate(found, 1):
            out |= {(f"{prefix}{i}/{len(found)}", depth, t, a, b)} | scan(lines, a + 1, b, f"{prefix}{i}/{len(found)}-", depth + 1)
        return out

    rng, episodes = random.Random(3), []
    for _ in range(120):
        kinds = ["PS Begin of n <T>{}</T> in proof", "PS End of n <T>{}</T> with 0", "PS Notice: Tactic <T>{}</T> did nothing", "other {}"]
        episodes.append([rng.choices(kinds, [5, 5, 1, 1])[0].format(rng.choice("abc")) for _ in range(rng.randrange(40))])
    frame = spark.createDataFrame([(str(k), e) for k, e in enumerate(episodes)], "episode string, lines array<string>")
    got = {}
    for r in traces.step_tree(frame).collect():
        got.setdefault(r.episode, set()).add((r.path, r.depth, r.tactic, r["first"], r["last"]))
    for k, e in enumerate(episodes):
        assert got.get(str(k), set()) == scan(e, 0, len(e), "", 1)


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_in_blocks(spark, block):
    rng = random.Random(1)
    own = [[float(rng.choice([0, 1, 2, 0.1])) for _ in range(5)] for _ in range(60)]
    v = spark.createDataFrame([(k, x) for k, x in enumerate(own)], "name long, v array<float>")
    q = v.where("name % 3 = 0").withColumnRenamed("name", "query")
    got = {(r.query, r["rank"]): (r.name, r.score) for r in retrieval.top_k(q, v, 4, block).collect()}
    single = np.array(own, np.float32).astype(float)
    for i in range(0, 60, 3):
        score = {n: 100 * functools.reduce(lambda t, ab: t + ab[0] * ab[1], zip(single[i], x), 0.0) for n, x in enumerate(single)}  # in order: sum() compensates
        best = sorted(score, key=lambda n: (-score[n], n))[:4]
        assert [got[i, r + 1] for r in range(4)] == [(n, score[n]) for n in best]
    assert retrieval.top_k(q.limit(0), v, 4).count() == 0 and retrieval.top_k(q, v.limit(0), 4).count() == 0


def test_context_and_choices(spark):
    ranked = spark.createDataFrame([(1, "a_b", 1), (1, "a_b_c", 2), (1, "p", 3), (1, "l", 4), (2, "x", 1), (2, "a", 2)], "query long, name string, rank long")
    items = spark.createDataFrame([(n, k, n.upper()) for n, k in (("a_b", "D"), ("a_b_c", "D"), ("p", "Primitive"), ("l", "Ltac"), ("x", "D"), ("a", "D"))], "name string, kind string, text string")
    current = spark.createDataFrame([(1, "a_b_c")], "query long, current string")
    assert sorted(r.name for r in retrieval.context(ranked, items, current).collect()) == ["a", "l", "x"]
    gold = spark.createDataFrame([(1, "a_b"), (2, "x")], "query long, gold string")
    got = {r.query: r for r in retrieval.multiple_choice(ranked, gold, "s", items).collect()}
    for q, names, skipped in ((1, {"a_b", "a_b_c", "p", "l"}, {"p", "l"}), (2, {"x", "a"}, set())):
        assert set(got[q].choices) == names and got[q].choices[got[q].gold_at] == {1: "a_b", 2: "x"}[q]
        assert got[q].cards == [f"ID {i}: {n.upper()}" for i, n in enumerate(got[q].choices) if n not in skipped]


def test_stratified_tops_up_null_statuses_too(spark):
    rows = [(k, s, d) for k, (s, d) in enumerate([("ok", 1)] * 2 + [("ok", 3)] * 9 + [(None, 2)] * 3 + [(None, 4)] * 3 + [("no", 9)] * 4)]
    df = spark.createDataFrame(rows, "id long, status string, depth long")
    got = runlog.stratified(df, "id", 4, 3, "s").groupBy("status", "depth", "stratum").count().collect()
    assert {(r.status, r.depth, r.stratum): r["count"] for r in got} == {("ok", 1, 1): 2, ("ok", 3, 3): 4, ("ok", 3, 1): 2, (None, 2, 2): 3, (None, 4, 2): 1}


def test_closure_of_chains_forks_and_cycles(spark, tmp_path):
    from traceloom.sources.shared import table_in_shared

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(k, 1000 + k) for k in range(0, 300, 7)]  # a chain whose nodes have ends beside it
    edges += [(2000 + k, 2000 + (k + 1) % 40) for k in range(40)] + [(2005, 3000)]  # a cycle with a way out
    edges += [(3000 + rng.randrange(30), 3000 + rng.randrange(30)) for _ in range(40)] + [(4, 2010)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for start in (0, 150, 2000, 3001, 7777):
        todo, seen = list(after.get(start, ())), set()
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += after.get(n, ())
        want |= {(start, n) for n in seen}
    frame = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(s,) for s in (0, 150, 2000, 3001, 7777)], "start long")
    for plain in (2, 500):
        got = [tuple(r) for r in traces.closure(frame, starts, lambda df: table_in_shared(df, "c"), plain).select("start", "node").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        if plain == 2:
            frame = frame.where("src >= 2000")  # the plain rounds on what has short ways
            starts, want = starts.where("start >= 2000"), {w for w in want if w[0] >= 2000}


def test_dependencies_of_a_long_chain(spark):
    from traceloom.sources.shared import table_in_shared

    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("p"), F.col("id"), F.lit("/f.v")).alias("file"), F.col("id").alias("place"), F.explode(F.array(
        F.struct(F.lit(1).alias("ordinal"), F.concat(F.lit("first"), F.col("id") % 3, F.lit("/x.v")).alias("dep")),
        F.struct(F.lit(2).alias("ordinal"), F.concat(F.lit("p"), F.col("id") + 1, F.lit("/f.v")).alias("dep")))).alias("d")).select("file", "place", "d.*")
    starts = spark.createDataFrame([("/home/p0/f.v",), ("p4990/f",), ("nowhere",)], "path string")
    got = traces.dependencies(table_in_shared(rows, "deps"), starts, lambda df: table_in_shared(df, "c")).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("package").startswith("first")).alias("f"))
    assert {r.path: (r.n, r.f) for r in got.collect()} == {"/home/p0/f.v": (n + 3, 3), "p4990/f": (10 + 3, 3)}


def test_containing(spark):
    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    needles, hays = [text(rng.randrange(20)) for _ in range(60)] + [None], [text(rng.randrange(40)) for _ in range(60)] + [None, ""]
    got = traces.containing(*(spark.createDataFrame([(t,) for t in own], f"{name} string") for name, own in (("needle", needles), ("hay", hays))), anchor=4)
    assert {tuple(r) for r in got.collect()} == {(n, h) for n in needles for h in hays if n and h and n in h}


def test_a_missing_package_may_be_an_error(spark):
    messages = spark.createDataFrame([(1, traces.NO_PATH + "\nQ lib.x\n"), (2, traces.NO_PATH + "\nnone.x")], "id long, text string")
    rules = spark.createDataFrame([("p", "-Q lib A"), ("q", "-R lib B"), ("r", "-Q lib B")], "package string, rule string")
    got = sorted((r.id, r.head, r.package) for r in traces.missing_packages(messages.where("id = 1"), rules, strict=True).collect())
    assert got == [(1, "Q lib", "p"), (1, "Q lib", "r")]
    assert traces.missing_packages(messages, rules).where("package is null").count() == 1
    with pytest.raises(Exception, match="no package for none"):
        traces.missing_packages(messages, rules, strict=True).collect()


@pytest.mark.parametrize(
    "kind,reply,problem",
    [
        ("tactics", '{"TACTICS": [{"tactic": "a", "reason": "b"}]}', None), ("tactics", '{"tactics": [{"tactic": "a"}]}', "a tactic without tactic and reason"), ("tactics", '{"tactics": 3}', "tactics are no list"),
        ("tactics", None, "no JSON object"), ("tactics", '{"tactics": [1]} more', "no JSON object"), ("tactics", "[]", "no JSON object"), ("tactics", "{\"tactics\": []}{}", "no JSON object"), ("generation", '{"x": 1}', "no info or tactics"), ("generation", '{"info": 1}', None),
        ("selection", '{"states": [1, 2, 3, 4]}', "more than three states"), ("selection", '{"States": [1]}', "no states"), ("notes", '{"add": null, "remove": 0}', None),
        ("explanation", '{"before": {"zh": 1, "en": 2}, "after": {"zh": 1, "en": 2}, "tactic": {"zh": 1}}', "tactic lacks a language"), ("strategy", '{"proof_trace": 1, "steps": 2}', "no score"), ("refinement", '{"Refined_Tactic": "", "reason": ""}', None),
    ],
)
def test_reply_problems(spark, kind, reply, problem):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(text.reply_problem(F.col("r"), kind)).first()[0] == problem


def test_a_list_of_tactics_may_do(spark):
    df = spark.createDataFrame([('{"tactics": ["auto"]}',)], "r string")
    assert df.select(text.reply_problem(F.col("r"), "tactics", reasons=False)).first()[0] is None


def test_open_goals_of_shuffled_batches(spark, tmp_path):
    """Batches out of order, and a watermark that settles most of them."""
    from traceloom.streaming import incremental

    rng = random.Random(9)
    rows = [(k, k % 3, rng.choice([0, 0, 1, 2, 3])) for k in range(240)]
    batches = [rows[k : k + 40] for k in range(0, 240, 40)]
    for k in range(0, 6, 2):  # two batches' events are mixed: up to 80 seconds late
        both = batches[k] + batches[k + 1]
        rng.shuffle(both)
        batches[k], batches[k + 1] = both[:40], both[40:]
    schema = "id long, key long, goals long, ts timestamp"
    for k, b in enumerate(batches):
        frame = spark.createDataFrame(b, "id long, key long, goals long").withColumn("ts", F.timestamp_seconds(F.col("id") + 1_000_000))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = incremental.live_open_goals(stream, "key", "id", F.col("goals"), "ts", "90 seconds")
    incremental.write_updates(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.key: r.left_open for r in incremental.latest(spark.read.parquet(str(tmp_path / "out")), ["key"], "batch", ["left_open"]).collect()}
    want = {}
    for _, key, g in rows:
        want[key] = after(want.get(key, 1), g)
    assert got == want


def test_closures_send_nothing_through_the_driver(spark):
    from traceloom.sources.shared import table_in_shared

    plans = []

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table_in_shared(df, "closure")

    deps = spark.createDataFrame([(f"g{k % 3}/f{k}.v", k, o, f"g{d % 3}/f{d}.v") for k in range(2, 30) for o, d in ((1, k // 2), (2, k - 1))], "file string, place long, ordinal long, dep string")
    got = traces.dependencies(deps, spark.createDataFrame([("/root/g2/f5.v",)], "path string"), settle)
    assert {r.package for r in got.collect()} == {"g0", "g1", "g2"}
    rounds = [p for p in plans if "start" in p]
    assert len(rounds) > 3 and not any("Broadcast" in p for p in rounds)


def test_cells_of_the_grid_take_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(1500, 8)), rng.normal(size=(4096, 8))
    queries, vectors = pd.DataFrame({"query": range(1500), "v": list(q)}), pd.DataFrame({"name": range(4096), "v": list(v)})
    tracemalloc.start()
    got = retrieval._best_of_cell(3)(queries, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["name"].tolist() == np.argsort(-(q @ v.T), axis=1)[:, :3].ravel().tolist()
    assert peak < 40_000_000  # the whole product alone takes 49 MB


def test_open_goals_keep_their_state_by_bucket(spark, tmp_path):
    """As many states as buckets, whatever the keys, null ones and texts too; counts as row by row."""
    from traceloom.streaming import incremental

    rng = random.Random(4)
    rows = [(k, rng.choice([None, "a", "bc", *(f"key{i}" for i in range(40))]), rng.choice([0, 0, 1, 1, 2, 3])) for k in range(600)]
    frame = spark.createDataFrame(rows, "id long, key string, goals long").withColumn("ts", F.timestamp_seconds(F.col("id") + 1_000_000))
    frame.repartition(6, "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    live = incremental.live_open_goals(stream, "key", "id", F.col("goals"), "ts", "600 seconds", buckets=5)
    query = incremental.write_updates(live, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6
    got = {r.key: r.left_open for r in incremental.latest(spark.read.parquet(str(tmp_path / "out")), ["key"], "batch", ["left_open"]).collect()}
    want = {}
    for _, key, g in rows:
        want[key] = after(want.get(key, 1), g)
    assert got == want


def test_lists_meet_the_vocabulary_once_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a c"), (1, "d x"), (None, "b"), (2, " "), (3, None), (4, "a " * 500 + "c")], "doc_id long, text string")
    v = spark.createDataFrame([("a", 1000), ("b", 1001), ("c", 1002), ("d", 1003)], "token string, id long")
    lists = vocabulary.item_lists(docs, "doc_id", "text")
    for block in (1, 3, 10**6):
        monkeypatch.setattr(vocabulary, "BLOCK", block)
        ids = vocabulary.encoded_lists(lists, v)
        assert {r.item: r.ids for r in ids.collect()} == {1: [1000, 1003, 1001, 1000, 1002], None: [1001], 4: [1000] * 500 + [1002]}
        assert {r.item: r.text for r in vocabulary.decoded_lists(ids, v).collect()} == {1: "a d b a c", None: "b", 4: "a " * 500 + "c"}
    met, write = [], vocabulary.table_in_shared
    monkeypatch.setattr(vocabulary, "table_in_shared", lambda df, tag: met.append(write(df, tag)) or met[-1])
    vocabulary.encoded_lists(lists.where("item = 4"), v).collect()
    assert [len(r.words) for r in met[0].where("words is not null").collect()] == [2]  # of 501 places
    with pytest.raises(Exception, match="no token for id 7"):
        vocabulary.decoded_lists(spark.createDataFrame([(1, [7])], "item long, ids array<long>"), v).collect()

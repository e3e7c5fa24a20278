"""The conversation trie, spelling variants and line dedup against brute force, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from traceloom.llm import lines, queries, trie, variants

DATA = "/root/testdata/sf0.001"


# --- conversations -----------------------------------------------------------------------------------------------


def rebuilt(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[-1 if c is None else c].append((t is not None, t or 0, role or "", text or ""))
    turns = {}
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))
        turns[c] = [x[2:] for x in own]
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(conversations.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(c, t, "user", f"same {t % 2}") for c in range(200, 260) for t in range(c % 5)]  # many copies, some conversations left without turns
    rows += [(200, t, "user", f"same {t % 2}") for t in range(3)]
    rows += [(705, 0, "user", "alone"), (None, None, None, None), (None, 1, "a", "b"), (901, None, "x", None), (901, 2, "x", ""), (901, 2, "x", "tie"), (901, 2, "x", "tie")]
    rows += [(-250, 1, "user", "below zero"), (1001, 0, "é", "ü" * 5000), (1 << 40, 0, "user", "far")]
    rows += [(1100, t, "user", f"long {t}") for t in range(700)]
    return rows


@pytest.mark.parametrize("most", [20_000, 50])
def test_trie(spark, talks, most):
    frame = spark.createDataFrame([(*r, 1, "k") for r in talks], "conv_id long, turn long, role string, text string, pos int, key string").repartition(5)
    got = nodes(trie.prefix_trie(trie.with_borrowed_heads(trie.turns(frame)), most))
    assert got == brute_trie(rebuilt(talks))


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert nodes(trie.prefix_trie(trie.with_borrowed_heads(trie.turns(frame)))) == []


def test_trie_of_one_long_conversation(spark):
    rows = [(7, t, "u", str(t)) for t in range(300)] + [(8, 0, "u", "0")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = nodes(trie.prefix_trie(trie.turns(frame), 30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_trie({7: [("u", str(t)) for t in range(300)], 8: [("u", "0")]})


# --- spelling variants -------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(count, times=10):
    out = {}
    for w, n in count.items():
        close = sorted((-m, v) for v, m in count.items() if abs(len(v) - len(w)) < 2 and v != w and near(v, w))
        form = close[0][1] if close and -close[0][0] >= times * n else None
        out[w] = (n, len(close), form, -close[0][0] if form else None)
    rows = []
    for w, (n, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def brute_words(rows, drop):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{-1 if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def found_variants(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    chains = " ".join(["abcdefgh"] * 4000 + ["abcdefgx"] * 300 + ["abcdefyx"] * 20 + ["abcdzfyx"] * 2)
    anagrams = " ".join(w for k in range(40) for w in ["abcdefghij"[k % 10 :] + "abcdefghij"[: k % 10]] * 2)
    ties = "letters letters lettres lettres lettrex lettrex " + "lettren " * 30 + "lettrea " * 30
    return [
        (1, chains), (2, anagrams), (3, ties), (3, ties), (4, None), (5, ""), (6, "short"), (None, "Señorita SEÑORITA señorita ÑANDÚES ñandúes Ñandúes × ÷"),
        (8, "x" * 40_000 + " " + "x" * 40_000 + " " + "x" * 39_999 + " " + "x" * 39_999), (9, "wörter-wörter'wörtern wörtern 123wörtern"),
    ]


@pytest.mark.parametrize("cell", [8192, 24])
def test_variants(spark, texts, monkeypatch, cell):
    monkeypatch.setattr(variants, "CELL", cell)
    rows = texts + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([(*r, 1, "w", "f") for r in rows], "doc_id long, text string, n int, word string, root string").repartition(3)
    for drop in (31, None):
        assert found_variants(variants.grouped(docs, drop_one_in=drop)) == brute_variants(brute_words(rows, drop))


def test_cells_of_equal_counts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(variants, "CELL", 4)
    words = ["aaaaaaa" + c + d for c in "bcdef" for d in "bcdef"] + ["aaaaaaa" + d for d in "bcdef"] + ["aaaaabaa", "aaabaaaa", "abaaaaaa", "baaaaaaa", "aabaaaaa"]
    frame = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in variants.near_words(frame).collect()}
    n = {w: k + 1 for k, w in enumerate(words)}
    for w in words:
        close = sorted((-n[v], v) for v in words if v != w and near(v, w))
        assert got.get(w) == ((len(close), close[0][1], -close[0][0]) if close else None)


def test_no_words(spark):
    assert found_variants(variants.grouped(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert found_variants(variants.grouped(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))) == []


# --- lines -------------------------------------------------------------------------------------------------------


def brute_lines(rows, least_chars=40, least_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= least_chars else None

    where = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(-1 if doc is None else doc)
    common = {k: max(d) for k, d in where.items() if k is not None and len(d) >= least_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [line for line in own if key(line) not in common or common[key(line)] == (-1 if doc is None else doc)]
        out.append((-1 if doc is None else doc, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(spark):
    shared = "This line stands in many of the documents, word for word."
    edge, wide = "x" * 39, "Ä" * 40
    rows = [(k, f"Own line of document {k} which nobody else has at all.\n{shared}\n{edge}\n{wide}") for k in range(1, 8)]
    rows += [(20, f"\t {shared.upper()} \r\n{shared}\n\n{shared}"), (21, shared), (None, shared), (None, f"{shared}\nmore"), (22, None), (23, ""), (24, "\n\n"), (25, wide.lower())]
    rows += [(30, (shared + "\n") * 20_000), (31, "y" * 200_000), (7, shared), (7, shared)]
    return rows + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize(("batches", "fanout"), [(4, 3), (7, 2), (1, 4)])
def test_lines(spark, pages, batches, fanout):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in pages], "doc_id long, text string, _lines int, h1 int, _hits string").repartition(5)
    got = lines.without_common_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "_lines", "h1", "_hits", "__lines", "_dropped"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r["__lines"], r["_dropped"]) for r in got.collect()) == brute_lines(pages)


def test_no_lines(spark):
    assert lines.without_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_compacted_and_settled_keys_stay_out(spark):
    runs = lines.LineRuns(spark, enough=2, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(1, 1, 100 - 2 * k), (1, 1, 99 - 2 * k), (k, k, 100 - 2 * k)], "h1 long, h2 long, doc_id long")
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r.h1, r.h2): (r.n, r.last) for r in runs.merged().collect()}
    assert got == {(1, 1): (2, 100), (0, 0): (1, 100), (2, 2): (1, 96), (3, 3): (1, 94), (4, 4): (1, 92)}
    runs.close()
    assert not runs.names()


# --- the registered queries --------------------------------------------------------------------------------------

TYPES = {
    "op11_prefix_trie": [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")],
    "op12_spelling_variants": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
    "op13_line_dedup": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")],
}


@pytest.mark.parametrize("name", list(TYPES))
def test_query_matches_its_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert got.dtypes == TYPES[name]
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    plain = lambda df: sorted(tuple("null" if pd.isna(v) else str(v if isinstance(v, str) else int(v)) for v in r) for r in df[list(got.columns)].itertuples(index=False))
    assert plain(got.toPandas()) == plain(want)


# --- learning from rows without ids ------------------------------------------------------------------------------


def test_languages_are_learned_whatever_the_ids(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        from traceloom.llm import language

        renumbered = docs.withColumn("doc_id", ids)
        model = language.train(renumbered, public_tokenizers.path("piece_bpe_32k.model"))
        kept = language.accepted(renumbered.withColumn("was", F.col("lang")), model)
        assert kept.count() > 190 and kept.where("lang != was").count() == 0


# --- what batches and buckets must not lose ----------------------------------------------------------------------


def test_gradients_of_one_word_add_up():
    import numpy as np

    from traceloom.llm import logbilinear

    rng = np.random.default_rng(0)
    rows = np.r_[np.full(1000, 3), rng.integers(0, 9, 500)]
    grad = rng.normal(size=(len(rows), 4))
    want = np.zeros((9, 4))
    np.add.at(want, rows, grad)
    own, total = logbilinear.summed(rows, grad)
    assert own.tolist() == list(range(9))
    np.testing.assert_allclose(total, want)


def test_near_copies_meet(spark):
    import random

    from traceloom.llm import simhash

    rng, rows, similar = random.Random(4), [], []
    words = [f"w{k}" for k in range(5000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    jaccard = lambda x, y: len(x & y) / len(x | y)
    for target in [0.8] * 150 + [0.85] * 100 + [0.9] * 100:
        while True:
            a = rng.choices(words, k=rng.choice([120, 300, 700]))
            b, own = list(a), shingles(a)
            while jaccard(own, shingles(b)) > target + 0.01:
                b[rng.randrange(len(b))] = rng.choice(words)
            if jaccard(own, shingles(b)) >= target:
                break
        rows += [(2 * len(similar), " ".join(a)), (2 * len(similar) + 1, " ".join(b))]
        similar.append(target)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    of = {r.doc_id: r.component for r in simhash.near_copies(frame).collect()}
    met = {t: [of[2 * k] == of[2 * k + 1] for k, x in enumerate(similar) if x == t] for t in (0.8, 0.85, 0.9)}
    assert [sum(m) / len(m) >= least for m, least in zip(met.values(), (0.88, 0.95, 0.99))] == [True] * 3  # nine in ten at 0.8, give or take two
    assert len(set(of.values())) == len(rows) - sum(map(sum, met.values()))

"""Operators against brute force, on the smallest tables with awkward rows added."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm import common, embeddings, language, logbilinear, mixing, packing, quality, rules, simhash, spans, suffixes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, start string, length string, fp string, component_id string, words string, salt int, score string, _bucket int"
PASSAGE = "One shared passage of many words stands here. It has a second sentence of some length too. And a third one that ends the whole thing."


@pytest.fixture(scope="module")
def rows(spark):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    more = [
        (9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, " \n\t ", "en", "src0", 4), (9004, "a", "en", "src1", 1),
        (9005, "x" * 300_000, "en", "src1", 1), (9006, "the of and " * 9000, "en", "src2", 1), (9007, "Ünï ﬁn 中文字 <|endoftext|> ’s 12½ İ ǅ", None, "src2", 1),
        (9008, PASSAGE, "en", "src3", 1), (9009, "Start here. " + PASSAGE + " End there.", "en", "src3", 1), (9010, PASSAGE, "en", "src3", 1),
        (9010, PASSAGE, "en", "src3", 1), (9011, "one two three four five six seven eight\n" * 4, "de", "", 1),
        (9012, "# * $ % & | < > !", "es", "src0", 1), (9013, "é" * 60 + "a" * 49, "fr", "src0", 1),
    ]
    return base + more


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "l", "f", "c", "w", 2, "x", 3) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_pack(docs, rows):
    from tokenizers import Tokenizer

    got = packing.pack(docs, TOKENIZER).toPandas()
    tokenizer, want = Tokenizer.from_file(TOKENIZER), Counter()
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    least = -(-int(got.length.sum()) // 2048)
    assert got.sequence_id.nunique() <= least + 2


def test_pack_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_histogram_is_whole(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(np.minimum(64, rng.geometric(0.04, 5000)), minlength=65)
    hist[0] = 0
    packed, left = packing.pack_histogram(hist, 64), hist.copy()
    for lengths, times in packed:
        assert sum(lengths) <= 64 and times > 0
        for v in lengths:
            left[v] -= times
    assert not left.any()
    assert sum(t for _, t in packed) <= 1.02 * (hist * np.arange(65)).sum() / 64 + 1


def brute_fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def united(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {d: brute_fingerprint(t) for d, t, *_ in rows}
    assert all(r.fp % (1 << 64) == prints[r.doc_id] for r in got)
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = united(ids, links)
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_simhash_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.deduplicated(nothing).count() == 0


def brute_shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_copies(docs, rows, spark):
    rng, base = np.random.default_rng(8), next(t for d, t, *_ in rows if t and 300 < len(words(t)) < 900)
    more = []
    for k in range(30):
        w = base.split()
        for at in rng.choice(len(w), k // 3, replace=False):
            w[at] = f"new{k}x{at}"
        more.append((10_000 + k, " ".join(w), "en", "src0", 1))
    every = rows + more
    df = spark.createDataFrame([(*r, 1, "s", "l", "f", "c", "w", 2, "x", 3) for r in every], SCHEMA)
    got = {}
    for r in simhash.near_copies(df).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    sets = {d: brute_shingles(t) for d, t, *_ in every}
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    near = [(a, b) for a, b in alike if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])]
    of = {d: c for c, members in got.items() for d in members}
    assert sum(of[a] == of[b] for a, b in near) >= 0.98 * len(near) > 100
    assert sum(of[a] == of[b] for a, b in alike) >= 0.9 * len(alike)
    want = united(ids, alike)
    assert all(len({want[d] for d in members}) == 1 for members in got.values())
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(min(m) for m in got.values())


def test_one_of_equal_rows_stays(spark):
    other = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, PASSAGE, 1), (None, PASSAGE, 1), (None, other, 2), (4, other + " ", 3), (5, "solo text", 4), (5, "solo text", 4), (6, None, 5), (7, " ", 6)], "doc_id long, text string, key int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.key) for r in simhash.deduplicated(df).collect())
    assert got == [(-1, 1), (-1, 2), (5, 4), (6, 5)]


def test_buckets_of_any_size_link_nearest():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 32, dtype=np.uint32) ^ (np.uint32(1) << rng.integers(0, 32, 6000, dtype=np.uint32))
    bucket = simhash._Bucket(11)
    ends = [bucket.add(np.arange(lo, lo + 1500), fp[lo : lo + 1500]) for lo in range(0, 6000, 1500)]
    a, b = (np.concatenate([x for e in ends for x in e[k]]) for k in (0, 1))
    assert sorted(a.tolist()) == list(range(1, 6000)) and (b < a).all() and len(bucket.node) < 4400
    small = simhash._Bucket(11)
    ends = [small.add(np.arange(lo, lo + 2), fp[lo : lo + 2]) for lo in (0, 2)]
    assert sorted((int(x), int(y)) for e in ends for a, b in zip(*e) for x, y in zip(a, b)) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


def test_near_copies_find_every_link_that_meets(spark):
    """A chain of texts and a crowd of texts 0.7 similar to each: the links are exactly those of the pairs that meet in a bucket."""
    rng, rows = np.random.default_rng(11), []
    base = [f"b{k}" for k in range(260)]
    for k in range(140):
        w = list(base)
        for at in rng.choice(len(w), 2 + k % 5, replace=False):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash._printed(df, 5).toPandas().sort_values("node", ignore_index=True)
    keys = simhash.wide_variants(nodes[simhash.PRINT].to_numpy().view(np.uint64))
    sketch = nodes[simhash.PRINT[0]].to_numpy().astype(np.int32).view(np.uint32)
    sets, ids = [frozenset(simhash.shingle_hashes(dict(rows)[d], 5).tolist()) for d in nodes["doc_id"]], nodes["doc_id"].tolist()
    meet = [(i, j) for i in range(140) for j in range(i) if int(sketch[i] ^ sketch[j]).bit_count() <= 11 and np.intersect1d(keys[i], keys[j]).size]
    linked = [(ids[i], ids[j]) for i, j in meet if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 100 < len(linked) < len(meet)
    got, want = {}, united(ids, linked)
    for r in simhash.near_copies(df).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    expected = {}
    for d, c in want.items():
        expected.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_copies_write_no_pairs_of_a_crowd(spark, monkeypatch):
    """What is verified between components is written as texts, once a bucket, and comes back as a forest of links, in groups of any size."""
    rng, rows, tables = np.random.default_rng(13), [], {}
    for k in range(90):
        w = [f"b{k}" for k in range(300)]
        for at in rng.choice(len(w), 5, replace=False):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    write = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, tag, *a: tables.setdefault(tag, write(df, tag, *a)))
    monkeypatch.setattr(simhash, "discard", lambda df: None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 32):
        tables.clear()
        monkeypatch.setattr(simhash, "BLOCK", block)
        of = {r.doc_id: r.component for r in simhash.near_copies(df).collect()}
        assert tables["simhash-rest"].count() < len(rows)
        groups = tables["simhash-across"].toPandas()
        assert len(groups) == len(groups.drop_duplicates()) and groups.groupby("key").size().max() <= 2 * block
        met = tables["simhash-met"].count()
        assert len(groups) <= met
        split = of if block == 4096 else split
        parts = lambda of: sorted(sorted(d for d in of if of[d] == c) for c in set(of.values()))
        assert parts(of) == parts(split)


def test_first_variant_is_shared():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, (300, 9), dtype=np.uint64)
    y = rng.integers(0, 1 << 63, (300, 9), dtype=np.uint64)
    for k in range(300):
        y[k, k % 9] = x[k, k % 9]
        for _ in range(k % 3):
            y[k, k % 9] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    one, other = simhash.first_variant(x, y), simhash.first_variant(y, x)
    assert (one == other).all()
    for k in range(300):
        assert all(one[k] in simhash.wide_variants(f[k : k + 1]).view(np.int64) for f in (x, y))


def test_odd_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 5, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 63, size // 3 + 1, dtype=np.uint64)]))
        bits = np.bitwise_count(np.frombuffer(simhash._odd(a), np.uint8) ^ np.frombuffer(simhash._odd(b), np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_simhash_variants_meet():
    rng = np.random.default_rng(1)
    for distance in (1, 2, 3):
        for _ in range(50):
            x = rng.integers(0, 1 << 63, dtype=np.uint64)
            y = x
            for b in rng.choice(64, distance, replace=False):
                y ^= np.uint64(1 << int(b))
            assert np.intersect1d(simhash.variants(np.array([x])), simhash.variants(np.array([y]))).size


@pytest.mark.parametrize("size", [5, 300])
def test_simhash_buckets_keep_components(size):
    rng = np.random.default_rng(size)
    fp = np.unique(rng.integers(0, 1 << 11, size, dtype=np.uint64))
    a, b = simhash.bucket_links(np.zeros(len(fp), np.int64), fp, 3)
    assert len(a) < len(fp)
    values = [int(v) for v in fp]
    want = united(values, [(u, v) for u in values for v in values if u < v and (u ^ v).bit_count() <= 3])
    assert united(values, list(zip(a.tolist(), b.tolist()))) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = united({n for e in chain for n in e}, chain)
    assert got == {n: c for n, c in want.items() if n != c}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows):
    first: dict[bytes, int] = {}
    for d, t, *_ in rows:
        x = (t or "").encode()
        for i in range(len(x) - 49):
            w = x[i : i + 50]
            first[w] = min(d, first.get(w, d))
    want = []
    for d, t, *_ in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(x, gone) if not g)
        want.append((d, len(x), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def removed(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_suffixes(docs, rows):
    assert removed(suffixes.deduplicated(docs)) == brute_removed(rows)


def test_suffixes_of_a_passage_in_many_documents(spark):
    rng, rows = np.random.default_rng(6), []
    for d in range(300):
        own = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
        rows.append((d, own(int(rng.integers(60))) + PASSAGE[: int(rng.integers(40, len(PASSAGE)))] + own(int(rng.integers(60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_removed(rows)
    spans_ = suffixes.removed_spans(df, together=5)
    assert sum(w[2] > 0 for w in want) > 200
    marked = {}
    for r in spans_.collect():
        marked.setdefault(r.doc_id, set()).update(k for s in r.spans for k in range(s.a, s.b))
    assert {d: len(m) for d, m in marked.items()} == {w[0]: w[2] for w in want if w[2]}
    assert removed(suffixes.deduplicated(df)) == want


def test_suffixes_nothing(nothing):
    assert suffixes.deduplicated(nothing).count() == 0


def test_interval_expansion_finds_equal_windows():
    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 100, 400).astype(np.uint8))
    contexts = [base[i : i + int(rng.integers(50, 85))] for i in rng.integers(0, 300, 60)]
    docs_ = rng.integers(0, 50, 60)
    got = suffixes.smallest_documents(contexts, docs_, 50)
    least: dict[bytes, int] = {}
    for c, d in zip(contexts, docs_):
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(d, least.get(c[i : i + 50], d))
    for c, g in zip(contexts, got):
        assert g.tolist() == [least[c[i : i + 50]] for i in range(len(c) - 49)]


def test_levels_double_to_any_length(monkeypatch):
    """Levels go to 50 in seven sums over a shard; one a byte took 49."""
    sums, cumsum = [], np.cumsum
    monkeypatch.setattr(suffixes.np, "cumsum", lambda *a, **k: sums.append(1) or cumsum(*a, **k))
    rng = np.random.default_rng(9)
    for length in (25, 32, 49, 50, 51, 63, 64):
        base = rng.integers(97, 100, 3000, dtype=np.uint8)
        cuts = [base[a : a + int(size)] for a, size in zip(rng.integers(0, 2900, 60), rng.integers(length, 90, 60))]
        text = np.concatenate([np.r_[c, np.uint8(255)] for c in cuts])
        monkeypatch.setattr(suffixes, "suffix_order", lambda t: np.array(sorted(range(len(t)), key=lambda k: (np.concatenate([t[k:], t[:k]])[:80].tobytes(), k))))
        sums.clear()
        order, apart = suffixes.equal_prefixes(text, length)
        assert len(sums) <= 11
        twice = np.concatenate([text, text])
        own = [twice[k : k + length].tobytes() for k in order.tolist()]
        assert apart.tolist() == [k == 0 or own[k] != own[k - 1] for k in range(len(own))]
        assert 0 < (~apart).sum()


def test_hashes_are_of_the_bytes_alone():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 99, 5000, dtype=np.uint8).tobytes()
    first = rng.integers(0, 4900, 4000)
    end = first + rng.integers(8, 77, 4000)
    got = suffixes.hashed(suffixes.words_at(raw), first, end).tolist()
    texts = [raw[a:b] for a, b in zip(first, end)]
    assert len(set(zip(got, texts))) == len(set(got)) == len(set(texts))
    tail = suffixes.hashed(suffixes.words_at(raw[4950:]), np.array([0, 42]), np.array([50, 50])).tolist()
    assert tail == suffixes.hashed(suffixes.words_at(raw), np.array([4950, 4992]), np.array([5000, 5000])).tolist()


def test_long_texts_are_cut_with_overlap(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(suffixes, "BUFFER", 1000)
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    starts = []
    for rows_, offsets, parts in suffixes._buffers(pd.DataFrame({"text": ["short", text, ""]}), 50):
        base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        part, first, last, _, own = suffixes.anchored(parts, 50)
        assert ((own >= first) & (own + suffixes.GRAM <= first + 50) | (own > first)).all()
        for p, a, b in zip(part, first, last):
            assert rows_[p] == 1
            starts += range(a - base[p] + offsets[p], b - base[p] + offsets[p] + 1)
    assert sorted(starts) == list(range(5000 - 49))


def test_mixing(docs, rows):
    weights = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    tokens = Counter()
    for d, t, lang, source, _ in rows:
        tokens[re.match("[A-Za-z]*", source or "")[0] or "(none)", lang or "(none)", source if source is not None else "(none)"] += len(words(t))
    total = sum(tokens.values()) // 2
    got = mixing.mix(docs, weights, total=total, epochs=3).toPandas()
    assert list(got.columns) == [*docs.columns, "_domain", "_tokens", "_epoch"] and (got._bucket == 3).all()
    taken = docs.withColumn("_domain", F.lit(5)).withColumn("_row", F.lit(6)).withColumn("_rest", F.lit(7))
    again = mixing.mix(taken, weights, total=total, epochs=3)
    assert again.columns == [*taken.columns, "__domain", "_tokens", "_epoch"]
    assert again.where("_domain = 5 and _row = 6 and _rest = 7 and _bucket = 3").count() == len(got)
    per = {}
    for d in {k[0] for k in tokens}:
        for lang in {k[1] for k in tokens if k[0] == d}:
            per[d, lang] = weights["lang"].get(lang)
    want = mixing.budgets(dict(tokens), total, {k: v for k, v in per.items() if v is not None}, 3)
    texts = {}
    for d, t, lang, source, _ in rows:
        texts.setdefault((re.match("[A-Za-z]*", source or "")[0] or "(none)", lang or "(none)", source if source is not None else "(none)"), []).append((d, len(words(t))))
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    for leaf, members in texts.items():
        whole, rest = divmod(want[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        order = {r.d: r.h for r in spark.createDataFrame([(d,) for d, _ in members], "d long").select("d", F.xxhash64(F.lit(17), F.lit(whole).cast("long"), "d").alias("h")).collect()}
        count, so_far = Counter(), 0
        sizes = Counter()
        for d, n in members:
            sizes[d] += n
        copies = Counter(d for d, _ in members)
        for d in sorted(sizes, key=lambda d: (order[d], d)):
            so_far += sizes[d]
            count[d] = (whole + (rest > 0 and so_far <= rest)) * copies[d]
        mine = got[(got._domain == leaf[0]) & (got.lang.fillna("(none)") == leaf[1]) & (got.source.fillna("(none)") == leaf[2])]
        assert Counter(mine.doc_id.tolist()) == Counter({k: v for k, v in count.items() if v})


def test_mixing_nothing(nothing):
    assert mixing.mix(nothing, {}).count() == 0


def test_budgets_redistribute_among_siblings_first():
    leaves = {("d", "en", "a"): 10, ("d", "en", "b"): 1000, ("d", "de", "c"): 1000}
    got = mixing.budgets(leaves, 400, {("d", "en"): 0.5, ("d", "de"): 0.5, ("d", "en", "a"): 0.5, ("d", "en", "b"): 0.5}, 1)
    assert got == {("d", "en", "a"): 10, ("d", "en", "b"): 190, ("d", "de", "c"): 200}
    short = mixing.budgets({("d", "en", "a"): 10, ("d", "de", "c"): 1000}, 400, {("d", "en"): 0.5, ("d", "de"): 0.5}, 1)
    assert short == {("d", "en", "a"): 10, ("d", "de", "c"): 390}
    assert sum(mixing.share_out(100, [1, 1, 1], [100, 100, 100])) == 100


def test_budgets_keep_languages_without_a_weight():
    leaves = {("d", "(none)", "a"): 900, ("d", "en", "a"): 100, ("e", "it", "b"): 300, ("e", "en", "b"): 60, ("e", "de", "b"): 40, ("f", "(none)", "c"): 50}
    per = {(d, lang): w for d in "def" for lang, w in (("en", 0.4), ("de", 0.2))}
    got = mixing.budgets(leaves, 1450, per, 4)
    assert sum(got.values()) == 1450 and got["d", "(none)", "a"] == 900 and got["e", "it", "b"] == 300 and got["f", "(none)", "c"] == 50
    assert abs(got["e", "en", "b"] - 2 * got["e", "de", "b"]) <= 2 and got["e", "en", "b"] + got["e", "de", "b"] == 100
    shut = mixing.budgets(leaves, 1450, per | {("d", "(none)"): 0.0}, 4)
    assert shut["d", "(none)", "a"] == 0 and sum(shut.values()) == 1450
    assert mixing.budgets(leaves, 10**6, per | {("d", "(none)"): 0.0}, 4) == {p: 0 if p[:2] == ("d", "(none)") else 4 * t for p, t in leaves.items()}


def brute_logs(model, counts, text):
    """log10 probability of a text, one token at a time, from the weights."""
    w, z = model.weights, model.sizes
    own = {x: logbilinear.FIRST + k for k, x in enumerate(model.words.split(b"\n")[: z.items - logbilinear.FIRST])}
    total, before = 0.0, [0] * logbilinear.PLACES
    for word in [*(x.encode() for x in words((text or "").translate(LOWER))), None]:
        item = 0 if word is None else own.get(word, 1 + zlib.crc32(word[-2:]) % logbilinear.ENDINGS)
        h = sum(w["r"][p].astype(float) * w["place"][k] for k, p in enumerate(before))
        h = [*h, 1.0]
        s = w["qc"].astype(float) @ h
        c = int(np.searchsorted(z.start, item, side="right")) - 1
        total += (s[c] - np.log(np.exp(s).sum())) / np.log(10)
        low = z.start[c]
        s = w["q"][low : z.start[c + 1]].astype(float) @ h
        total += (s[item - low] - np.log(np.exp(s).sum())) / np.log(10)
        if 0 < item < logbilinear.FIRST:
            total += math.log10(counts[word] + 0.1) - model.shared[item]
        before = [item, *before[:-1]]
    return total


def test_logbilinear(docs, rows):
    train = docs.where("doc_id % 5 != 0")
    model, counts = logbilinear.learn(train)
    got = logbilinear.score(docs, model, counts).collect()
    assert len(got) == len(rows)
    tokens = {d: [*words((t or "").translate(LOWER)), None] for d, t, *_ in rows}
    c = Counter()
    for d, t, *_ in rows:
        if d % 5:
            c.update(tokens[d])
    total, kinds = sum(c.values()), len(c)
    texts = {d: t for d, t, *_ in rows}
    by_word = Counter({w.encode(): n for w, n in c.items() if w is not None})
    for r in got:
        own = tokens[r.doc_id]
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_tokens == len(own) and r.n_known == sum(c[w] > 0 for w in own)
        assert r.train_tokens == total and r.score < 0
        if len(own) < 3000:
            assert math.isclose(r.score, brute_logs(model, by_word, texts[r.doc_id]), rel_tol=1e-4)
    held = [r for r in got if r.doc_id % 5 == 0 and r.doc_id < 9000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_logbilinear_sums_to_one(docs):
    model, counts = logbilinear.learn(docs)
    z = model.sizes
    for before in ([0, 0, 0, 0], [70, 3, 66, 0]):
        every = logbilinear.item_logs(model.weights, z, np.repeat([before], z.items, axis=0), np.arange(z.items))
        assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)
    vocabulary = set(model.words.split(b"\n")[: z.items - logbilinear.FIRST])
    shares = Counter()
    for r in counts.collect():
        if r.word.encode() not in vocabulary:
            shares[logbilinear.ending(r.word.encode())] += r.c + 0.1
    assert len(shares) > 10 and all(math.isclose(n + 0.1, 10 ** model.shared[k], rel_tol=1e-9) for k, n in shares.items())


def test_logbilinear_vocabulary_grows(docs, spark):
    few, _ = logbilinear.learn(docs.where("doc_id < 40"))
    many, _ = logbilinear.learn(docs)
    assert logbilinear.FIRST < few.sizes.items < many.sizes.items


def test_logbilinear_learns_what_follows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{v}{rng.integers(8)}" for _ in range(60)) for v in "abcd" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = logbilinear.learn(df.where("doc_id % 10 != 0"))
    held = logbilinear.score(df.where("doc_id % 10 = 0"), model, counts).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[1] / held[2] < -1.45 and held[0] / held[2] > -1.25  # of 32 words, eight can follow


def test_logbilinear_nothing(nothing, docs):
    model, counts = logbilinear.learn(nothing)
    assert model.documents == 0 and logbilinear.score(nothing, model, counts).count() == 0
    assert all(r.n_known == 0 for r in logbilinear.score(docs.limit(5), model, counts).collect())


def test_quality(docs, nothing, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(9001, None), (None, 1), (77777, 1)], "doc_id long, quality int"))
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    known = [(r.quality, scored[r.doc_id]) for r in labels.collect() if r.quality is not None and r.doc_id in scored]
    assert all(0 <= s <= 1 for s in scored.values())
    assert sum((s >= 0.3) == (q == 1) for q, s in known) >= 0.97 * len(known)
    empty = quality.train(nothing, labels.limit(0))
    assert quality.score(nothing, empty).count() == 0 and quality.score(docs, empty).count() == docs.count()


def unit(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = unit(rng, 300)
    hub = unit(rng, 1)
    near = np.vstack([hub + 0.02 * rng.normal(size=16) for _ in range(120)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, near, near[:3], 3 * near[:2]]))]
    extra = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [float("inf")] * 16), (9005, []), (9006, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows + extra], "vec_id long, embedding array<double>, node string, kept string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, shards=3).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    want = united(range(len(v)), zip(*np.nonzero(np.triu(link))))
    assert len(got) == len(rows) + len(extra)
    found, true = sum(got[i].n_links for i in range(len(v))), int(link.sum())
    assert 0.98 * true <= found <= true
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in extra)


def test_audited_beam_counts_real_links():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, np.repeat(x[:1], 60, 0) + rng.normal(size=(60, 16)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    class Blind(embeddings.Graph):
        """Meets nothing but the vector itself until its beam is wide."""

        def search(self, q, beam, limit=None):
            ids, sims = super().search(q, beam, limit)
            if limit is None and beam < 256:
                sims = np.where(sims > 1 - 1e-6, sims, -9)
            return ids, sims

    assert embeddings.audited_beam(Blind(x), x, 0.95, 64, 0.98, 64) == 256
    assert embeddings.audited_beam(embeddings.Graph(x), x, 0.95, 64, 0.98, 64) == 64
    assert embeddings.audited_beam(embeddings.Graph(x[:1]), x[:1], 0.95, 64, 0.98, 64) == 64


def test_embeddings_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rules(docs, rows, spark, nothing):
    got = {}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for r in rules.judged(docs, labels).collect():
        got[r.doc_id] = r
    for d, t, *_ in rows:
        w, text, n = words(t), t or "", len(words(t))
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        c, covered = Counter(tuple(w[i : i + 8]) for i in range(n - 7)), set()
        for i in range(n - 7):
            if c[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))
        assert r.base_failed == (n < 20 or 100 * len(covered) > 30 * n) and not (r.base_failed and r.kept)
    good = [got[r.doc_id].kept for r in labels.where("quality = 1").collect() if not got[r.doc_id].base_failed]
    assert sum(good) >= 0.95 * len(good)
    assert rules.judged(nothing, labels).count() == 0
    assert rules.learn(rules.statistics(docs), labels.limit(0)) == []


def test_rules_run_without_python(docs, spark):
    plan = rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(docs, rows, nothing):
    model = language.train(docs.where("doc_id % 4 != 2"), PIECES, sample=100)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [(lang, got[d].lang_pred) for d, t, lang, *_ in rows if d % 4 == 2 and d < 9000]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    for d in (9001, 9002, 9003, 9012):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    untrained = language.train(nothing, PIECES)
    assert {r.lang_pred for r in language.identify(docs, untrained).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bc", "c"]
    lattice = language.Lattice(pieces)
    prob = np.append(np.random.default_rng(0).random(len(pieces)), language.FLOOR)[:, None]

    def total(text):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                out += prob[pieces.index(text[:k]), 0] * total(text[k:])
            elif k == 1:
                out += language.FLOOR * total(text[1:])
        return out

    for word in ("a", "ab", "abc", "xab", "abab"):
        assert math.isclose(language.word_scores([word], lattice, prob)[0, 0], math.log(total("▁" + word)), rel_tol=1e-9)
        assert math.isclose(language.long_score("▁" + word, lattice, prob)[0], math.log(total("▁" + word)), rel_tol=1e-9)


def test_long_words_are_scored_whole(monkeypatch):
    pieces = language.vocabulary(PIECES)
    assert max(map(len, pieces)) > 12
    lattice = language.Lattice(pieces)
    prob = np.random.default_rng(1).random((len(pieces) + 1, 2)) / len(pieces)
    prob[-1] = language.FLOOR
    words_ = ["internationalisation" * 2, "abcxyz" * 10, "中文" * 20]
    along = language.word_scores(words_, lattice, prob)
    blocks = [np.concatenate(list(lattice.ending("▁" + w, 7))) for w in words_]
    assert all((b == next(lattice.ending("▁" + w))).all() for b, w in zip(blocks, words_))
    monkeypatch.setattr(language, "TOGETHER", 100)
    assert np.allclose(along, language.word_scores(words_, lattice, prob))
    assert np.isfinite(language.long_score("x" * 20_000, lattice, prob)).all()


def test_accepted_rows(docs, rows, spark):
    model = language.train(docs, PIECES, sample=100)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter((d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or ""))
    english = next(t for d, t, lang, *_ in rows if lang == "en" and len(t) > 500)
    odd = spark.createDataFrame([(None, english, "fr", 1), (None, "1234", "en", 2), (7, english, None, 3), (7, "...", None, 4), (7, None, None, 5)], "doc_id long, text string, lang string, found int")
    assert sorted((r.found, r.lang) for r in language.accepted(odd, model).collect()) == [(1, "en"), (3, "en")]


def brute_spans(rows, run, least):
    first: dict[bytes, tuple] = {}
    parsed = {}
    for d, t, *_ in rows:
        parts = spans.sentences(t or "")
        assert "".join(parts) == (t or "")
        w = [p.split() for p in parts]
        ranges = [(i, i + run) for i in range(len(parts) - run + 1)] if len(parts) >= run else ([(0, len(parts))] if parts else [])
        own = [(i, j, " ".join(x for s in w[i:j] for x in s)) for i, j in ranges if sum(map(len, w[i:j])) >= least]
        parsed[d] = (parts, own)
        for i, _, s in own:
            first[s] = min(first.get(s, (d, i)), (d, i))
    out = {}
    for d, (parts, own) in parsed.items():
        gone = [False] * len(parts)
        for i, j, s in own:
            if first[s] != (d, i):
                for k in range(i, j):
                    gone[k] = True
        out[d] = "".join(p for p, g in zip(parts, gone) if not g)
    return out


def test_spans(docs, rows):
    got = spans.without_repeated_spans(docs).collect()
    want = brute_spans(rows, 3, 16)
    assert len(got) == len(rows)
    for r in got:
        assert (r.text or "") == want[r.doc_id]
    kept = {r.doc_id: r.text for r in got}
    assert kept[9008] == PASSAGE and kept[9009] == "Start here. End there." and kept[9010] == ""
    assert kept[9001] is None
    taken = docs.withColumn("_hits", F.lit(5)).withColumn("_removed", F.lit(6)).withColumn("_key", F.lit(7))
    again = spans.without_repeated_spans(taken)
    assert again.columns == [*taken.columns, "_sentences", "__removed"]
    assert again.where("_hits = 5 and _removed = 6 and _key = 7").count() == len(rows)


def test_spans_nothing(nothing):
    assert spans.without_repeated_spans(nothing).count() == 0


def shared_runs(a, b):
    return {h for *_, h in spans.hashed(a, None, 16)[1]} & {h for *_, h in spans.hashed(b, None, 16)[1]}


@pytest.mark.parametrize("marks", [[""], ["", "", "", "", "", "", "", "", "", "."], ["", "", ","], ["", "", "", "", "\n"], ["", "", "", "", "", "", ",", "", "", "", "", "", "", "!"]])
def test_passages_of_51_words_share_a_run(marks):
    rng = np.random.default_rng(len(marks))
    for n in range(400):
        vocabulary = 5 if n % 4 == 0 else 400
        text = lambda k: " ".join(f"w{w}{marks[m]}" for w, m in zip(rng.integers(vocabulary, size=k), rng.integers(len(marks), size=k)))
        passage = text(51)
        a, b = (f"{text(rng.integers(40))} {passage} {text(rng.integers(40))}" for _ in range(2))
        assert "".join(spans.short_parts(a)) == a
        assert shared_runs(a, b), (a, b)


def test_spans_grow(spark, rows):
    lines = "".join(f"line {k} has five words\n" for k in range(12))
    single = " ".join(f"word{k * 7919 % 1000}" for k in range(60))
    texts = {1: lines, 2: "Other start.\n" + lines + "Other end.", 3: single, 4: f"before {single} after", 5: " \n " + "few words. " * 3, 6: f"Head of it. {single} and {PASSAGE} Tail."}
    got = {r.doc_id: r for r in spans.without_repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), run=None).collect()}
    assert [got[k].text for k in (1, 3, 5)] == [texts[k] for k in (1, 3, 5)]
    assert got[2].text == "Other start.\nOther end."
    assert got[4].text.startswith("before ") and got[4].text.endswith("after") and len(got[4].text.split()) < 40
    assert got[6].text.startswith("Head of it. ") and got[6].text.endswith(PASSAGE + " Tail.") and got[6]._removed > 0


def test_grown_runs_find_all_that_fixed_runs_find(rows):
    seen = {True: set(), False: set()}
    for d, t, *_ in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        gone = {}
        for grown in (True, False):
            parts, (n, runs) = spans.short_parts(t) if grown else spans.sentences(t), spans.hashed(t, None if grown else 3, 16)
            assert n == len(parts)
            ends, marked = np.cumsum([0, *map(len, parts)]), np.zeros(len(t), dtype=bool)
            for i, j, h in runs:
                if h in seen[grown]:
                    marked[ends[i] : ends[j]] = True
                seen[grown].add(h)
            gone[grown] = marked
        assert not (gone[False] & ~gone[True]).any(), d


def test_tables_go_to_the_named_folder(spark):
    df = common.written(spark.range(5), "t")
    assert df.inputFiles()[0].replace("///", "/").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir").replace("///", "/"))
    common.discard(df)
    with pytest.raises(Exception):
        df.collect()


def test_ids_may_be_null(spark):
    df = spark.createDataFrame([(None, PASSAGE), (None, None), (3, PASSAGE)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(-1, -1), (-1, -1), (3, -1)]
    assert packing.pack(df, TOKENIZER).count() == 3
    large = spark.createDataFrame([(None, "a"), (2**53 + 1, "b")], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in packing.pack(large, TOKENIZER).collect()) == [-1, 2**53 + 1]
    assert suffixes.deduplicated(df).agg(F.sum("n_removed")).first()[0] == len(PASSAGE)
    full = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert mixing.mix(full, {}).count() == 3
    assert isinstance(full.schema, T.StructType)


def test_language_fit_holds_only_spans_that_are_there():
    pieces = sorted({"▁", *"abcdefgh", *("a" * k for k in range(1, 16))})
    rng = np.random.default_rng(0)
    many = Counter({"a" * 15: 1} | {"".join(rng.choice(list("abcdefgh"), 15)): 1 for _ in range(20_000)})
    lattice = language.Lattice(pieces)
    tracemalloc.start()
    names, prob = language.fit({"x": many}, lattice, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["x"] and abs(prob[:-1].sum() - 1) < 1e-9
    assert peak < 15e6


def test_suffixes_drop_each_table_before_the_next_shuffle(docs, monkeypatch):
    there, held, written = {}, {}, suffixes.written

    def watched(df, tag):
        held[tag] = sorted(there)
        there[tag] = out = written(df, tag)
        return out

    def discarded(df):
        there.pop(next(tag for tag, other in there.items() if other is df))
        common.discard(df)

    monkeypatch.setattr(suffixes, "written", watched)
    monkeypatch.setattr(suffixes, "discard", discarded)
    suffixes.deduplicated(docs).count()
    assert held["hits"] == ["answered", "contexts"] and held["removed"] == ["hits"]
    assert sorted(there) == ["removed"]


def test_suffixes_send_on_what_is_shared_alone(spark, monkeypatch):
    rng, rows, passed, written = np.random.default_rng(8), [], {}, suffixes.written
    own = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    for d in range(200):
        rows.append((d, own(700) + (PASSAGE if d % 20 == 0 else "")))
    rows += [(1000 + 50 * k + d, rows[d][1]) for k in range(3) for d in range(20)]  # copies, with and without the passage
    rows += [(3, rows[3][1]), (1003, rows[3][1]), (1003, own(60)), (1004, own(30)), (7, rows[150][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def watched(table, tag):
        out = written(table, tag)
        passed[tag] = out.count()
        return out

    monkeypatch.setattr(suffixes, "written", watched)
    suffixes.removed_spans(df, anchor_bits=64)
    every = len(suffixes.anchored([t.encode() for _, t in rows], 50)[0])
    assert 0 < passed["contexts"] < every / 4
    assert removed(suffixes.deduplicated(df)) == brute_removed(rows)


def test_bitmaps_have_room_and_come_in_pieces(spark, monkeypatch):
    assert suffixes.room(10, 1 << 25) == 1 << 25 and suffixes.room(1 << 40, 64) == 1 << 30
    assert all(4 * n < suffixes.room(n, 64) <= max(64, 8 * n) for n in (1, 100, 33_000_000))
    df = spark.range(-5_000, 5_000).select((F.col("id") * 7_919).alias("v"))
    whole = suffixes.bitmap(df, "v", 1 << 16)
    values = np.arange(-5_000, 5_000) * 7_919
    assert suffixes.in_bitmap(whole, values).all() and int(np.unpackbits(whole.view(np.uint8)).sum()) == len(set((values % (1 << 16)).tolist()))
    monkeypatch.setattr(suffixes, "PIECE", 100)
    assert (suffixes.bitmap(df, "v", 1 << 16) == whole).all()


def test_graph_links_back_in_batches(monkeypatch):
    calls, spread = [], embeddings.Graph._spread
    monkeypatch.setattr(embeddings.Graph, "_spread", lambda self, nodes, *more: calls.append(len(nodes)) or spread(self, nodes, *more))
    rng = np.random.default_rng(2)
    x = unit(rng, 3000)
    x[2000:] = x[:1000] + 0.02 * rng.normal(size=(1000, 16))
    x[2900:] = x[0] + 0.02 * rng.normal(size=(100, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(3000)]
    graph = embeddings.Graph(x)
    assert len(calls) < 100 < sum(calls)
    for level in graph.levels:  # what a node has stands first, each once, and is no link to itself
        there = level >= 0
        assert (there[:, 1:] <= there[:, :-1]).all() and not (level == np.arange(len(level))[:, None]).any()
        assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in level)
    monkeypatch.setattr(embeddings, "PAIRS", 700 * 3001)
    a, b = embeddings.linked(graph, x, x, 0.95, 64)
    true = x @ x.T >= 0.95
    assert true[a, b].all() and len(set(zip(a.tolist(), b.tolist()))) == len(a) >= 0.98 * true.sum()


def test_shards_are_few_and_have_tasks_of_their_own(spark, monkeypatch):
    rng, built, written = np.random.default_rng(3), [], embeddings.written

    def watched(table, tag):
        out = written(table.withColumn("task", F.spark_partition_id()) if tag == "vector-graphs" else table, tag)
        if tag == "vector-graphs":
            built.extend(out.select("shard", "task").collect())
        return out.drop("task")

    monkeypatch.setattr(embeddings, "written", watched)
    monkeypatch.setattr(embeddings, "ASKED", 40)
    x = np.vstack([unit(rng, 900, 32), np.repeat(unit(rng, 1, 32), 100, 0) + 0.01 * rng.normal(size=(100, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert len(built) == len({r.shard for r in built}) == len({r.task for r in built}) == 4
    assert got == {i: (99, 900) if i >= 900 else (0, i) for i in range(1000)}


def test_every_node_of_a_graph_is_reached():
    rng = np.random.default_rng(11)
    x = np.vstack([unit(rng, 900, 32), np.repeat(unit(rng, 1, 32), 100, 0) + rng.normal(size=(100, 32)) * 0.012])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(1000)]
    graph = embeddings.Graph(x)
    level = graph.levels[0]
    for node in (700, 998):  # as if every link back to it had been dropped
        rest = np.where(level == node, -1, level)
        level[:] = np.take_along_axis(rest, np.argsort(rest < 0, axis=1, kind="stable"), 1)
    assert len(graph.levels) == 2 and not np.isin(embeddings.linked(graph, x, x, 0.95, 64)[1], [700, 998]).any()
    graph._reach(len(graph.levels[1]))
    a, b = embeddings.linked(graph, x, x, 0.95, 64)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.95))))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority over the XXH64 of a text's word shingles. Fingerprints within
``radius`` (3) bits are linked. Emitting the whole ball of half the radius, rounded up, costs 2081 variants a
fingerprint. Instead the 64 bits are cut into four blocks: of two fingerprints that differ in one to
three bits, some block holds a difference, and with that block masked they differ in two bits at
most, so their balls of radius one (half the radius) share a variant. That is 196 variants a
fingerprint on 48 free bits, so chance collisions stay rare at any size. Variants are shuffled, and
colliding pairs verified on all 64 bits; a bucket emits a spanning forest of its links, never all
pairs. Equal fingerprints are one node throughout.

``near_copies`` finds texts by the similarity of their shingle sets instead. It takes a fingerprint of 576
bits, cut into eighteen words: each word emits its ball of radius one (half of two bits), 594 variants a
text, so two texts meet where any of their words differ in two bits at most. Of 0.8 similar texts nine in ten
meet, of 0.9 similar ones all but one in a thousand; a copy with several near ones has as many chances. A variant carries
32 bits of the fingerprint, by which pairs are chosen; they are verified on their shingle sets. First each text is verified with the
two that it meets most; then all pairs that meet and lie in different components, so that every link between them is found.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .common import LONG, components, discard, documents, free_name, release, schema, written

BLOCKS = 4
WORDS = 18  # of the wide fingerprint, 32 bits each
SURE = 2  # differing bits of the sketch's 32, at about 0.9 similar: in a large bucket such a text needs no other link
LEADERS = 4096
ALL_PAIRS = 4  # texts of a bucket up to which all its near pairs are tried first
BINARY = T.BinaryType()
BLOCK = 4096  # texts of a bucket that are verified in one group
SMALL = 48  # buckets up to this size are compared as matrices, larger ones by a search


def fingerprint(text: str, shingle: int) -> int:
    """The text's 64-bit SimHash; zero if it has no word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return documents(docs).mapInPandas(run, schema(("doc_id", LONG), ("fp", LONG)))


def variants(fp: np.ndarray) -> np.ndarray:
    """(len(fp), 196): for each masked block, the rest of the fingerprint with none or one bit flipped."""
    width, parts = 64 // BLOCKS, []
    for b in range(BLOCKS):
        mask = np.uint64(((1 << width) - 1) << (b * width))
        tag = np.uint64((0x5A5A + b) << (b * width))
        flips = np.array([0, *(1 << i for i in range(64) if i // width != b)], dtype=np.uint64)
        parts.append(((fp & ~mask) | tag)[:, None] ^ flips[None, :])
    return np.concatenate(parts, axis=1)


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of a large bucket."""
    left, a, b = x, [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for f in front[:256]:
                near |= np.bitwise_count(left ^ f) <= radius
            found, left = left[near], left[~near]
            a.append(found)
            b.append(np.full(len(found), root))
            front = np.concatenate([front[256:], found])
    return np.concatenate(a or [x[:0]]), np.concatenate(b or [x[:0]])


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted ``key``; every component of a bucket is one star."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    for s in np.unique(size[size > 1]):
        rows = start[size == s]
        if s > SMALL:
            for r in rows:
                ends = _forest(fp[r : r + s], radius)
                a.append(ends[0])
                b.append(ends[1])
            continue
        for at in range(0, len(rows), max(1, 1_000_000 // int(s * s))):
            x = fp[rows[at : at + max(1, 1_000_000 // int(s * s)), None] + np.arange(s)]
            near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= radius
            label = np.broadcast_to(np.arange(s), x.shape)
            while True:
                then = np.where(near, label[:, None, :], s).min(axis=2)
                if (then == label).all():
                    break
                label = then
            i, j = np.nonzero(label != np.arange(s))
            a.append(x[i, j])
            b.append(x[i, label[i, j]])
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links that connect exactly the distinct fingerprints ``fp`` within ``radius`` bits."""
    if radius > 3:
        raise ValueError("one masked block covers a radius of 3 at most")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                fp = batch["fp"].to_numpy()[at : at + 1000]
                keys = variants(fp.view(np.uint64))
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "fp": np.repeat(fp, keys.shape[1])})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield pairs(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield pairs(key, fp)

    def pairs(key, fp):
        a, b = bucket_links(key, fp, radius)
        both = np.unique(np.column_stack([a, b]), axis=0)
        return pd.DataFrame({"a": both[:, 0].view(np.int64).copy(), "b": both[:, 1].view(np.int64).copy()})

    balls = distinct.select("fp").mapInPandas(emit, schema(("key", LONG), ("fp", LONG)))
    return balls.repartition("key").sortWithinPartitions("key").mapInPandas(meet, schema(("a", LONG), ("b", LONG)))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included), a row for each row of ``docs``.

    Null or wordless texts have fingerprint zero, linked like any other; a text of fewer words than a
    shingle is one shingle; ASCII letters are lower-cased, other characters kept. A null doc_id reads
    as -1; rows with equal ids share a component only if their fingerprints do.
    """
    fps = written(fingerprints(docs, shingle), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending; a shorter text is one shingle, one without words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        out = _mixed(out + each[k : k + n])
    return np.unique(out)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """576 bits as nine 64-bit words: the majority over nine mixings of each hash."""
    ones = np.zeros(32 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        z, parts = hashes[at : at + 4096], []
        for _ in range(WORDS // 2):
            z = _mixed(z)
            parts.append(z ^ (z >> np.uint64(31)))
        bits = np.unpackbits(np.stack(parts, axis=1).astype("<u8").view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


PRINT = [f"f{k}" for k in range(WORDS // 2)]
PRINTED = schema(("doc_id", LONG), ("text_hash", LONG), ("node", LONG), *((f, LONG) for f in PRINT))
NODES = schema(("key", LONG), ("node", LONG), ("sketch", T.IntegerType()))
LINKS = schema(("a", LONG), ("b", LONG))


def _printed(docs: DataFrame, shingle: int) -> DataFrame:
    """A row for each row: ``node`` is a hash of the text's words, equal for texts that differ in blanks or case alone."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in batch["text"]]
            node = np.array([xxhash.xxh3_64_intdigest(t) for t in own], np.uint64)
            fp = np.array([wide_fingerprint(shingle_hashes(t, shingle)) for t in batch["text"]], np.uint64).reshape(-1, len(PRINT))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "node": node.view(np.int64), **{f: fp[:, k].view(np.int64) for k, f in enumerate(PRINT)}})

    return documents(docs).withColumn("text_hash", F.xxhash64("text")).mapInPandas(run, PRINTED)


def wide_variants(fp: np.ndarray) -> np.ndarray:
    """(len(fp), 594) keys: each 32-bit word of the fingerprint with none or one bit flipped, and its place."""
    word = np.ascontiguousarray(fp).view("<u4").astype(np.uint64) | (np.arange(WORDS, dtype=np.uint64) << np.uint64(32))
    flips = np.array([0, *(1 << i for i in range(32))], np.uint64)
    return (word[:, :, None] ^ flips).reshape(len(fp), -1)


class _Bucket:
    """Pairs of one bucket to try first: of a small one all near pairs, else each text with the nearest before it.

    Of a large bucket, texts all but equal to one before are not kept for later ones. ``across`` finds the pairs left out.
    """

    def __init__(self, bits: int):
        self.bits, self.node, self.sketch = bits, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, node: np.ndarray, sketch: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [], []
        if len(self.node) + len(node) <= ALL_PAIRS:
            n, f = np.concatenate([self.node, node]), np.concatenate([self.sketch, sketch])
            i, j = np.nonzero(np.tril(np.bitwise_count(f[:, None] ^ f[None]) <= self.bits, -1))
            new = i >= len(self.node)
            self.node, self.sketch = n, f
            return [n[i[new]]], [n[j[new]]]
        for lo in range(0, len(node), 256):
            n, f = node[lo : lo + 256], sketch[lo : lo + 256]
            best, where = np.full(len(n), 999), np.zeros(len(n), np.int64)
            for at in range(0, len(self.node), 8192):
                apart = np.bitwise_count(f[:, None] ^ self.sketch[None, at : at + 8192])
                near = apart.argmin(axis=1)
                d = apart[np.arange(len(n)), near]
                where = np.where(d < best, self.node[near + at], where)
                best = np.minimum(best, d)
            apart = np.bitwise_count(f[:, None] ^ f[None]).astype(np.int64)
            apart[np.triu_indices(len(n))] = 999
            near = apart.argmin(axis=1)
            d = apart[np.arange(len(n)), near]
            where, best = np.where(d < best, n[near], where), np.minimum(best, d)
            hit = best <= self.bits
            a.append(n[hit])
            b.append(where[hit])
            leads = (best > SURE) | (len(self.node) < LEADERS)
            self.node, self.sketch = np.concatenate([self.node, n[leads]]), np.concatenate([self.sketch, f[leads]])
        return a, b


@contextlib.contextmanager
def _long_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of a few numbers reach Python 10,000 at a time; what the session had, for texts, is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key``, cut between buckets only."""
    held = []
    for batch in batches:
        key = batch["key"].to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1]["key"].iloc[-1] != key[-1]):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _of_size(key: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of buckets of two or more, a line for each bucket: those of one size together where they are small, large ones alone."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    for s in np.unique(size[size > 1]).tolist():
        first = start[size == s]
        step = 1 if s > SMALL else max(1, 1_000_000 // (s * s))
        for at in range(0, len(first), step):
            yield first[at : at + step, None] + np.arange(s)


def meetings(nodes: DataFrame, bits: int) -> DataFrame:
    """key, node, sketch: texts that share the variant ``key`` with one whose sketch differs in ``bits`` or fewer (of large buckets, all texts)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                fp = part[PRINT].to_numpy().view(np.uint64)
                keys = wide_variants(fp)
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(), keys.shape[1]), "sketch": np.repeat(part[PRINT[0]].to_numpy().astype(np.int32), keys.shape[1])})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            sketch, met = rows["sketch"].to_numpy().view(np.uint32), np.zeros(len(rows), bool)
            for at in _of_size(rows["key"].to_numpy()):
                if at.shape[1] > SMALL:
                    met[at] = True
                    continue
                for k in range(1, at.shape[1]):  # each with the k-th after it
                    near = np.bitwise_count(sketch[at[:, k:]] ^ sketch[at[:, :-k]]) <= bits
                    met[at[:, k:][near]] = True
                    met[at[:, :-k][near]] = True
            yield rows[met]

    balls = nodes.select("node", *PRINT).mapInPandas(emit, NODES)
    return balls.repartition("key").sortWithinPartitions("key").mapInPandas(meet, NODES)


def candidates(met: DataFrame, bits: int, each: int = 2) -> DataFrame:
    """a, b: for each text b, the ``each`` texts before it that it meets as its nearest in most buckets. ``across`` finds the other pairs."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            node, sketch, a, b = rows["node"].to_numpy(), rows["sketch"].to_numpy().view(np.uint32), [], []
            for at in _of_size(rows["key"].to_numpy()):
                if at.shape[1] <= ALL_PAIRS:
                    for i, j in itertools.combinations(range(at.shape[1]), 2):
                        near = np.bitwise_count(sketch[at[:, i]] ^ sketch[at[:, j]]) <= bits
                        a.append(node[at[near, i]])
                        b.append(node[at[near, j]])
                else:
                    for bucket in at:
                        y, x = _Bucket(bits).add(node[bucket], sketch[bucket])
                        a += x
                        b += y
            both = pd.DataFrame({"a": np.concatenate(a or [node[:0]]), "b": np.concatenate(b or [node[:0]])})
            yield both.groupby(["a", "b"], as_index=False).size().rename(columns={"size": "n"})

    pairs = met.repartition("key").sortWithinPartitions("key", "node").mapInPandas(nearest, schema(("a", LONG), ("b", LONG), ("n", LONG)))
    most = F.sort_array(F.collect_list(F.struct("n", "a")), asc=False)
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("b").agg(F.slice(most, 1, each).alias("_to")).select(F.explode("_to.a").alias("a"), "b")


def first_variant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One of the variants that each pair of fingerprints shares, the same for (y, x): in the first word that differs in two bits at most."""
    u, v = (np.ascontiguousarray(f).view("<u4").reshape(len(f), WORDS) for f in (x, y))
    place = (np.bitwise_count(u ^ v) <= 2).argmax(axis=1)
    u, v = u[np.arange(len(u)), place], v[np.arange(len(v)), place]
    low = (u ^ v) & (~(u ^ v) + np.uint32(1))
    return (np.minimum(u ^ low, v ^ low).astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32))).view(np.int64)


class _Texts:
    """Rows of buckets: key, node, label, n, odd and the fingerprint."""

    def __init__(self, rows: pd.DataFrame, bits: int, least: float):
        self.key, self.node, self.label, self.n = (rows[c].to_numpy() for c in ("variant" if "variant" in rows else "key", "node", "label", "n"))
        self.fp = np.ascontiguousarray(rows[PRINT].to_numpy()).view(np.uint64)
        self.sketch = rows[PRINT[0]].to_numpy().astype(np.int32).view(np.uint32)
        self.odd = np.frombuffer(b"".join(rows["odd"]), np.uint64).reshape(len(rows), -1)
        self.bits, self.least = bits, least

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j of a bucket, near by their sketches, are a pair to verify here: in one bucket of all that they share."""
        out = np.zeros(len(i), bool)
        for lo in range(0, len(i), 100_000):
            x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
            apart = np.maximum(np.bitwise_count(self.odd[x] ^ self.odd[y]).sum(axis=1, dtype=np.int64), np.abs(self.n[x] - self.n[y]))
            ok = np.flatnonzero(apart <= (self.n[x] + self.n[y]) * (1 - self.least) / (1 + self.least) + 1e-6)
            out[lo + ok[first_variant(self.fp[x[ok]], self.fp[y[ok]]) == self.key[x[ok]]]] = True
        return out


def across(met: DataFrame, about: DataFrame, bits: int, least: float) -> DataFrame:
    """group, variant, node: the texts that have a text of another component to be verified with in a bucket, once a bucket; a group is a bucket's.

    ``about``: node, label (its component), n (how many shingles), odd (``_odd`` of them), the fingerprint. ``odd`` tells at least how many shingles two texts don't share:
    a pair that it shows to be below ``least`` is no pair, so nothing similar is lost. Each pair counts in one bucket of those that
    it shares. No pairs leave a task, but the texts of them: ``verified`` pairs them again. A bucket of over ``BLOCK`` texts goes as a group for each two of its blocks
    that have a pair, so that a task never holds more than two blocks.
    """
    fields = schema(("key", LONG), ("node", LONG), ("label", LONG), ("n", LONG), ("odd", BINARY), *((f, LONG) for f in PRINT))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.explode("key", ignore_index=True).astype({"key": np.int64})[fields.names]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            t = _Texts(rows, bits, least)
            groups, members = [t.key[:0]], [np.zeros(0, np.int64)]
            for at in _of_size(t.key):
                at = at[t.label[at].min(axis=1) != t.label[at].max(axis=1)]
                if at.shape[1] <= SMALL:
                    near = (np.bitwise_count(t.sketch[at][:, :, None] ^ t.sketch[at][:, None, :]) <= bits) & (t.label[at][:, :, None] < t.label[at][:, None, :])
                    k, i, j = np.nonzero(near)
                    x, y = at[k, i], at[k, j]
                    ok = t.may(x, y)
                    members.append(np.unique(np.concatenate([x[ok], y[ok]])))
                    groups.append(t.key[members[-1]])
                    continue
                for bucket in at:  # one
                    bucket = bucket[np.argsort(t.label[bucket], kind="stable")]
                    blocks = [bucket[lo : lo + BLOCK] for lo in range(0, len(bucket), BLOCK)]
                    for k, (p, q) in enumerate(itertools.combinations_with_replacement(blocks, 2)):
                        found = np.zeros(len(rows), bool)
                        for lo in range(0, len(p), 256):
                            part = p[lo : lo + 256]
                            others = q[np.searchsorted(t.label[q], t.label[part[0]], "right") :]  # what follows the component of the first
                            near = np.bitwise_count(t.sketch[part, None] ^ t.sketch[None, others]) <= bits
                            i, j = np.nonzero(near & (t.label[part, None] < t.label[None, others]))
                            ok = t.may(part[i], others[j])
                            found[part[i[ok]]] = found[others[j[ok]]] = True
                        members.append(np.flatnonzero(found))
                        group = t.key[p[0]] if not k else _mixed(np.array([t.key[p[0]] + k]).view(np.uint64)).view(np.int64)[0]
                        groups.append(np.full(len(members[-1]), group))
            of = np.concatenate(members)
            yield pd.DataFrame({"key": np.concatenate(groups), "variant": t.key[of], "node": t.node[of]})

    texts = met.groupBy("node").agg(F.collect_list("key").alias("key"))  # a row for each text: at most 594 keys
    rows = texts.join(about, "node").select("key", "node", "label", "n", "odd", *PRINT).mapInPandas(spread, fields)
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(compare, schema(("key", LONG), ("variant", LONG), ("node", LONG)))


def verified(groups: DataFrame, about: DataFrame, bits: int, least: float) -> DataFrame:
    """a, b: similar texts that connect exactly the components that similar texts of ``across``'s ``groups`` connect: a forest for each group.

    ``about`` has the ``shingles``, too. A pair that a group's links connect already is not verified.
    """

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            t = _Texts(rows, bits, least)
            sets, ends = [np.frombuffer(x, np.uint64) for x in rows["shingles"]], []
            root, key = np.unique(t.label, return_inverse=True)[1], rows["key"].to_numpy()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(start, np.r_[start[1:], len(key)]):
                for i in range(lo, hi - 1):
                    j = np.arange(i + 1, hi)
                    j = j[(t.key[j] == t.key[i]) & (root[j] != root[i]) & (np.bitwise_count(t.sketch[j] ^ t.sketch[i]) <= bits)]
                    j = j[t.may(np.full(len(j), i), j)]
                    while len(j):
                        if alike(sets[i], sets[j[0]], least):
                            ends.append((t.node[i], t.node[j[0]]))
                            own = root[lo:hi]
                            own[own == root[j[0]]] = root[i]
                            j = j[root[j] != root[i]]
                        else:
                            j = j[1:]
            yield pd.DataFrame(ends, columns=LINKS.names, dtype=np.int64)

    rows = groups.join(about, "node").select("key", "variant", "node", "label", "n", "odd", *PRINT, "shingles")
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(forest, LINKS)


def _odd(hashes: np.ndarray) -> bytes:
    """1,024 bits, each set if an odd number of the hashes falls on it: those of two sets differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).tobytes()


def _hash_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (ascending 64-bit hashes), n (how many), odd (``_odd`` of them) of the texts ``wanted`` (node, doc_id, text_hash)."""

    @F.pandas_udf(BINARY)
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).tobytes() for t in texts])

    @F.pandas_udf(BINARY)
    def odd(sets: pd.Series) -> pd.Series:
        return pd.Series([_odd(np.frombuffer(x, np.uint64)) for x in sets])

    texts = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return texts.join(wanted, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]).select("node", hashes("text").alias("shingles")).select("node", "shingles", (F.octet_length("shingles") / 8).cast("long").alias("n"), odd("shingles").alias("odd"))


def alike(u: np.ndarray, v: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both > 0 and both >= least * (len(u) + len(v) - both)


def similar(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose ``shingles`` have a Jaccard similarity of ``least`` or more."""

    @F.pandas_udf("boolean")
    def checked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), least) for u, v in zip(x, y)], dtype=bool)

    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(n)) for k, n in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(checked("x", "y")).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 11) -> DataFrame:
    """doc_id, text_hash, component: a row for each row; ``component`` is equal for texts linked by similar ones.

    Texts are similar if their sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` or more, or
    if their words are the same in the same order, ASCII case and blanks aside; so all texts without a word,
    null ones too, are copies of each other. A text of fewer words is one shingle. Long texts are taken whole. A
    null doc_id reads as -1; ids may repeat. Only doc_id and text are read. An empty table gives an empty one.
    ``bits``: how many of the sketch's 32 may differ for a pair to be verified (0.8 similar texts differ in five on average, others in 16).
    """
    printed = written(_printed(docs, shingle), "simhash-wide")
    nodes = written(printed.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), *(F.min(f).alias(f) for f in PRINT)), "simhash-nodes")
    with _long_batches(docs.sparkSession):
        met = written(meetings(nodes, bits), "simhash-met")
        release(docs.sparkSession)
        pairs = written(candidates(met, bits), "simhash-pairs")
    sets = written(_hash_sets(docs, nodes.join(met.select("node").distinct(), "node").select("node", "least.*"), shingle), "simhash-sets")
    first = written(components(similar(sets, pairs, least)), "simhash-first")
    # what the nearest have not linked: every other pair that meets, unless its texts are in one component already
    prints = nodes.select("node", *PRINT)
    about = sets.join(prints, "node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "n", "odd", *PRINT, "shingles")
    with _long_batches(docs.sparkSession):
        groups = written(across(met, about.drop("shingles"), bits, least), "simhash-across")
        release(docs.sparkSession)
    rest = written(verified(groups, about, bits, least), "simhash-rest")
    united = components(rest.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    for done in (met, pairs, sets, groups, rest, first):
        discard(done)
    return printed.join(united, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def deduplicated(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of ``near_copies``: that of the smallest doc_id, all columns kept.

    Rows that are equal in id and text are copies too: one of them stays. Rows with a null id come first (as -1).
    Columns of ``docs`` may have any names.
    """
    found = written(near_copies(docs, shingle, least), "near-copies")
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.sum("n").alias("all"))
    first = first.where(F.col("all") > 1)
    gone = rows.join(first, "component").select("doc_id", "text_hash", "n", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"))
    gone = written(gone.where("not stays or n > 1"), "near-copies-gone")
    key, hashed = free_name(docs, "key"), free_name(docs, "hash")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed), "stays")
    single = keyed.join(named, [key, hashed], "left_anti")
    equal = keyed.join(named.where("stays").select(key, hashed), [key, hashed], "left_semi").dropDuplicates([key, hashed])
    return single.unionByName(equal).select(*docs.columns)

"""Exact substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` (50) bytes covers it that also starts in a document with a smaller
id. The corpus has no suffix array of its own; its work is cut so that strings that can be equal meet:

Of rows with the same text only the one with the smallest id is compared with others: the later ones lose every byte
(texts are told apart by 128 bits of hashes).

1. Every window of 50 bytes belongs to an anchor, the least-hashed 24-byte string in it (leftmost), so
   equal windows have equal anchors at equal places. One aggregation finds anchors of several documents.
2. For these, runs of windows with one anchor are contexts of at most 76 bytes. Anchors that have one context
   everywhere are done: all its windows share their smallest document (contexts are told apart by a 64-bit hash).
3. Of the others, equal contexts are one, with the smallest document. Each is split in two: windows with 13 bytes
   or more before the anchor, which must agree on these and the anchor, and the rest, which must agree
   on the anchor and 13 bytes after it. Those that agree meet in a shard. A shard's text gets its suffixes
   sorted and transformed, and breadth-first backward extension sets common prefixes by increasing value,
   level by level: a neighbour pair is set once a pair between the two suffixes behind it is. Levels double: the
   extension, taken with itself, goes as many bytes on as are known (1, 2, 3, 6, 12, 24, 25, 50). It stops at 50;
   the neighbours not set share 50 bytes. Each group of equal windows learns its smallest document.
   Parts that agree in more contexts than a task should hold (a passage in very many documents, each time
   with something else beside it) are taken window by window, in an aggregation that Spark combines map-side.
4. Occurrences meet their context's answer, and each document its spans.

Bitmaps only spare work: they drop anchors and documents that surely have no match. They have four to eight bits for
each value, so that they spare as much of any input, up to 128 MB; from there on less, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, discard, documents, release, schema, written

GRAM = 24
ANCHOR = 40  # bits kept of an anchor's hash: anchors that share one are compared like one anchor with several contexts
PLACE = 20  # bits for a place within a buffer
BUFFER = (1 << PLACE) - 4096
SHARD_BYTES = 1_500_000
PIECE = 1 << 22  # words of a bitmap that come to the driver together
MOST_BITS = 1 << 30  # a bitmap of 128 MB, for a quarter of a thousand million values
TOGETHER = 20_000  # contexts that agree on a part are compared in one task up to this number
BINARY = T.BinaryType()


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def words_at(raw: bytes, more: int = 0) -> np.ndarray:
    """The eight bytes from each place on, as numbers, zeros after the end; ``more`` places beyond it."""
    n, raw = len(raw), raw + bytes(more + 8)
    words = np.empty(n + more, dtype=np.uint64)
    for o in range(min(8, len(words))):
        at = words[o::8]
        at[:] = np.frombuffer(raw, dtype="<u8", count=len(at), offset=o)
    return words


def hashed(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes (signed) of the bytes from ``first`` to ``end`` (8 or more each), by steps of MurmurHash3 over ``words_at``."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    size = end - first
    h = size.astype(np.uint64)
    for o in range(0, int(size.max(initial=0)), 8):  # past its end each takes its last eight again
        k = words[np.minimum(first + o, end - 8)] * np.uint64(0x87C37B91114253D5)
        h ^= turned(k, 31) * np.uint64(0x4CF5AD432745937F)
        h = turned(h, 27) * np.uint64(5) + np.uint64(0x52DCE729)
    for by, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(by)
        h *= np.uint64(factor)
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def anchored(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, over the joined ``parts``: part, first and last window start, anchor's hash and start."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none
    words = words_at(b"".join(parts), 24)
    z = (words[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ ((words[8 : n + 8] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F))
    z ^= z >> np.uint64(31)
    z += words[16 : n + 16]
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0x94D049BB133111EB)
    low = np.uint64((1 << PLACE) - 1)
    least = _sliding((z & ~low) | np.arange(n, dtype=np.uint64), length - GRAM + 1)
    own = (least[: n - length + 1] & low).astype(np.int64)
    valid = np.zeros(n - length + 1, dtype=bool)
    for a, size in zip(starts[:-1], sizes):
        valid[a : max(a, a + size - length + 1)] = True
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none.astype(np.uint64), none
    own = own[s]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[first[1:], len(s)] - 1
    return np.searchsorted(starts, s[first], side="right") - 1, s[first], s[last], z[own[first]] >> np.uint64(64 - ANCHOR), own[first]


def _buffers(batch: pd.DataFrame, length: int):
    """(rows, offsets in their texts, parts) of at most BUFFER bytes; longer texts are cut with overlap."""
    rows, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(batch["text"]):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - length + 1), BUFFER - length):
            part = data[at : at + BUFFER - 1]
            if size + len(part) > BUFFER:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def room(values: int, least: int) -> int:
    """Bits of a bitmap of so many values: ``least`` or a power of two, four to eight for each, at most ``MOST_BITS``."""
    return max(least, min(MOST_BITS, 1 << (4 * values).bit_length()))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set for each value modulo ``bits`` (a multiple of 64), as ``bits / 64`` words, which come in pieces of 64 MB."""
    words = df.select(F.expr(f"pmod({column}, {bits}L) div 64").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for at in range(0, len(out), PIECE):
        piece = words.where(F.col("w").between(at, at + PIECE - 1)) if len(out) > PIECE else words
        for batch in piece.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
            out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values: signed."""
    at = values % (64 * len(words))
    return (words[at // 64] >> (values % 64)) & 1 > 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes (cyclic), sorted by their first 64 bytes or more.

    A number holds a key and, in its lower bits, the start it belongs to: numbers sort several times as fast as an index does.
    """
    n = len(text)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    if 3 * int(bits) > 64:
        raise ValueError("a shard's text must be shorter than two million bytes")
    start, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
    first = (64 - int(bits)) // 8
    wide = np.concatenate([text, np.resize(text, first)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(first):
        key = (key << np.uint64(8)) | wide[k : k + n]
    order, step = None, first
    while True:
        key = (key << bits) | start
        key.sort()
        order = (key & mask).astype(np.int64)
        key >>= bits
        apart = np.r_[False, key[1:] != key[:-1]]
        if step >= 64 or apart.sum() == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(apart)
        key = (rank << bits) | np.concatenate([rank[step % n :], rank[: step % n]])
        step *= 2


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, flags): flag k false where suffix k shares ``length`` bytes or more with the one before."""
    n = len(text)
    order = suffix_order(text)
    bwt = text[order - 1]  # the byte before each suffix
    back = np.argsort(bwt, kind="stable").astype(np.int32)  # the k-th suffix, less its first byte, is the back[k]-th
    firsts = text[order]
    apart = np.r_[True, firsts[1:] != firsts[:-1]]  # common prefix 0
    live = np.flatnonzero(~apart)
    upto = np.empty(n, np.int32)

    def extended(ahead: np.ndarray) -> None:
        nonlocal live
        np.cumsum(apart, out=upto)
        reached = upto.take(ahead.take(live)) > upto.take(ahead.take(live - 1))
        apart[live[reached]] = True
        live = live[~reached]

    # apart tells common prefixes below upto_now; the k-th suffix, less its first upto_now bytes, is the ahead[k]-th
    ahead, upto_now = back, 1
    for bit in bin(length)[3:]:  # the level doubles, and grows by one where the length has a bit
        if not len(live):
            break
        extended(ahead)
        upto_now *= 2
        if upto_now == length:
            break
        ahead = ahead.take(ahead)
        if bit == "1":
            extended(back)
            upto_now += 1
            if upto_now < length:
                ahead = ahead.take(back)
    return order, apart


def smallest_documents(contexts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each context, the smallest document with an equal window in any of them."""
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order, apart = equal_prefixes(text, length)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    window = np.arange(len(text)) - starts[owner] <= (sizes - length)[owner]
    doc = np.where(window, docs[owner], np.iinfo(np.int64).max)
    first = np.flatnonzero(apart)
    least = np.minimum.reduceat(doc[order], first)
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[first, len(text)]))
    return [out[a : a + size - length + 1] for a, size in zip(starts, sizes)]


CONTEXTS = schema(
    ("anchor", LONG), ("key", LONG), ("context", BINARY), ("place", T.IntegerType()), ("doc_id", LONG), ("text_hash", LONG), ("start", LONG), ("windows", T.IntegerType())
)
SIDES = schema(("side", LONG), ("anchor", LONG), ("key", LONG), ("at", T.IntegerType()), ("part", BINARY), ("least", LONG), ("most", LONG))
ANSWERS = schema(("anchor", LONG), ("key", LONG), ("first", LONG), ("last", LONG), ("least", LONG))


def _digest(part: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(part)


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def sides(context: bytes, place: int, length: int) -> list[tuple[bytes, int, bytes]]:
    """(what its windows agree on, first window, bytes) of the context's windows with much before the anchor, and of the rest.

    ``place``: where the anchor starts. A window has ``length - GRAM`` bytes around it, so half of them on one side.
    """
    half, last = (length - GRAM) // 2, len(context) - length
    out = []
    if place >= half:
        out.append((b"<" + context[place - half : place + GRAM], 0, context[: min(last, place - half) + length]))
    if last > place - half:
        at = max(0, place - half + 1)
        out.append((b">" + context[place : place + GRAM + half], at, context[at:]))
    return out


def removed_spans(docs: DataFrame, length: int = 50, anchor_bits: int = 1 << 25, together: int = TOGETHER) -> DataFrame:
    """doc_id, text_hash, spans: arrays of (from, to) bytes to remove, unmerged, of documents that have any."""
    if not GRAM < length <= 64:
        raise ValueError("windows must be longer than an anchor and at most 64 bytes")
    spark = docs.sparkSession
    texts = documents(docs).where(F.octet_length("text") >= length).withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "text_hash"))
    rows = texts.select("doc_id", "text_hash", F.xxhash64(F.lit(1), "text").alias("other_hash"), F.octet_length("text").cast("long").alias("b"))
    firsts = rows.groupBy("text_hash", "other_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    later = rows.join(firsts.where("first < last"), ["text_hash", "other_hash"]).where("doc_id > first").select("doc_id", "text_hash", F.lit(0).cast("long").alias("a"), "b")
    first_bits = spark.sparkContext.broadcast(bitmap(firsts.select(F.xxhash64("first", "text_hash").alias("row")), "row", room(docs.count(), 1 << 23)))
    release(spark)

    def first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Without rows that are surely not the first of their text; one in some is let through, with the same result."""
        for batch in batches:
            yield batch[in_bitmap(first_bits.value, batch["row"].to_numpy())]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in first_rows(batches):
            for _, _, parts in _buffers(batch, length):
                part, _, _, anchor, _ = anchored(parts, length)
                _, once = np.unique(anchor + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                yield pd.DataFrame({"anchor": anchor.view(np.int64)[once]})  # each once a text

    def sent_bits(values: DataFrame) -> Broadcast:
        (column,) = values.columns
        return spark.sparkContext.broadcast(bitmap(values, column, room(values.count(), anchor_bits)))

    shared = texts.select("row", "text").mapInPandas(find, schema(("anchor", LONG))).groupBy("anchor").count().where("count > 1")
    shared = written(shared.select("anchor"), "shared-anchors")
    release(spark)
    sent = sent_bits(shared)
    discard(shared)
    release(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = sent.value, set()
        for batch in first_rows(batches):
            ids, hashes = batch["doc_id"].to_numpy(), batch["text_hash"].to_numpy()
            for rows, offsets, parts in _buffers(batch, length):
                part, first, last, anchor, own = anchored(parts, length)
                anchor = anchor.view(np.int64)
                keep = np.flatnonzero(in_bitmap(words, anchor))
                if not len(keep):
                    continue
                raw = b"".join(parts)
                base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                begin, end = first[keep], last[keep] + length
                row, of = np.array(rows, np.int64)[part[keep]], part[keep]
                keys = hashed(words_at(raw), begin, end)
                if len(seen) > 1_000_000:
                    seen.clear()
                # a task's later ones go without bytes
                once = [None if k in seen or seen.add(k) else raw[a:b] for k, a, b in zip(keys.tolist(), begin.tolist(), end.tolist())]
                yield pd.DataFrame(
                    {
                        "anchor": anchor[keep],
                        "key": keys,
                        "context": pd.Series(once, dtype=object),
                        "place": (own[keep] - first[keep]).astype(np.int32),
                        "doc_id": ids[row],
                        "text_hash": hashes[row],
                        "start": first[keep] - base[of] + np.array(offsets, np.int64)[of],
                        "windows": (last[keep] - first[keep] + 1).astype(np.int32),
                    }
                )

    contexts = written(texts.select("doc_id", "text_hash", "row", "text").mapInPandas(cut, CONTEXTS), "contexts")
    kinds = contexts.groupBy("anchor").agg(
        F.min("key").alias("key"), F.max("key").alias("other"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    kinds = written(kinds.where("least < most").select("anchor", "key", "other", "least"), "anchors")
    release(spark)
    mixed_bits = sent_bits(kinds.where("key != other").select("anchor"))

    @F.pandas_udf("boolean")
    def maybe_mixed(anchors: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(mixed_bits.value, anchors.to_numpy()))

    mixed = contexts.where(maybe_mixed("anchor")).groupBy("anchor", "key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("context", ignorenulls=True).alias("context"), F.first("place").alias("place")
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (_digest(agreed), anchor, key, at, part, least, most)
                for anchor, key, context, place, least, most in zip(*(batch[c] for c in ("anchor", "key", "context", "place", "least", "most")))
                for agreed, at, part in sides(context, place, length)
            ]
            out = pd.DataFrame(rows, columns=SIDES.names)
            yield out.assign(side=_signed([r[0] for r in rows]))

    halves = written(mixed.mapInPandas(split, SIDES), "sides")
    release(spark)
    met = halves.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("a"), F.max("least").alias("b"))
    met = written(met.where("n > 1 and a < b").select("side", "n"), "met-sides")
    many = met.where(F.col("n") > together).select("side")
    met_bits = sent_bits(met.where(F.col("n") <= together).select("side"))

    @F.pandas_udf("boolean")
    def maybe_met(values: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(met_bits.value, values.to_numpy()))

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch) * (length + 20)
            if size > SHARD_BYTES:
                every = pd.concat(held, ignore_index=True)
                side = every["side"].to_numpy()
                end = int(np.searchsorted(side, side[-1]))  # the last one may go on
                if end:
                    yield from answers(every.iloc[:end])
                held, size = [every.iloc[end:]], (len(every) - end) * (length + 20)
        if held:
            yield from answers(pd.concat(held, ignore_index=True))

    def answers(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        side = own["side"].to_numpy()
        start = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(side) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(side)])
        own = own[np.repeat(size > 1, size)]  # the others are here by a bit of the bitmap alone
        side = own["side"].to_numpy()
        most = SHARD_BYTES // (length + 20)
        lo = 0
        while lo < len(own):
            hi = len(own) if len(own) - lo <= most else max(int(np.searchsorted(side, side[lo + most])), int(np.searchsorted(side, side[lo], "right")))
            yield compared(own.iloc[lo:hi])
            lo = hi

    def compared(own: pd.DataFrame) -> pd.DataFrame:
        anchor, key, at = (own[c].to_numpy() for c in ("anchor", "key", "at"))
        each = smallest_documents(own["part"].tolist(), own["least"].to_numpy(), length)
        flat, size = np.concatenate(each), np.array([len(e) for e in each])
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        owner = np.repeat(np.arange(len(own)), size)
        first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(flat)] - 1
        of = owner[first]
        less = flat[first] < own["least"].to_numpy()[of]  # the others' smallest document is their context's own
        first, last, of = first[less], last[less], of[less]
        shift = at[of] - base[of]
        return pd.DataFrame({"anchor": anchor[of], "key": key[of], "first": first + shift, "last": last + shift, "least": flat[first]})

    dealt = halves.where(maybe_met("side")).join(many, "side", "left_anti").repartition("side").sortWithinPartitions("side")
    found_mixed = written(dealt.mapInPandas(shard, ANSWERS), "answers")
    release(spark)
    tables = [contexts, kinds, halves, met, found_mixed]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                rows = [
                    (anchor, key, at + i, least, text[i : i + length])
                    for anchor, key, at, text, least in zip(part["anchor"], part["key"], part["at"], part["part"], part["least"])
                    for i in range(len(text) - length + 1)
                ]
                yield pd.DataFrame(rows, columns=["anchor", "key", "first", "own", "window"])

    if not many.isEmpty():
        single = halves.join(many, "side", "left_semi").mapInPandas(windows, schema(("anchor", LONG), ("key", LONG), ("first", LONG), ("own", LONG), ("window", BINARY)))
        single = written(single, "single-windows")
        tables.append(single)
        smallest = single.groupBy("window").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        by_window = single.join(smallest, "window").where("least < own").select("anchor", "key", "first", F.col("first").alias("last"), "least")
        found_mixed = found_mixed.unionByName(by_window)

    # each step leaves a table of its own, so that what it read can go before the next one shuffles
    # of the documents of one context, the later ones lose it whole; each context has one part that begins where it does
    same = halves.where("at = 0 and least < most").select("anchor", "key", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), "least")
    uniform = kinds.where("key = other").select("anchor", "key", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), "least")
    answered = written(found_mixed.unionByName(same).unionByName(uniform), "answered")
    for done in tables[1:]:
        discard(done)
    release(spark)
    answer_bits = sent_bits(answered.select("key"))

    @F.pandas_udf("boolean")
    def maybe_answered(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(answer_bits.value, keys.to_numpy()))

    asking = contexts.where(maybe_answered("key")).select("anchor", "key", "doc_id", "text_hash", "start", "windows")
    hits = asking.join(answered, ["anchor", "key"]).where("least < doc_id")
    to = F.col("start") + F.when(F.col("last") < 0, F.col("windows") - 1).otherwise(F.col("last")) + length
    hits = hits.select("doc_id", "text_hash", (F.col("start") + F.col("first")).alias("a"), to.alias("b"))
    hits = written(hits.unionByName(later), "hits")
    for done in (contexts, answered):
        discard(done)
    release(spark)
    spans = written(hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "removed")
    discard(hits)
    release(spark)
    return spans


CUT = T.StructType(
    [T.StructField("doc_id", LONG), T.StructField("n_bytes", LONG), T.StructField("n_removed", LONG), T.StructField("n_spans", LONG), T.StructField("kept", BINARY)]
)


def deduplicated(docs: DataFrame, length: int = 50, document_bits: int = 1 << 23) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left): a row for each row of ``docs``.

    Texts are judged as UTF-8 bytes on the input; null text is empty; matches never cross documents.
    Rows with equal doc_id do not remove from each other. A null doc_id reads as -1.
    """
    spans = removed_spans(docs, length)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "text_hash", room(spans.count(), document_bits)))
    texts = documents(docs).withColumn("text_hash", F.xxhash64("text"))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, hashes.to_numpy()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, firsts, lasts in zip(batch["doc_id"].tolist(), batch["text"], batch["a"], batch["b"]):
                data = text.encode("utf-8", "surrogatepass")
                a, b = np.sort(np.asarray(firsts, np.int64)), np.sort(np.asarray(lasts, np.int64))
                # sorted separately, as many begin before a gap as end before it
                gap = np.flatnonzero(a[1:] > b[:-1])
                a, b = a[np.r_[0, gap + 1]], b[np.r_[gap, len(b) - 1]]
                kept = b"".join(data[u:v] for u, v in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                rows.append((doc, len(data), int((b - a).sum()), len(a), kept))
            yield pd.DataFrame(rows, columns=CUT.names)

    flagged = texts.withColumn("maybe", maybe("text_hash"))
    met = flagged.where("maybe").join(spans, ["doc_id", "text_hash"], "left")
    changed = met.where("spans is not null").select("doc_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b")).mapInPandas(cut, CUT)
    whole = flagged.where("not maybe").select("doc_id", "text").unionByName(met.where("spans is null").select("doc_id", "text"))
    zero = F.lit(0).cast("long")
    return changed.unionByName(
        whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    )

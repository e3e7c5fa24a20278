"""Best-fit packing by non-negative least squares over length patterns.

Every document is tokenised (its ids, then id 0) and cut into pieces of at most ``max_len`` ids. Only
the histogram of piece lengths, bounded by ``max_len`` rows, reaches the driver. There few-document
patterns that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by
non-negative least squares, rounded, and what remains is packed best-fit-decreasing, count by count.
The plan (how often each pattern repeats) goes back to the pieces: the n-th piece of a length takes
the n-th slot of that length. Ranks within a length are made from salted groups, so a length that
holds a third of all pieces is spread over tasks.

Null text is empty text: one piece with the closing id alone. Repeated rows are packed once each; an
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, schema, written

WS = r" \t-\r\u0085\u00a0"
# fixed values: the pre-tokenizer pattern of the public vocabulary file, for characters up to U+024F
PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+)[{WS}]*"
#: Texts with these go to the tokenizer itself: characters that normalisation may change, special tokens.
ODD = r"[^\u0000-\u024f]|\u0130|<\|"
CACHE_WORDS = 300_000

PIECES = schema(("doc_id", LONG), ("piece", LONG), ("start", LONG), ("length", LONG), ("ids_crc32", LONG))


def _word_encoder(path: str):
    """A byte-pair encoder over single words with the tokenizer's ids.

    Words end in a blank, standing for the vocabulary's end-of-word mark; no word holds a blank, so the
    byte is free. A task builds its own: held by Python workers, which outlive tasks, each would take 60 MB.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {}
    for token, i in vocab.items():
        if token.startswith("<|") and token.endswith("|>"):
            continue
        end = len(token) > 4 and token.endswith("</w>")
        ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b" " * end] = i
    return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 of every document of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = text.rlike(ODD)
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), f"^[{WS}]+", ""), PIECE, "$1 ")
    prepared = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.when(~odd, plain).alias("plain"), F.when(odd, text).alias("odd")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        words, tokenizer = _word_encoder(tokenizer_path), None
        close = int(closing_id).to_bytes(4, "little")
        cache: dict[str, bytes] = {}
        for batch in batches:
            out = []
            for doc, plain, odd in zip(batch["doc_id"].tolist(), batch["plain"].tolist(), batch["odd"].tolist()):
                if plain is not None:
                    parts = plain.split(" ")
                    parts.pop()
                    new = [w for w in set(parts) if w not in cache]
                    if len(cache) + len(new) > CACHE_WORDS:
                        cache.clear()
                        new = set(parts)
                    for w in new:
                        cache[w] = np.asarray(words.encode_ordinary(w + " "), dtype="<u4").tobytes()
                    ids = b"".join(map(cache.__getitem__, parts)) + close
                else:
                    tokenizer = tokenizer or Tokenizer.from_file(tokenizer_path)
                    ids = np.asarray(tokenizer.encode(odd, add_special_tokens=False).ids, dtype="<u4").tobytes() + close
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=PIECES.names)

    return prepared.mapInPandas(cut, PIECES)


def patterns(max_len: int, longest: int) -> np.ndarray:
    """Every set of one to three lengths, none above ``longest``, that fills ``max_len`` exactly; 0 pads."""
    found = [(max_len, 0, 0)] if longest >= max_len else []
    found += [(a, max_len - a, 0) for a in range((max_len + 1) // 2, min(longest, max_len - 1) + 1)]
    parts = [np.array(found, dtype=np.int64).reshape(-1, 3)]
    for a in range(-(-max_len // 3), min(longest, max_len - 2) + 1):
        b = np.arange(-(-(max_len - a) // 2), min(a, max_len - a - 1) + 1)
        parts.append(np.column_stack([np.full(len(b), a), b, max_len - a - b]))
    return np.concatenate(parts)


def fitted(hist: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts >= 0 that bring the patterns' lengths closest to ``hist`` (projected accelerated gradient).

    Residuals of short lengths weigh less: what is left of them fills gaps later.
    """
    n = len(hist)
    weight = 0.1 + 0.9 * np.minimum(1, np.arange(n) / (n / 4))
    weight[0] = 0

    def times(x):
        return sum(np.bincount(pats[:, k], x, n) for k in range(3)) * weight

    def back(r):
        r = r * weight
        return r[pats[:, 0]] + r[pats[:, 1]] + r[pats[:, 2]]

    v = np.ones(len(pats))
    for _ in range(12):
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    target = hist * weight
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - back(times(y) - target) / max(1.02 * top, 1e-12))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / u * (z - x)
        x, t = z, u
    return x


def pack_histogram(hist: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, largest first; how many such sequences) that hold exactly ``hist``."""
    left = np.asarray(hist, dtype=np.int64).copy()
    left[0] = 0
    packed: list[tuple[tuple[int, ...], int]] = []
    if not left.any():
        return packed
    pats = patterns(max_len, int(np.flatnonzero(left).max()))
    pats = pats[((left[pats] > 0) | (pats == 0)).all(axis=1)]
    if len(pats):
        x = fitted(left, pats)
        # rounding carries its error on, so that many small counts keep their sum
        counts = np.diff(np.floor(np.concatenate([[0], np.cumsum(x)]) + 0.5)).astype(np.int64)
        for k in np.flatnonzero(counts):
            lengths = [int(v) for v in pats[k] if v]
            need: dict[int, int] = {}
            for v in lengths:
                need[v] = need.get(v, 0) + 1
            times = min(int(counts[k]), *(int(left[v]) // m for v, m in need.items()))
            if times > 0:
                for v, m in need.items():
                    left[v] -= times * m
                packed.append((tuple(lengths), times))
    # best fit decreasing over the rest; sequences with equal room are handled together
    room: list[list] = [[] for _ in range(max_len + 1)]
    open_at = np.zeros(max_len + 1, dtype=bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(open_at[length:])
            if not len(fits):
                each = max_len // length
                for times, size in ((count // each, each), (1 if count % each else 0, count % each)):
                    if times:
                        room[max_len - size * length].append([(length,) * size, times])
                        open_at[max_len - size * length] = True
                break
            r = length + int(fits[0])
            lengths, times = room[r].pop()
            used = min(times, count)
            if times > used:
                room[r].append([lengths, times - used])
            open_at[r] = bool(room[r])
            room[r - length].append([(*lengths, length), used])
            open_at[r - length] = True
            count -= used
    packed += [(lengths, times) for each in room for lengths, times in each]
    return packed


def slots(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """A row for each length of each pattern: which ranks of that length it takes, and where they go."""
    rows, sequence, taken = [], 0, {}
    for lengths, times in packed:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            m = lengths.count(length)
            rank = taken.get(length, 0)
            rows.append((length, rank, m, sequence, at))
            taken[length] = rank + m * times
            at += m * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "at"]).sort_values(["length", "rank"])


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, closing_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    spark = docs.sparkSession
    pieces = written(tokenised(docs, tokenizer_path, max_len, closing_id), "pieces")
    hist = np.zeros(max_len + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most max_len rows
        hist[length] = n
    plan = slots(pack_histogram(hist, max_len))

    # groups of a length: none larger than a quarter of a task's share
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(256, int(hist.sum()) // (4 * spread))
    salts = -(-hist // most)
    salt_of = spark.createDataFrame(
        [(int(i), int(n)) for i, n in enumerate(salts) if n], "length long, salts long"
    )
    salted = pieces.join(F.broadcast(salt_of), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    )
    first: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    for length, salt, n in sorted(map(tuple, salted.groupBy("length", "salt").count().collect())):  # at most max_len + 4 * spread rows
        first[length, salt] = before.get(length, 0)
        before[length] = before.get(length, 0) + n
    ranked = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    by_length = {k: tuple(g[c].to_numpy() for c in ("rank", "each", "sequence", "at")) for k, g in plan.groupby("length")}
    sent = spark.sparkContext.broadcast((first, by_length))  # bounded by max_len and the number of patterns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, by_length = sent.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy().astype(np.int64)
            rank = rank + np.fromiter((first[k] for k in zip(length.tolist(), batch["salt"].tolist())), np.int64, len(batch))
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for v in np.unique(length):
                rows = np.flatnonzero(length == v)
                start, each, base, at = by_length[int(v)]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                past = rank[rows] - start[k]
                sequence[rows] = base[k] + past // each[k]
                offset[rows] = at[k] + past % each[k] * v
            yield batch[PIECES.names].assign(sequence_id=sequence, offset=offset)

    return ranked.select(*PIECES.names, "salt", "rank").mapInPandas(
        place, schema(*((f.name, f.dataType) for f in PIECES), ("sequence_id", LONG), ("offset", LONG))
    )

"""Substring dedup on sliding sentence spans.

Runs of consecutive sentences are hashed, the hashes joined globally, and sentences covered by a
repeated span that is not the span's first occurrence are removed. First means the smallest doc_id,
and the earliest place within it. A run is a fixed number of sentences, or it grows until it holds
enough words; then every passage of more than 50 words that stands in two places holds a run that
both places hash, wherever it begins and whatever stands around it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, discard, documents, free_name, release, schema, written

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)\s*")
CLAUSE = re.compile(r"[^,;:]*(?:[,;:]+|$)\s*")
LONG_WORDS = 24  # a sentence of more words is cut at its commas, semicolons and colons
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Grown runs: a sentence, then a clause, of more than PIECE words is cut; of WINDOW words in a row within a clause, one starts
#: a part. A passage of P words has a boundary both its places share by its word max(PIECE, 2 * WINDOW - 2), from there on one in
#: every max(PIECE, WINDOW) words, and places differ again within PIECE words of its end at most (within WINDOW - 1 if cut). With
#: 16 words a run, P = 51 is enough: 3 * PIECE <= P - 16 + 1 and 4 * WINDOW <= P - 16 + 3.
PIECE, WINDOW = 12, 9


def sentences(text: str) -> list[str]:
    """Parts of the text, each up to its end mark or line break and the blanks after it; joined, they are the text."""
    out = []
    for part in SENTENCE.findall(text):
        if len(part) > 2 * LONG_WORDS and len(part.split()) > LONG_WORDS:
            out += [c for c in CLAUSE.findall(part) if c]
        elif part:
            out.append(part)
    return out


def span_hashes(parts: list[str], run: int, min_words: int) -> list[tuple[int, int, int]]:
    """(first sentence, one past the last, 128-bit hash, of which 96 bits are compared) of every run; a shorter text is one run."""
    import xxhash

    words = [s.encode("utf-8", "surrogatepass").split() for s in parts]
    if len(parts) < run:
        runs = [(0, len(parts))] if parts else []
    else:
        runs = [(i, i + run) for i in range(len(parts) - run + 1)]
    flat = [b" ".join(w) for w in words]
    count = [len(w) for w in words]
    return [
        (i, j, xxhash.xxh3_128_intdigest(b" ".join(flat[i:j])))
        for i, j in runs
        if sum(count[i:j]) >= min_words
    ]


def _content_cuts(words: list[bytes]) -> list[int]:
    """Of each WINDOW words the last one with the smallest hash, but the first word: far from the ends, only words around decide."""
    hashes = list(map(zlib.crc32, words))
    out, least, at = [], -1, -1
    for k in range(WINDOW - 1, len(hashes)):
        h = hashes[k]
        if at <= k - WINDOW:
            part = hashes[k - WINDOW + 1 : k + 1]
            least = min(part)
            at = k - part[::-1].index(least)
        elif h <= least:
            least, at = h, k
        else:
            continue
        if at:
            out.append(at)
    return out


def _parts(text: str, whole: bool) -> tuple[list[str], list[list[bytes]]]:
    """Sentences, those of more than PIECE words cut at their commas and, where a clause is as long, by its words: their texts (if ``whole``) and words."""
    texts, words = [], []
    for part in SENTENCE.findall(text):
        if not part:
            continue
        own = part.encode("utf-8", "surrogatepass").split()
        if len(own) <= PIECE:
            texts.append(part)
            words.append(own)
            continue
        for piece in CLAUSE.findall(part):
            if not piece:
                continue
            own = piece.encode("utf-8", "surrogatepass").split()
            cuts = _content_cuts(own) if len(own) > PIECE else []
            ends = [0, *cuts, len(own)]
            words += [own[a:b] for a, b in zip(ends, ends[1:])] if cuts else [own]
            if whole:
                at = [m.start() for m in WORD.finditer(piece)] if cuts else []
                ends = [0, *(at[k] for k in cuts), len(piece)]
                texts += [piece[a:b] for a, b in zip(ends, ends[1:])]
    return texts, words


def short_parts(text: str) -> list[str]:
    """The parts that grown runs are made of; joined, they are the text."""
    return _parts(text, True)[0]


def grown_hashes(words: list[list[bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """As ``span_hashes``, of the shortest runs of ``min_words`` words or more from each part on, and up to each part.

    Those that end with a part cover the last parts of a passage, which no run that starts there fits in.
    """
    import xxhash

    digest = xxhash.xxh3_128_intdigest
    at = [k for k, w in enumerate(words) if w]  # blanks alone neither start nor end a run
    flat = [b" ".join(words[k]) for k in at]
    total = [0, *itertools.accumulate(len(words[k]) for k in at)]
    runs, i = set(), 0
    for j in range(1, len(total)):
        enough = total[j] - min_words
        if enough < 0:
            continue
        while total[i] <= enough:  # no earlier end leaves enough words after this start
            runs.add((i, j))
            i += 1
        runs.add((i - 1, j))  # and no later start leaves enough before this end
    return [(at[i], at[j - 1] + 1, digest(b" ".join(flat[i:j]))) for i, j in sorted(runs)]


def hashed(text: str, run: int | None, min_words: int) -> tuple[int, list[tuple[int, int, int]]]:
    """How many parts the text has, and their runs: of ``run`` sentences each, or grown."""
    if run is None:
        words = _parts(text, False)[1]
        return len(words), grown_hashes(words, min_words)
    parts = sentences(text)
    return len(parts), span_hashes(parts, run, min_words)


def _halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    low = np.array([v & (1 << 64) - 1 for v in values], dtype=np.uint64).view(np.int64)
    return low, np.array([v >> 64 & (1 << 32) - 1 for v in values], dtype=np.uint32).view(np.int32)


def repeated_spans(docs: DataFrame, run: int | None, min_words: int) -> tuple[DataFrame, DataFrame]:
    """h1, h2, doc_id of spans that also occur in a document with a smaller doc_id; and the table of all spans, to discard after."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                own = {h for _, _, h in hashed(text, run, min_words)[1]}
                ids += [doc] * len(own)
                hashes += own
                if len(ids) > 100_000:
                    h1, h2 = _halves(hashes)
                    yield pd.DataFrame({"h1": h1, "h2": h2, "doc_id": np.array(ids, np.int64)})
                    ids, hashes = [], []
            h1, h2 = _halves(hashes)
            yield pd.DataFrame({"h1": h1, "h2": h2, "doc_id": np.array(ids, np.int64)})

    spans = written(documents(docs).mapInPandas(emit, schema(("h1", LONG), ("h2", T.IntegerType()), ("doc_id", LONG))), "span-hashes")
    first = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1").select("h1", "h2", "first"), "spans")
    release(docs.sparkSession)
    return spans.join(first, ["h1", "h2"]).where("doc_id > first").select("h1", "h2", "doc_id"), spans


def without_repeated_spans(docs: DataFrame, run: int | None = 3, min_words: int = 16) -> DataFrame:
    """``docs`` with its texts cut, plus ``_sentences`` and ``_removed`` (how many there were and went).

    Blanks within a span do not count. Spans of fewer than ``min_words`` words are not hashed: a
    run of ``run`` sentences that is shorter is left out, and where ``run`` is None runs grow until they
    hold as many. A null text stays null; a text that loses all sentences is empty. Rows with equal doc_id are one
    document: they do not repeat each other. Texts are cut whole, however long. An empty table gives an empty one.
    All other columns are kept, whatever their names: an added one that is taken gets underscores before it.
    """
    hits, spans = repeated_spans(docs, run, min_words)
    hits = hits.groupBy("doc_id").agg(F.collect_set("h1").alias("_hits"))
    hits = written(hits, "span-hits")
    discard(spans)
    release(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")  # so that no name of theirs meets one of ours
    joined = docs.select(row, key.alias("_key"), F.col("text").alias("_text")).join(hits.withColumnRenamed("doc_id", "_key"), "_key", "left")
    text_type = T.StructType([T.StructField("text", STRING), T.StructField("_sentences", LONG), T.StructField("_removed", LONG)])

    @F.pandas_udf(text_type)
    def cut(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, hit in zip(texts, hits):
            if text is None:
                rows.append((None, 0, 0))
                continue
            n, runs = hashed(text, run, min_words)
            gone = np.zeros(n, dtype=bool)
            found = set() if hit is None else set(hit.tolist())
            seen: set[int] = set()
            for i, j, h in runs:
                low = h & (1 << 64) - 1
                if h in seen or (low - (1 << 64) if low >> 63 else low) in found:
                    gone[i:j] = True
                seen.add(h)
            kept = text
            if gone.any():
                kept = "".join(p for p, g in zip(short_parts(text) if run is None else sentences(text), gone) if not g)
            rows.append((kept, n, int(gone.sum())))
        return pd.DataFrame(rows, columns=["text", "_sentences", "_removed"])

    done = joined.select("row", cut("_text", "_hits").alias("_cut"))
    return done.select(
        *(F.col("_cut.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names),
        F.col("_cut._sentences").alias(free_name(docs, "_sentences")), F.col("_cut._removed").alias(free_name(docs, "_removed")),
    )

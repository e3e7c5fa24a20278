"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators are scaled by the log ratio of their rates in the two classes, and a linear
hinge-loss model is fitted on them by dual coordinate descent. N-grams are words, word shapes (runs
of letters, digits and marks) and pairs of these; an n-gram of shapes also has an indicator for each
share of the text it passes, so that one mark in a text and marks on every word differ.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, documents, hash_sample, schema

BITS = 18
SHARES = (1 / 64, 1 / 16, 1 / 4)
CACHE_WORDS = 400_000
_RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.DOTALL)


def shape(word: str) -> int:
    """A 32-bit code of the word's pattern: case of letter runs, digits, marks."""

    def run(m: re.Match) -> str:
        s = m[0]
        if s.isdigit():
            return "0"
        if s.isalpha():
            return "A" if len(s) > 1 and s.isupper() else "a"
        return s[:2]

    return zlib.crc32(_RUNS.sub(run, word)[:12].encode("utf-8", "surrogatepass"))


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    x = (a.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def features(text: str, cache: dict[str, tuple[int, int]]) -> np.ndarray:
    """Sorted distinct indicator numbers of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(1, dtype=np.int32)
    new = {w for w in words if w not in cache}
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = (shape(w), zlib.crc32(w.lower().encode("utf-8", "surrogatepass")))
    codes = np.array([cache[w] for w in words], dtype=np.uint64)
    shapes, terms = codes[:, 0], codes[:, 1]
    same = terms[1:] == terms[:-1]
    pair = shapes[1:] * np.uint64(31) + shapes[:-1] + same.astype(np.uint64) * np.uint64(977)
    found = [_mix(np.unique(terms), 1)]
    for salt, grams in ((2, shapes), (3, pair)):
        if not len(grams):
            continue
        kinds, counts = np.unique(grams, return_counts=True)
        found.append(_mix(kinds, salt))
        found += [_mix(kinds[counts > s * n], 10 * salt + k) for k, s in enumerate(SHARES)]
    if len(words) > 1:
        repeats = float(same.mean())
        found.append(_mix(np.arange(1, 1 + sum(repeats > s for s in SHARES)), 5))
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    varied = len(np.unique(terms)) / n
    found.append(_mix(np.arange(1, 1 + sum(again > s for s in SHARES)), 6))
    found.append(_mix(np.arange(1, 1 + int(8 * varied)), 7))
    found.append(_mix(np.arange(1, 1 + int(np.log2(n))), 8))
    return np.unique(np.concatenate(found)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, float, float, float]:
    """weights, bias, and slope and shift that turn a margin into the probability of label 1."""
    size = 1 << BITS
    y = np.where(labels > 0, 1.0, -1.0)
    rate = []
    for side in (1, -1):
        own = [r for r, v in zip(rows, y) if v == side]
        count = np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size)
        rate.append((count + 1.0) / (len(own) + 2.0))
    ratio = np.log(rate[0] / rate[1])
    w, bias = np.zeros(size), 0.0
    values = [ratio[r] / np.sqrt(max(1e-9, (ratio[r] ** 2).sum())) for r in rows]
    dual = np.zeros(len(rows))
    # the rarer class weighs as much as the other
    most = {s: cost * len(y) / max(1, 2 * (y == s).sum()) for s in (1.0, -1.0)}
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            then = min(max(dual[i] - slope / 2.0, 0.0), most[y[i]])  # rows have norm 1, the bias adds 1
            if then != dual[i]:
                w[rows[i]] += (then - dual[i]) * y[i] * values[i]
                bias += (then - dual[i]) * y[i]
                dual[i] = then
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, values)])
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    for _ in range(200):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        g = p - target
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return w * ratio, bias, a, b


ROWS = T.StructType([T.StructField("quality", LONG), T.StructField("grams", T.ArrayType(T.IntegerType()))])


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> tuple:
    """A model from about ``sample`` hash-chosen labelled documents of each class (all, where a class has fewer).

    ``labels``: doc_id, quality. Only ``text`` feeds the model. Rows without a label are left out.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("long"))
    chosen = hash_sample(known.dropDuplicates(["doc_id"]), "doc_id", "quality", sample)
    picked = documents(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "grams": [features(t, cache) for t in batch["text"]]})

    rows = picked.mapInPandas(run, ROWS).toPandas()  # the bounded sample
    if not len(rows):
        return np.zeros(1 << BITS), 0.0, 1.0, 0.0, np.zeros(1 << BITS)
    order = np.lexsort([[zlib.crc32(np.asarray(g).tobytes()) for g in rows["grams"]]])
    grams = [np.asarray(rows["grams"].iloc[i]) for i in order]
    labels_ = rows["quality"].to_numpy()[order]
    weights, bias, a, b = fit(grams, labels_)
    return weights, bias, a, b, _ratio(grams, labels_)


def _ratio(rows, labels) -> np.ndarray:
    size, rate = 1 << BITS, []
    for side in (True, False):
        own = [r for r, v in zip(rows, labels > 0) if v == side]
        count = np.bincount(np.concatenate(own), minlength=size) if own else np.zeros(size)
        rate.append((count + 1.0) / (len(own) + 2.0))
    return np.log(rate[0] / rate[1])


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) for each row of ``docs``; null text is empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) if isinstance(x, np.ndarray) else float(x) for x in model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, a, b, ratio = sent.value
        cache: dict = {}
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch["text"]):
                grams = features(text, cache)
                margin = weights[grams].sum(dtype=float) / np.sqrt(max(1e-9, float((ratio[grams].astype(float) ** 2).sum()))) + bias
                out[k] = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": out})

    return documents(docs).mapInPandas(run, schema(("doc_id", LONG), ("score", DOUBLE)))

"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts each word from the four before it: their vectors, each weighted by a vector of its
place, add up to a state, and an item's score is the state's product with the item's own vector, plus a
bias. Items are the end mark, the words of the vocabulary and ``ENDINGS`` groups of all other words by
their last two bytes. The vocabulary grows with the corpus: all words that occur at least
``sqrt(tokens) / RARITY`` times. Items are cut into classes, the commonest into small ones, so that two matrix
products give normalised log-probabilities: of the classes, and of the items in the class. Words of a group share its
probability by their counts plus 0.1, as does one place for all words of it that training never met.

Training is a few rounds, each over a part of the training documents. In a round every task trains a copy
of the weights on its share, telling data from noise (noise-contrastive estimation); Spark averages the
copies row by row, weighted by how often each row was trained. Counts cover all training words. The
commonest are sent to all tasks; the others meet their counts in a join, as (document, word, times).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, STRING, documents, schema, written

PLACES, WIDTH = 4, 32  # words a state is made of, numbers in a vector
ENDINGS = 64
RARITY = 32
MOST_WORDS = 1_000_000  # bound of the vocabulary (its vectors are sent to all tasks); words beyond go by their endings
SENT_WORDS = 150_000  # at most so many common words are sent for their counts alone
TRAINER = 3_000_000  # tokens of a round for one task to train on, about
BATCH, RATE = 2048, 0.2  # tokens of a gradient step, its length
ALPHA = 0.1
END, FIRST = 0, 1 + ENDINGS  # the end mark, also what stands before a text; the first word of the vocabulary
Weights = dict[str, np.ndarray]


def words_of(text: str) -> list[bytes]:
    """Words, ASCII letters lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
                if len(counts) > 200_000:
                    yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in counts], "c": list(counts.values())})
                    counts = Counter()
        if counts:
            yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in counts], "c": list(counts.values())})

    rows = docs.select("text").mapInPandas(run, schema(("word", STRING), ("c", LONG)))
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> int:
    return 1 + zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Sizes:
    """Items are the end mark, the endings, then the vocabulary by falling count; ``start`` is where each class begins, and all end."""

    items: int
    start: np.ndarray

    @classmethod
    def of(cls, items: int) -> Sizes:
        classes = max(1, int(0.75 * np.sqrt(items)))
        grown = np.arange(1, classes + 1) ** 2 / classes**2 * max(0, items - 16 * classes) + 16 * np.arange(1, classes + 1)
        start = np.unique(np.r_[0, np.minimum(items, np.ceil(grown)), items].astype(np.int64))
        return cls(items, start)

    @property
    def classes(self) -> int:
        return len(self.start) - 1

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes), np.diff(self.start))


class Encoder:
    """Items of words."""

    def __init__(self, words: list[bytes]):
        self.own = {w: FIRST + k for k, w in enumerate(words)}
        self.known = dict(self.own)

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > len(self.own) + 400_000:
            self.known = known = dict(self.own)
        for w in set(words):
            if w not in known:
                known[w] = ending(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def texts(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(the items before each place, the last first; the item there) of all places of the texts, their ends included."""
        parts, gap = [], np.full(PLACES, END)
        for words in texts:
            parts += [gap, self.of(words), gap[:1]]
        flat = np.concatenate(parts) if parts else gap
        size = np.array([len(w) + 1 for w in texts], dtype=np.int64)
        start = PLACES + np.r_[0, np.cumsum(size + PLACES)[:-1]]
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.stack([flat[at - k] for k in range(1, PLACES + 1)], axis=1), flat[at]


def initial(sizes: Sizes, unigram: np.ndarray, seed: int = 5) -> Weights:
    """``unigram``: shares of the items, summing to 1."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    by_class = np.add.reduceat(unigram, sizes.start[:-1])
    within = np.log(np.maximum(unigram, 1e-30) / by_class[sizes.class_of])

    def outputs(bias: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(bias), WIDTH)), bias[:, None]], axis=1).astype(np.float32)

    return {
        "r": normal(sizes.items, WIDTH), "place": np.ones((PLACES, WIDTH), np.float32) / 2,
        "q": outputs(within), "qc": outputs(np.log(by_class)),  # the last number of each is its bias
    }


def states(w: Weights, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs' vectors, and the states with a one after them, which takes the bias."""
    x = w["r"][inputs]
    h = np.ones((len(x), WIDTH + 1), np.float32)
    np.einsum("bkd,kd->bd", x, w["place"], out=h[:, :WIDTH])
    return x, h


def summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, ascending, and the sum of each one's gradients."""
    order = np.argsort(rows)
    sorted_rows = rows[order]
    start = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    return sorted_rows[start], np.add.reduceat(grad.take(order, axis=0), start, axis=0)


class Trainer:
    """Stochastic gradient steps on a copy of the weights; Adagrad sets each number's pace. A batch's gradients for one vector add up."""

    def __init__(self, weights: Weights, sizes: Sizes, unigram: np.ndarray, seed: int, pace: float = 1.0):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.history = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        self.trained = {k: np.zeros(len(v), np.float64) for k, v in weights.items()}
        self.sizes, self.rng, self.pace = sizes, np.random.default_rng(seed), pace
        self.class_of = sizes.class_of
        self.class_share = np.add.reduceat(unigram, sizes.start[:-1])
        self.log_within = np.log(np.maximum(unigram / self.class_share[self.class_of], 1e-30)).astype(np.float32)
        upto, low = np.r_[0, np.cumsum(unigram)], sizes.start[:-1, None]
        high = sizes.start[1:, None]
        draw = upto[low] + self.rng.random((sizes.classes, 1024)) * (upto[high] - upto[low])
        self.noise = np.clip(np.searchsorted(upto, draw, side="right") - 1, low, high - 1)

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        own, total = summed(rows, grad)
        self._step(name, own, total, 1, rate)

    def _step(self, name: str, rows: np.ndarray | slice, g: np.ndarray, times: np.ndarray | float, rate: float) -> None:
        past = self.history[name][rows] + g * g
        self.history[name][rows] = past
        self.w[name][rows] -= (self.pace * rate) * g / np.sqrt(past)
        self.trained[name][rows] += times

    def words(self, inputs: np.ndarray, item: np.ndarray, batch: int = BATCH, classes: int = 64, own: int = 3, rate: float = RATE) -> None:
        """One pass, in random order. Noise: ``classes`` classes shared by a batch, ``own`` words of each true word's class."""
        w = self.w
        log_own = np.float32(np.log(own))
        order = self.rng.permutation(len(item))
        for lo in range(0, len(item), batch):
            pick = order[lo : lo + batch]
            rows, t = inputs[pick], item[pick]
            c = self.class_of[t]
            x, h = states(w, rows)
            gh = self._against_classes(h, c, classes, rate)
            every = np.empty((len(t), own + 1), np.int64)
            every[:, 0] = t
            every[:, 1:] = self.noise[c[:, None], self.rng.integers(0, 1024, (len(t), own))]
            q = w["q"][every]
            s = np.einsum("bd,bkd->bk", h, q) - (self.log_within[every] + log_own)
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30)))  # P(data)
            g[:, 0] -= 1
            gh += np.einsum("bk,bkd->bd", g, q)
            gh = gh[:, None, :WIDTH]
            self._rows("q", every.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, WIDTH + 1), rate)
            self._step("place", slice(None), np.einsum("bkd,bd->kd", x, gh[:, 0]), 1, rate / 4)
            self._rows("r", rows.ravel(), (gh * w["place"]).reshape(-1, WIDTH), rate)

    def _against_classes(self, h: np.ndarray, true: np.ndarray, k: int, rate: float) -> np.ndarray:
        """Moves classes towards the true and away from ``k`` shared noise classes; returns the states' gradient."""
        q = self.w["qc"]
        noise, times = np.unique(self.rng.choice(len(q), k, p=self.class_share), return_counts=True)
        log_noise = np.log(k * np.maximum(self.class_share, 1e-30)).astype(np.float32)
        own = -1 / (1 + np.exp(np.clip((h * q[true]).sum(axis=1) - log_noise[true], -30, 30)))
        other = times.astype(np.float32) / (1 + np.exp(-np.clip(h @ q[noise].T - log_noise[noise], -30, 30)))
        gh = own[:, None] * q[true] + other @ q[noise]
        whose = np.zeros((len(h), len(q)), np.float32)
        whose[:, noise] = other
        whose[np.arange(len(h)), true] += own
        self._step("qc", slice(None), whose.T @ h, 1, rate)
        return gh


def log_picked(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln of the softmax of each row of ``s`` at one place of it; ``s`` is used up."""
    if not s.size or s.max() > 60:  # else exponentials are finite as they are
        s -= s.max(axis=1, keepdims=True)
    own = s[np.arange(len(s)), at]
    np.exp(s, out=s)
    return own - np.log(s.sum(axis=1) + 1e-38)


def item_logs(w: Weights, sizes: Sizes, inputs: np.ndarray, item: np.ndarray) -> np.ndarray:
    """ln P(item | state), normalised over all items, in batched matrix products."""
    c = sizes.class_of[item]
    out, h = np.empty(len(item)), np.empty((len(item), WIDTH + 1), np.float32)
    qc, q = w["qc"].T.copy(), w["q"].T.copy()
    for lo in range(0, len(item), 2048):
        part = slice(lo, lo + 2048)
        h[part] = states(w, inputs[part])[1]
        out[part] = log_picked(h[part] @ qc, c[part])
    order = np.argsort(c, kind="stable")
    first = np.flatnonzero(np.r_[True, c[order][1:] != c[order][:-1]])
    for a, b in zip(first, np.r_[first[1:], len(c)]):
        low, high = sizes.start[c[order[a]]], sizes.start[c[order[a]] + 1]
        for lo in range(a, b, 2048):
            rows = order[lo : min(b, lo + 2048)]
            out[rows] += log_picked(h[rows] @ q[:, low:high], item[rows] - low)
    return out


@dataclass
class Model:
    weights: Weights
    sizes: Sizes
    words: bytes  # the common words by falling count, joined by line breaks; the first are the vocabulary
    counts: np.ndarray  # of the common words
    shared: np.ndarray  # log10 of what the words of each ending share, the end mark's at 0 unused
    tokens: int  # N
    distinct: int  # V
    documents: int


UPDATE = schema(("name", STRING), ("block", LONG), ("rows", T.BinaryType()), ("times", T.BinaryType()))
ROWS = 512  # rows of a block


def averaged(weights: Weights, copies: DataFrame) -> Weights:
    """``weights`` with each trained row set to its copies' mean, weighted by how often each copy trained it."""

    def add(group: tuple, blobs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = times = None
        for batch in blobs:
            for s, t in zip(batch["rows"], batch["times"]):
                t = np.frombuffer(t, np.float32).astype(np.float64)
                s = np.frombuffer(s, np.float16).reshape(len(t), -1) * t[:, None]
                sums, times = (s, t) if sums is None else (sums + s, times + t)
        mean = sums / np.maximum(times, 1)[:, None]
        yield pd.DataFrame([(*group, mean.astype(np.float32).tobytes(), times.astype(np.float32).tobytes())], columns=UPDATE.names)

    out = {k: v.copy() for k, v in weights.items()}
    found = copies.groupBy("name", "block").applyInPandas(add, UPDATE).toArrow()
    for name, block, rows, times in zip(*(found.column(c).to_pylist() for c in UPDATE.names)):
        at = np.flatnonzero(np.frombuffer(times, np.float32))
        out[name][block * ROWS + at] = np.frombuffer(rows, np.float32).reshape(-1, out[name].shape[1])[at]
    return out


def train(docs: DataFrame, words: list[bytes], unigram: np.ndarray, tokens: int, rounds: int = 3) -> tuple[Weights, Sizes]:
    """Weights after ``rounds``, each over its part of ``docs``: all are gone over once."""
    sizes = Sizes.of(len(unigram))
    weights = initial(sizes, unigram)
    if not tokens:
        return weights, sizes
    spark = docs.sparkSession
    turn = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((weights, b"\n".join(words), sizes, unigram))

        def run(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            weights, joined, sizes, unigram = sent.value
            encoder = Encoder(joined.split(b"\n") if joined else [])
            trainer = Trainer(weights, sizes, unigram, 100 + k, 1 / (1 + k))

            def learn(texts: list[list[bytes]]) -> None:
                inputs, item = encoder.texts(texts)
                trainer.words(inputs, item)

            texts, size = [], 0
            for batch in batches:
                for text in batch["text"]:
                    texts.append(words_of(text))
                    size += len(texts[-1]) + 1
                    if size > 200_000:
                        learn(texts)
                        texts, size = [], 0
            if texts:
                learn(texts)
            for name, w in trainer.w.items():
                times = trainer.trained[name]
                for at in range(0, len(w), ROWS):
                    t = times[at : at + ROWS]
                    if t.any():
                        yield pd.DataFrame([(name, at // ROWS, w[at : at + ROWS].astype(np.float16).tobytes(), t.astype(np.float32).tobytes())], columns=UPDATE.names)

        part = docs.where(turn == k).select("text").coalesce(-(-tokens // (rounds * TRAINER)))
        weights = averaged(weights, part.mapInPandas(run, UPDATE))
        sent.unpersist()
    return weights, sizes


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the counts of all words (word, c) of the training documents ``docs``."""
    docs = documents(docs)
    counts = written(word_counts(docs), "word-counts")
    n_docs = docs.count()
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(map(tuple, counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)), F.sum("c")).collect()), reverse=True)  # a few hundred rows
    tokens, distinct = sum(c for _, _, c in sizes) + n_docs, sum(n for _, n, _ in sizes) + bool(n_docs)
    least, held = max(2, tokens**0.5 / RARITY), 0
    sent = vocabulary = 1 + max((s for s, _, _ in sizes), default=0)  # the lowest step of each
    for s, n, _ in sizes:
        held += n
        if held <= SENT_WORDS:
            sent = s
        if held <= MOST_WORDS and 2 ** (s / 8) >= least:
            vocabulary = s
    found = counts.where(step >= min(sent, vocabulary)).toArrow()  # at most MOST_WORDS rows
    times, names = found.column("c").to_numpy(), found.column("word").to_pylist()
    order = sorted(range(len(names)), key=lambda k: (-times[k], names[k]))
    common, times = [names[k].encode() for k in order], times[order]
    del found, names
    own = common[: int((np.floor(np.log2(times) * 8) >= vocabulary).sum())]
    label = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % ENDINGS
    rest = counts.where(step < vocabulary).groupBy(label.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    held, kinds = np.zeros(FIRST), np.zeros(FIRST)
    for r in rest:
        held[1 + r.k], kinds[1 + r.k] = r.c, r.v
    unigram = np.r_[n_docs, held[1:], times[: len(own)]] + ALPHA
    weights, shape = train(docs, own, unigram / unigram.sum(), tokens)
    return Model(weights, shape, b"\n".join(common), times, np.log10(held + ALPHA * (kinds + 1)), tokens, distinct, n_docs), counts


PARTS = schema(
    ("row", STRING), ("word", STRING), ("doc_id", LONG), ("times", LONG), ("n_tokens", LONG), ("known", LONG), ("base", DOUBLE), ("own", DOUBLE)
)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Scores are log10. A null or empty text is the end mark alone; texts are scored whole, however long;
    a null doc_id reads as -1; repeated rows are scored each; no column but doc_id and text is read, so others
    may have any name; an empty table gives an empty one. Where nothing was learned all words are new.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        common = m.words.split(b"\n") if m.words else []
        encoder = Encoder(common[: m.sizes.items - FIRST])
        place = {w: k for k, w in enumerate(common)}
        logs = np.log10(np.r_[m.counts, 1].astype(float) + ALPHA)  # the last for words to be joined
        logs[-1] = 0
        end = np.log10(m.documents + ALPHA)

        def scored(ids: list[int], names: list[str], texts: list[list[bytes]]) -> Iterator[pd.DataFrame]:
            inputs, item = encoder.texts(texts)
            each = item_logs(m.weights, m.sizes, inputs, item) / np.log(10)
            others = (item > END) & (item < FIRST)
            each[others] -= m.shared[item[others]]
            rows, lo = [], 0
            joined: tuple[list, list, list, list] = ([], [], [], [])
            for doc, name, words in zip(ids, names, texts):
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                found = logs[at]
                own = each[lo : lo + len(words) + 1].sum() + found[others[lo : lo + len(words)]].sum()
                lo += len(words) + 1
                here = int((at >= 0).sum())
                rows.append((name, name, doc, 0, len(words) + 1, here + (m.documents > 0), float(found.sum()) + end, float(own)))
                if here < len(words):
                    rest = Counter(words[k] for k in np.flatnonzero(at < 0).tolist())
                    joined[0].extend([name] * len(rest))
                    joined[1].extend(w.decode("utf-8", "replace") for w in rest)
                    joined[2].extend([doc] * len(rest))
                    joined[3].extend(rest.values())
            yield pd.DataFrame(rows, columns=PARTS.names)
            if joined[0]:
                yield pd.DataFrame(dict(zip(PARTS.names, joined)) | {"n_tokens": 0, "known": 0, "base": 0.0, "own": 0.0})

        for batch in batches:
            ids, names, texts, size = [], [], [], 0
            for doc, name, text in zip(batch["doc_id"].tolist(), batch["row"], batch["text"]):
                ids.append(doc)
                names.append(name)
                texts.append(words_of(text))
                size += len(texts[-1]) + 1
                if size > 100_000:
                    yield from scored(ids, names, texts)
                    ids, names, texts, size = [], [], [], 0
            if ids:
                yield from scored(ids, names, texts)

    # a row's name holds blanks, so that no word is equal to it; parts of a task that runs again are the same
    name = F.concat_ws(" ", F.lit(" row"), F.spark_partition_id(), F.monotonically_increasing_id())
    parts = documents(docs).select("doc_id", "text", name.alias("row")).mapInPandas(run, PARTS)
    here = F.coalesce("c", F.lit(0))
    log = F.when(F.col("times") > 0, F.col("times") * F.log10(here + ALPHA)).otherwise(0.0)
    sums = parts.join(counts, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(here > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + log).alias("base"),
        F.sum(F.col("own") + log).alias("score"),
    )
    floor = float(np.log10(model.tokens + ALPHA * (model.distinct + 1)))
    return sums.select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )

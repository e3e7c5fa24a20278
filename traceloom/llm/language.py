"""Language identification by segmentation-marginalised unigrams.

Each language gives the pieces of a fixed public vocabulary probabilities, fitted by expectation
maximisation on words of labelled documents. A word's probability is the sum over all its
segmentations (forward algorithm), however long the word is; a text's is the product over its words.
Words recur, so the forward pass runs once for each distinct word a task meets: vectorised over words
of equal length, and for long words along the word, rescaled as it goes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, STRING, documents, schema

TOGETHER = 32  # words up to so many letters are scored with others of their length, longer ones along the word
FITTED = 4096  # words of equal length that a step of the fit takes at once
FLOOR = 1e-7  # probability of a character outside the vocabulary
CACHE_WORDS = 150_000


def normal(word: str) -> str:
    """The letters of a word."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that are letters, lower case, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p and (p.removeprefix("▁").isalpha() or p == "▁"))


class Lattice:
    """Piece ids of all spans of strings of equal length."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.widest = max(map(len, pieces), default=1)
        codes = np.array([self._codes([p])[0] @ self._powers(len(p)) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        step = 0x9E3779B97F4A7C15
        return np.array([pow(step, n - 1 - i, 1 << 64) for i in range(n)], dtype=np.uint64)

    @staticmethod
    def _codes(strings: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        return flat.reshape(len(strings), -1) + np.uint64(0x1F123BB5)

    def _ids(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)

    def spans(self, strings: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) -> ids, -1 where the vocabulary lacks the piece."""
        codes, out = self._codes(strings), {}
        n, step = codes.shape[1], np.uint64(0x9E3779B97F4A7C15)
        for i in range(n):
            code = np.zeros(len(strings), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.widest) + 1):
                code = code * step + codes[:, j - 1]
                ids = self._ids(code)
                if j == i + 1 or (ids >= 0).any():
                    out[i, j] = ids
        return out

    def ending(self, string: str, block: int = 4096) -> Iterator[np.ndarray]:
        """For blocks of places of one long string: (places, widest) ids of the spans of each width that end there."""
        codes, powers = self._codes([string])[0], self._powers(self.widest)[::-1]
        for lo in range(0, len(codes), block):
            own = codes[max(0, lo - self.widest + 1) : lo + block]
            code, out = np.zeros(len(own), dtype=np.uint64), []
            for w in range(min(self.widest, len(own))):
                code[w:] += own[: len(own) - w] * powers[w]
                ids = self._ids(code)
                ids[:w] = -2  # would start before the string
                out.append(ids)
            out += [np.full(len(own), -2)] * (self.widest - len(out))
            yield np.stack(out, axis=1)[min(lo, self.widest - 1) :]


Met = dict[tuple[int, int], tuple[np.ndarray | slice, np.ndarray]]


def met_spans(spans: dict[tuple[int, int], np.ndarray]) -> Met:
    """``spans`` as (rows, ids) of the pieces that are there; single characters stay whole, so that those outside count too."""
    out: Met = {}
    for (i, j), ids in spans.items():
        rows = slice(None) if j == i + 1 else np.flatnonzero(ids >= 0).astype(np.int32)
        out[i, j] = rows, ids[rows].astype(np.int32)
    return out


def forward(spans: dict, n: int, rows: int, prob: np.ndarray, widest: int) -> list[np.ndarray]:
    """prob: (pieces + 1, languages), the last row for single characters outside. -> n + 1 arrays (rows, languages)."""
    alpha = [np.ones((rows, prob.shape[1]))] + [np.zeros((rows, prob.shape[1])) for _ in range(n)]
    for j in range(1, n + 1):
        for i in range(max(0, j - widest), j):
            ids = spans.get((i, j))
            if ids is None:
                continue
            if j == i + 1:
                alpha[j] += alpha[i] * prob[ids]  # -1 is the last row
            else:
                rows_in = np.flatnonzero(ids >= 0)
                alpha[j][rows_in] += alpha[i][rows_in] * prob[ids[rows_in]]
    return alpha


def long_score(word: str, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """log probability of one word of any length in each language; the last sums are rescaled at each step."""
    past = np.zeros((lattice.widest, prob.shape[1]))  # past[w]: the sum up to w + 1 places before
    past[0] = 1.0
    scale = np.zeros(prob.shape[1])
    extended = np.vstack([prob, np.zeros((1, prob.shape[1]))])
    for ids in lattice.ending(word):
        ids = np.where(ids >= 0, ids, len(prob))
        ids[:, 0] = np.where(ids[:, 0] == len(prob), len(prob) - 1, ids[:, 0])
        for each in extended[ids]:
            now = (past * each).sum(axis=0)
            scale += np.log(now)
            past[1:] = past[:-1] / now
            past[0] = 1.0
    return scale


def word_scores(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """log probability of each word in each language."""
    out = np.zeros((len(words), prob.shape[1]))
    groups: dict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(words):
        if len(word) > TOGETHER:
            out[k] = long_score("▁" + word, lattice, prob)
        elif word:
            groups[len(word) + 1].append(k)
    for n, at in groups.items():
        for s in range(0, len(at), 2_000):
            part = at[s : s + 2_000]
            spans = lattice.spans(["▁" + words[k] for k in part])
            out[part] = np.log(forward(spans, n, len(part), prob, lattice.widest)[-1])
    return out


def fit(words: dict[str, Counter], lattice: Lattice, rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the (pieces + 1, languages) probabilities, by expectation maximisation.

    Learns from words of at most ``TOGETHER`` letters; longer ones are scored, but teach nothing.
    """
    names = sorted(words)
    prob = np.full((lattice.size + 1, len(names)), 1.0 / max(1, lattice.size))
    prob[-1] = FLOOR
    groups: dict[int, list[tuple[int, Met, np.ndarray]]] = {}
    for k, name in enumerate(names):
        sized: dict[int, list[str]] = defaultdict(list)
        for word in words[name]:
            if len(word) <= TOGETHER:
                sized[len(word) + 1].append(word)
        groups[k] = []
        for n, own in sized.items():
            for lo in range(0, len(own), FITTED):
                part = own[lo : lo + FITTED]
                count = np.fromiter((words[name][w] for w in part), float, len(part))
                groups[k].append((n, met_spans(lattice.spans(["▁" + w for w in part])), count))
    for _ in range(rounds):
        then = np.full_like(prob, 0.01)
        for k in range(len(names)):
            own = prob[:, k].copy()
            for n, spans, count in groups[k]:
                alpha = [np.ones(len(count))] + [np.zeros(len(count)) for _ in range(n)]
                beta = [np.zeros(len(count)) for _ in range(n)] + [np.ones(len(count))]
                for j in range(1, n + 1):
                    for i in range(max(0, j - lattice.widest), j):
                        if (i, j) in spans:
                            at, ids = spans[i, j]
                            alpha[j][at] += alpha[i][at] * own[ids]  # -1 is the last row
                for j in range(n, 0, -1):
                    for i in range(max(0, j - lattice.widest), j):
                        if (i, j) in spans:
                            at, ids = spans[i, j]
                            beta[i][at] += own[ids] * beta[j][at]
                for (i, j), (at, ids) in spans.items():
                    share = alpha[i][at] * own[ids] * beta[j][at] / alpha[n][at] * count[at]
                    then[:, k] += np.bincount(np.where(ids < 0, lattice.size, ids), share, lattice.size + 1)
        prob[:-1] = then[:-1] / then[:-1].sum(axis=0)
        prob[-1] = FLOOR
    return names, prob


def train(labelled: DataFrame, vocabulary_path: str, sample: int = 1500) -> tuple[list[str], list[str], np.ndarray]:
    """pieces, languages, probabilities from about ``sample`` documents of each ``lang``, chosen by a hash of id and text.

    Rows without ``lang`` or text teach nothing. Null and repeated ids do not matter; rows of the same id and text are chosen together and
    count once. The model holds a column for each language, so their number is one that a driver can hold.
    """
    labelled = labelled.where("lang is not null and text is not null")
    held = labelled.groupBy("lang").count()
    unit = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(held), "lang").where(unit < F.lit(float(sample)) / F.col("count")).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter((lang, w) for lang, text in zip(batch["lang"], batch["text"]) for w in map(normal, text.lower().split()) if w)
            if found:
                yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"])

    counted = rows.mapInPandas(count, schema(("lang", STRING), ("word", STRING), ("n", LONG)))
    words: dict[str, Counter] = defaultdict(Counter)
    # words of the bounded sample, in batches of columns: a row object each would be most of the driver's memory
    for batch in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow().to_batches(max_chunksize=10_000):
        for lang, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            words[lang][word] = n
    pieces = vocabulary(vocabulary_path)
    names, prob = fit({k: v for k, v in words.items() if v}, Lattice(pieces))
    return pieces, names, prob


PREDICTED = T.StructType([T.StructField("lang_pred", STRING), T.StructField("score", DOUBLE)])


def predictor(df: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> Callable[[Column], Column]:
    """Of a text column: a struct of lang_pred, the likeliest language, and score, its posterior under equal priors."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, names, prob = sent.value
        lattice = Lattice(pieces) if names else None
        at: dict[str, int] = {}
        table, used = np.zeros((1024, len(names))), 0
        for batch in batches:
            langs, scores = [], []
            for lo in range(0, len(batch), 100):
                split = [(t or "").lower().split() for t in batch.iloc[lo : lo + 100]]
                new = {w for words in split for w in words if w not in at} if names else set()
                if len(at) + len(new) > CACHE_WORDS:
                    at.clear()
                    used, new = 0, {w for words in split for w in words}
                if new:
                    at.update(zip(new, range(used, used + len(new))))
                    if used + len(new) > len(table):
                        table = np.concatenate([table[:used], np.zeros((used + 2 * len(new), len(names)))])
                    table[used : used + len(new)] = word_scores([normal(w) for w in new], lattice, prob)
                    used += len(new)
                for words in split:
                    if not names or not any(c.isalpha() for w in words for c in w):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict.asNondeterministic()  # so that a filter on the result does not run it twice


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``, repeated rows each.

    A text that is null or has no letter is ``und`` with score 0, as is every text when no language
    was learned. Long texts and long words are scored whole; of languages that score the same, the first by
    name. A null doc_id reads as -1. No other column is read; an empty table gives an empty one.
    """
    found = documents(docs).select("doc_id", predictor(docs, model)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.*")


def accepted(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that have a language, with ``lang`` set to it and all other columns kept, whatever their names.

    Rows are judged one by one in a single pass, by their text alone: null or repeated ids do not matter. Rows
    that ``identify`` calls ``und`` go.
    """
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), predictor(docs, model)(F.col("text")).alias("found"))
    return found.where("found.lang_pred != 'und'").select(
        *(F.col("found.lang_pred").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns)
    )

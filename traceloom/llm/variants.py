"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's letter counts by at most two in all: a replacement takes one
letter and adds another, an insertion adds one. So of words of the same length those in reach gain one count at
most and lose one at most, of words a letter longer those that gain exactly one. Each length has a k-d tree of
its own: its upper part, split on a bounded sample, cuts the words into cells; each cell is a task's group, with a
tree of its words. A word is sent to its own cell and, as a query, to those of its length and the next whose boxes
are in reach. In a cell, boxes prune all queries at once, level by level, and what is left is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, discard, documents, hash_sample, schema, written

LETTER_RUN = "[a-zÀ-ÿ]"
DIMS = 32  # a to z, and six for the other letters, by their code: an edit moves these counts as little
CELL = 8192  # words of up to 16 letters in a cell, about; longer words count as more
SAMPLE = 16_384  # words of a length, at most about, that the upper part of its tree is split on
LEAF = 8
FAR = 1 << 30
SAME, LONGER = (1, 1), (1, 0)  # counts that a neighbour may gain and lose


def misspelled(run: str, doc_prefix: int, one_in: int) -> str:
    """``run`` less one of its letters where ``one_in`` divides the crc32 of ``<doc_id>:<run>``; ``doc_prefix`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), doc_prefix)
    if h % one_in:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def words(docs: DataFrame, least_chars: int = 7, least_n: int = 2, drop_one_in: int | None = None) -> DataFrame:
    """word, n: letter runs of whole texts (A-Z in lower case) of ``least_chars`` letters or more, seen ``least_n`` times or more.

    ``drop_one_in``: one in so many runs of a document loses a letter before it counts, chosen by ``misspelled``. Null texts have no runs; null ids read as -1.
    """
    runs = re.compile(f"{LETTER_RUN}{{{least_chars},}}")  # shorter ones are too short whatever they lose

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                own = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                prefix = zlib.crc32(f"{doc}:".encode())
                for run, n in own.items():
                    word = run if drop_one_in is None else misspelled(run, prefix, drop_one_in)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > 200_000:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    counted = documents(docs).mapInPandas(count, schema(("word", STRING), ("n", LONG)))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def letters(group: list[str]) -> np.ndarray:
    """(len(group), length) code points of words of one length, all below 256."""
    return np.frombuffer("".join(group).encode("latin-1"), np.uint8).reshape(len(group), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """(len(codes), DIMS): how often each letter stands in each word."""
    dim = np.where(codes < 0xC0, codes - 97, 26 + codes % 6)
    flat = dim.astype(np.int64) + np.arange(len(codes))[:, None] * DIMS
    return np.bincount(flat.ravel(), minlength=len(codes) * DIMS).reshape(-1, DIMS).astype(np.int32)


class Tree:
    """A k-d tree over count vectors: nodes with a box each, split where the parts are most even.

    ``tight``: boxes are of the vectors in them, else of the space cut, so that any vector has one leaf.
    """

    def __init__(self, vectors: np.ndarray, leaf: int, tight: bool, most_leaves: int = FAR):
        self.dim, self.edge, self.left, self.right, self.low, self.high, self.rows = [], [], [], [], [], [], []
        whole = (np.zeros(DIMS, np.int32), np.full(DIMS, FAR, np.int32))
        todo, leaves = [(np.arange(len(vectors)), whole, -1, False)], 1
        for rows, (low, high), above, right in todo:
            at = len(self.dim)
            if above >= 0:
                (self.right if right else self.left)[above] = at
            own = vectors[rows]
            if tight and len(rows):
                low, high = own.min(axis=0), own.max(axis=0)
            split = self._split(own) if len(rows) > leaf and leaves < most_leaves else None
            self.dim.append(split[0] if split else -1)
            self.edge.append(split[1] if split else 0)
            self.left.append(-1)
            self.right.append(-1)
            self.low.append(low)
            self.high.append(high)
            self.rows.append(None if split else rows)
            if split:
                leaves += 1
                d, edge = split
                below = own[:, d] <= edge
                up, down = low.copy(), high.copy()
                down[d], up[d] = edge, edge + 1
                todo += [(rows[below], (low, down), at, False), (rows[~below], (up, high), at, True)]
        self.dim, self.edge = np.array(self.dim), np.array(self.edge)
        self.left, self.right = np.array(self.left), np.array(self.right)
        self.low, self.high = np.array(self.low), np.array(self.high)

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part the vectors most evenly, None where all are equal."""
        middle = np.partition(own, (len(own) - 1) // 2, axis=0)[(len(own) - 1) // 2]
        parts = [(np.abs((own <= edge).sum(axis=0) * 2 - len(own)), edge) for edge in (middle, middle - 1)]
        uneven, d, edge = min((int(u[d]), d, int(edge[d])) for u, edge in parts for d in [int(u.argmin())])
        return None if uneven == len(own) else (d, edge)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector falls into."""
        at = np.zeros(len(vectors), np.int64)
        while (inner := self.dim[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(vectors[rows, self.dim[node]] <= self.edge[node], self.left[node], self.right[node])
        return at

    def reach(self, vectors: np.ndarray, gain: int, loss: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) of all leaves whose box holds a point that gains at most ``gain`` and loses at most ``loss`` counts on the vector."""
        q, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        out_q, out_node = [], []
        while len(q):
            own = vectors[q]
            near = (np.maximum(self.low[node] - own, 0).sum(axis=1) <= gain) & (np.maximum(own - self.high[node], 0).sum(axis=1) <= loss)
            q, node = q[near], node[near]
            leaf = self.dim[node] < 0
            out_q.append(q[leaf])
            out_node.append(node[leaf])
            q, node = q[~leaf], node[~leaf]
            q, node = np.concatenate([q, q]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate(out_q or [q]), np.concatenate(out_node or [node])


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of letters that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``long`` that are those of ``short`` with one letter more."""
    k = short.shape[1]
    head, tail = short != long[:, :k], short != long[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), k)  # as far as they agree from the start
    last = np.where(tail.any(axis=1), k - 1 - tail[:, ::-1].argmax(axis=1), -1)  # and from the end
    return last < first


def _near(tree: Tree, codes: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs one edit apart; queries are as long as the rows or a letter shorter. ``own``: queries are the rows, each pair comes once."""
    starts = np.cumsum([0, *(len(r) if r is not None else 0 for r in tree.rows)])
    flat = np.concatenate([r for r in tree.rows if r is not None])
    step = max(1, min(2048, (1 << 22) // max(1, codes.shape[1])))
    longer = queries.shape[1] < codes.shape[1]
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        q, leaf = tree.reach(vectors[at : at + step] if own else letter_counts(part), *(LONGER if longer else SAME))
        n = starts[leaf + 1] - starts[leaf]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q, row = np.repeat(q, n), flat[np.repeat(starts[leaf], n) + within]
        if own:
            once = q + at < row
            q, row = q[once], row[once]
        for cut in range(0, len(q), 1 << 18):
            a, b = q[cut : cut + (1 << 18)], row[cut : cut + (1 << 18)]
            found = one_inserted(part[a], codes[b]) if longer else one_replaced(part[a], codes[b])
            yield a[found] + at, b[found]


def _best(word: np.ndarray, near: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (word, near word) pairs: each word, how many it has, and the best of them (largest n, then smallest rank)."""
    order = np.lexsort([rank[near], -n[near], word])
    word, near = word[order], near[order]
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return word[start], np.diff(np.r_[start, len(word)]), near[start]


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Of a cell's words and queries: each word with near ones here, how many, and the best of them."""
    group = group.sort_values("role", kind="stable", ignore_index=True)
    text, role, n = group["word"].tolist(), group["role"].to_numpy(), group["n"].to_numpy()
    ends = np.searchsorted(role, [0, 1, 2, 3])
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if ends[1]:
        codes = letters(text[: ends[1]])
        vectors = letter_counts(codes)
        tree = Tree(vectors, LEAF, tight=True)
        for k in range(3):
            if ends[k] < ends[k + 1]:
                for a, b in _near(tree, codes, vectors, codes if k == 0 else letters(text[ends[k] : ends[k + 1]]), k == 0):
                    pairs_a.append(a + ends[k])
                    pairs_b.append(b)
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    rank = np.empty(len(text), np.int64)
    rank[np.array(sorted(range(len(text)), key=text.__getitem__), dtype=np.int64)] = np.arange(len(text))
    word, count, best = _best(np.concatenate([a, b]), np.concatenate([b, a]), n, rank) if len(a) else (a, a, a)
    text = np.array(text, dtype=object)
    return pd.DataFrame({"word": text[word], "n_near": count.astype(np.int64), "best_n": n[best], "best": text[best]})


def _cells_of(words: DataFrame) -> dict[int, Tree]:
    """The upper parts of the trees of all lengths that fill more than one cell."""
    size = F.greatest(F.length("word"), F.lit(16)) / F.lit(16.0 * CELL)
    cells = {r["length"]: int(r["cells"]) for r in words.groupBy(F.length("word").alias("length")).agg(F.ceil(F.sum(size)).alias("cells")).where("cells > 1").collect()}
    if not cells:
        return {}

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [np.minimum(letter_counts(letters([w]))[0], 255).astype(np.uint8).tobytes() for w in batch["word"]]
            yield pd.DataFrame({"length": batch["length"], "counts": rows})

    long = words.select("word", F.length("word").alias("length")).where(F.col("length").isin(list(cells)))
    sample = hash_sample(long, "word", "length", SAMPLE).mapInPandas(counts, schema(("length", T.IntegerType()), ("counts", T.BinaryType()))).toPandas()
    trees = {}
    for length, own in sample.groupby("length"):
        vectors = np.frombuffer(b"".join(own["counts"]), np.uint8).reshape(-1, DIMS).astype(np.int32)
        trees[int(length)] = Tree(vectors, 1, tight=False, most_leaves=cells[int(length)])
    return trees


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of largest n, then smallest), best_n: of every word that has a near one.

    ``words``: word (distinct, letters of code below 256 in lower case), n; all lengths, an empty table gives an empty one. Every pair one
    edit apart is found, in one cell alone. A cell that is still twice too large (many words of
    equal counts, or a sample that missed them) is cut into parts by hash, and queries go to each of these.
    """
    trees = _cells_of(words)

    def by_length(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths = batch["word"].str.len().to_numpy()
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for at in range(0, len(rows), step := max(1, (1 << 20) // int(length))):
                some = rows[at : at + step]
                yield int(length), some, letter_counts(letters(batch["word"].iloc[some].tolist()))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            for length, rows, vectors in by_length(batch):
                if length in trees:
                    cell[rows] = trees[length].home(vectors)
            yield batch.assign(length=batch["word"].str.len().astype("int32"), cell=cell)

    settled = words.select("word", "n").mapInPandas(settle, schema(("word", STRING), ("n", LONG), ("length", T.IntegerType()), ("cell", LONG)))
    settled = written(settled, "variant-cells")
    bulk = F.ceil(F.sum(F.greatest(F.col("length"), F.lit(16))) / F.lit(32.0 * CELL)).alias("parts")
    parts = {(r["length"], r["cell"]): int(r["parts"]) for r in settled.groupBy("length", "cell").agg(bulk).where("parts > 1").collect()}

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            word, n, home = batch["word"].to_numpy(), batch["n"].to_numpy(), batch["cell"].to_numpy()
            for length, rows, vectors in by_length(batch):
                of, cell, part, role = [], [], [], []

                def put(rows_, cells_, role_, parts_=None):
                    of.append(rows_)
                    cell.append(cells_)
                    role.append(np.full(len(rows_), role_, np.int32))
                    part.append(np.zeros(len(rows_), np.int32) if parts_ is None else parts_)

                def ask(rows_, cells_, role_, to):
                    split = np.array([(to, c) in parts for c in cells_.tolist()], dtype=bool) if parts else np.zeros(len(cells_), bool)
                    put(rows_[~split], cells_[~split], role_)
                    for r, c in zip(rows_[split].tolist(), cells_[split].tolist()):
                        k = parts[to, c]
                        put(np.full(k, r), np.full(k, c), role_, np.arange(k, dtype=np.int32))

                # itself: a word of its cell, and a query to the later parts of it
                split = [(r, parts[length, home[r]]) for r in rows.tolist() if (length, home[r]) in parts] if parts else []
                cut = {r: zlib.crc32(word[r].encode()) % k for r, k in split}
                put(rows, home[rows], 0, np.array([cut.get(r, 0) for r in rows.tolist()], np.int32))
                for r, k in split:
                    later = np.arange(cut[r] + 1, k, dtype=np.int32)
                    put(np.full(len(later), r), np.full(len(later), home[r]), 1, later)
                if length in trees:  # a pair of two cells meets in the later one
                    q, leaf = trees[length].reach(vectors, *SAME)
                    later = leaf > home[rows[q]]
                    ask(rows[q[later]], leaf[later], 1, length)
                if length + 1 in trees:
                    q, leaf = trees[length + 1].reach(vectors, *LONGER)
                    ask(rows[q], leaf, 2, length + 1)
                else:
                    ask(rows, np.zeros(len(rows), np.int64), 2, length + 1)
                of, role = np.concatenate(of), np.concatenate(role)
                out = {"length": (length + (role == 2)).astype(np.int32), "cell": np.concatenate(cell), "part": np.concatenate(part), "role": role, "word": word[of], "n": n[of]}
                yield pd.DataFrame(out)

    sent = settled.mapInPandas(send, schema(("length", T.IntegerType()), ("cell", LONG), ("part", T.IntegerType()), ("role", T.IntegerType()), ("word", STRING), ("n", LONG)))
    met = sent.groupBy("length", "cell", "part").applyInPandas(_meet, schema(("word", STRING), ("n_near", LONG), ("best_n", LONG), ("best", STRING)))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_first")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("_first.best").alias("best"), (-F.col("_first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from word to word ends. Each form is ten times as frequent, so a few rounds of doubling do."""
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        then = written(now.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "variant-roots")
        discard(now)
        now = then
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def grouped(docs: DataFrame, least_chars: int = 7, least_n: int = 2, times: int = 10, drop_one_in: int | None = None) -> DataFrame:
    """word, n, n_near (words one edit apart), form, form_n, root: every word of ``docs`` and the more frequent one it is a variant of.

    A word's form is its near word of largest n (of several, the smallest), if that n is ``times`` its own or more, else null. ``root``
    follows forms to the last: a group of variants shares its root, and a word without a form is its own. Repeated rows count again;
    rows without letters and empty tables give no words. Only doc_id and text are read.
    """
    found = written(words(docs, least_chars, least_n, drop_one_in), "variant-words")
    near = found.join(near_words(found), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variant-forms")
    last = roots(near.where("form is not null").select("word", "form"))
    return near.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))

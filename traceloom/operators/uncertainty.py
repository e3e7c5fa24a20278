"""Uncertainty metrics."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def entropy_of_logs(logs: Column) -> Column:
    """-sum p ln(p + 1e-8) of log-probabilities, renormalised."""
    shifted = F.transform(F.array(logs), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(
        F.array(shifted),
        lambda a: F.transform(F.array(total(a)), lambda t: -F.aggregate(a, F.lit(0.0), lambda s, x: s + x / t * F.log(x / t + EPS)))[0],
    )[0]


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def array_std(values: Column) -> Column:
    """Population standard deviation."""
    return F.transform(F.array(array_mean(values)), lambda m: F.sqrt(array_mean(F.transform(values, lambda x: (x - m) * (x - m)))))[0]


def meaningful(tokens: Column, noise: str = r"""^[\s'"`:,]*$""") -> Column:
    """The tokens after the first that holds ``[`` and before the last that holds ``]``, without blanks and marks."""
    opens = F.array_position(F.transform(tokens, lambda t: t.contains("[")), True)
    closes = F.size(tokens) - F.array_position(F.reverse(F.transform(tokens, lambda t: t.contains("]"))), True) + 1
    has = F.exists(tokens, lambda t: t.contains("[")) & F.exists(tokens, lambda t: t.contains("]"))
    inner = F.slice(tokens, (opens + 1).cast("int"), F.greatest((closes - opens - 1).cast("int"), F.lit(0)))
    return F.filter(F.when(has, inner).otherwise(tokens), lambda t: ~t.rlike(noise))


def response_means(values: Column) -> Column:
    """Means over all tokens, the first, and the first five."""
    return F.struct(array_mean(values).alias("all"), F.try_element_at(values, F.lit(1)).alias("first"), array_mean(F.slice(values, 1, 5)).alias("five"))


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """U4: each outer group's mean of its inner groups' means."""
    return df.groupBy(outer, inner).agg(F.avg(value).alias("_m")).groupBy(outer).agg(F.avg("_m").alias("mean"))


def flattened(nested: Column, levels: int) -> Column:
    """``levels`` levels of nesting taken out."""
    for _ in range(levels):
        nested = F.flatten(nested)
    return nested


def semantic_entropy(df: DataFrame, by: str, v: str) -> DataFrame:
    """Entropy of the softmax of each group's cosines to the group's mean vector."""
    each = df.select(by, v, F.monotonically_increasing_id().alias("_id"))
    mean = df.select(by, F.posexplode(v).alias("d", "x")).groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("_m"))
    met = each.join(mean, by).withColumn("c", cosine(F.col(v), F.col("_m")))
    # cosines lie between -1 and 1: their exponentials need no shift
    sums = met.groupBy(by).agg(F.sum(F.exp("c")).alias("_z"))
    p = F.exp("c") / F.col("_z")
    return met.join(sums, by).groupBy(by).agg((-F.sum(p * F.log(p + EPS))).alias("entropy"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, w: u.cast("double") * w.cast("double")), F.lit(0.0), lambda s, t: s + t)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pairwise_cosine(df: DataFrame, by: str, key: str, v: str) -> DataFrame:
    """Mean, max, min, median and std of the cosines of all pairs in a group; meant for groups of bounded size (responses to one prompt)."""
    a = df.select(by, F.col(key).alias("_a"), F.col(v).alias("_x"))
    b = df.select(by, F.col(key).alias("_b"), F.col(v).alias("_y"))
    c = a.join(b, by).where("_a < _b").withColumn("c", cosine(F.col("_x"), F.col("_y")))
    return c.groupBy(by).agg(
        F.avg("c").alias("mean"), F.max("c").alias("max"), F.min("c").alias("min"), F.median("c").alias("median"), F.stddev_pop("c").alias("std")
    )


def _silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    kinds = np.unique(label)
    if len(kinds) < 2 or len(kinds) >= len(label):
        return -1.0
    sums = np.stack([distance[:, label == k].sum(axis=1) for k in kinds], axis=1)
    size = np.array([(label == k).sum() for k in kinds])
    own = np.searchsorted(kinds, label)
    rows = np.arange(len(label))
    inner = np.where(size[own] > 1, sums[rows, own] / np.maximum(size[own] - 1, 1), 0)
    others = sums / size
    others[rows, own] = np.inf
    outer = others.min(axis=1)
    s = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0)
    return float(s.mean())


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    centre = x[[rng.integers(len(x))]]
    while len(centre) < k:
        d = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
        centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]])
    for _ in range(rounds):
        label = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        then = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centre[j] for j in range(k)])
        if np.allclose(then, centre):
            break
        centre = then
    return label


def cluster_entropy(df: DataFrame, by: str, key: str, v: str, most: int = 10, seed: int = 0) -> DataFrame:
    """U8: group, entropy of cluster shares and k, for the k-means of 2 to ``most`` with the best silhouette. For many small groups."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values(key)[v].to_list()).astype(float)
        distance = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
        rng, best = np.random.default_rng(seed), (-2.0, np.zeros(len(x), int), 1)
        for k in range(2, min(most, len(x) - 1) + 1):
            label = _kmeans(x, k, rng)
            s = _silhouette(distance, label)
            if s > best[0]:
                best = (s, label, k)
        p = np.bincount(best[1]) / len(x)
        p = p[p > 0]
        return pd.DataFrame([(group[0], float(-(p * np.log(p)).sum()), best[2])], columns=[by, "entropy", "k"])

    kind = dict(df.dtypes)[by]
    return df.select(by, key, v).groupBy(by).applyInPandas(run, f"{by} {kind}, entropy double, k long")


def cluster_entropy_of_all(df: DataFrame, v: str, most: int = 10, seed: int = 0) -> DataFrame:
    """U8 for one large group: entropy of cluster shares and k, over all rows, each k-means and its silhouette a few passes of Spark.

    The measure is of squared distances, as Spark's is. Where no k fits (fewer than three rows, or all equal), entropy 0 and k 1.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    spark, rows = df.sparkSession, df.select(array_to_vector(F.col(v).cast("array<double>")).alias("features")).persist()
    best, n = (-1.0, 0.0, 1), rows.count()
    for k in range(2, min(most, n - 1) + 1):
        model = KMeans(k=k, seed=seed).fit(rows)
        found = model.transform(rows)
        sizes = [r["count"] for r in found.groupBy("prediction").count().collect()]
        if len(sizes) > 1 and (s := ClusteringEvaluator().evaluate(found)) > best[0]:
            p = np.array(sizes) / n
            best = (s, float(-(p * np.log(p)).sum()), k)
    rows.unpersist()
    return spark.createDataFrame([(best[1], best[2])], "entropy double, k long")


def _places(text: str) -> dict[str, int]:
    """Of each letter the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def indel_ratio(a: str, places: dict[str, int], n: int) -> float:
    """100 (1 - insertions and deletions / both lengths) of ``a`` and a text of ``n`` letters at ``places``.

    By the longest common subsequence, a row of its table at a time as the bits of one number.
    """
    if not a and not n:
        return 100.0
    every = open_ = (1 << n) - 1
    for c in a:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return 100.0 * 2 * (n - open_.bit_count()) / (len(a) + n)


def edit_similarity(df: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """Mean and std of the indel ratio of all pairs in a group of bounded size."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {y: _places(y) for y in set(b)}
        return pd.Series([indel_ratio(x, known[y], len(y)) for x, y in zip(a, b)])

    a = df.select(by, F.col(key).alias("_a"), F.col(text).alias("_x"))
    b = df.select(by, F.col(key).alias("_b"), F.col(text).alias("_y"))
    each = a.join(b, by).where("_a < _b").withColumn("r", ratio("_x", "_y"))
    return each.groupBy(by).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))


def _average_linkage(d: np.ndarray) -> list[tuple[int, int]]:
    """The merges of average linkage by rising distance, each as two members of the clusters; by chains of nearest neighbours, in the square of the rows."""
    d, n = d.astype(float).copy(), len(d)
    np.fill_diagonal(d, np.inf)
    size, live, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(live.argmax())]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((d[a, b], len(merges), a, b))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        live[b] = False
    return [(a, b) for _, _, a, b in sorted(merges)]


def _best_cut(d: np.ndarray, most: int) -> int:
    """How many clusters, from 2 to ``most``, have the best silhouette; of equal ones the most. 1 if none is above -1."""
    n, best = len(d), (-1.0, 1)
    label, left = np.arange(n), n
    for a, b in _average_linkage(d):
        if 2 <= left <= min(most, n - 1) and (s := _silhouette(d, label)) > best[0]:
            best = (s, left)
        label[label == label[b]] = label[a]
        left -= 1
    return best[1]


def text_clusters(df: DataFrame, by: str, key: str, text: str, most: int = 29) -> DataFrame:
    """Group, n: how many average-linkage clusters of Levenshtein distances (2 to ``most``) have the best silhouette; 1 if none.

    The distances of a group's pairs are Spark's; its matrix is held in one task, so groups are of bounded size (the responses to one
    prompt, a few thousand). Merges at equal distances may come in any order.
    """

    def run(group: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.concatenate([pairs["a"].to_numpy(), pairs["b"].to_numpy()]), return_inverse=True)
        i, j = np.split(at, 2)
        d = np.zeros((len(keys), len(keys)))
        d[i, j] = d[j, i] = pairs["distance"].to_numpy()
        return pd.DataFrame([(group[0], _best_cut(d, most))], columns=[by, "n"])

    kind = dict(df.dtypes)[by]
    a = df.select(by, F.col(key).alias("a"), F.col(text).alias("_x"))
    b = df.select(by, F.col(key).alias("b"), F.col(text).alias("_y"))
    pairs = a.join(b, by).where("a < b").select(by, "a", "b", F.levenshtein("_x", "_y").alias("distance"))
    found = pairs.groupBy(by).applyInPandas(run, f"{by} {kind}, n long")
    return df.select(by).distinct().join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(1)))  # a text alone has no pair


def levenshtein_pairs(df: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """A, b, distance of the pairs of each group of bounded size."""
    a = df.select(by, F.col(key).alias("a"), F.col(text).alias("_x"))
    b = df.select(by, F.col(key).alias("b"), F.col(text).alias("_y"))
    return a.join(b, by).where("a < b").select("a", "b", F.levenshtein("_x", "_y").cast("long").alias("distance"))


def grouped_metrics(df: DataFrame, metric: str) -> DataFrame:
    """Mean, std and n overall, by status, by depth and by both; rows without the metric do not count."""
    view = df.where(F.col(metric).isNotNull())
    sets = [[], [F.col("status")], [F.col("depth")], [F.col("depth"), F.col("status")]]
    return view.groupingSets(sets, F.col("status"), F.col("depth")).agg(
        F.grouping_id().cast("long").alias("level"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count("*").alias("n")
    )


def side_by_side(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide metrics as rows: key, metric, value."""
    return df.unpivot([key], columns, "metric", "value")


def digit_distribution(df: DataFrame, by: str, token: str, weight: str) -> DataFrame:
    """Entropy and excess kurtosis over the ten digits' renormalised weights, absent ones zero."""
    spark = df.sparkSession
    digits = spark.range(10).select(F.col("id").cast("string").alias(token))
    sums = df.where(F.col(token).rlike("^[0-9]$")).groupBy(by, token).agg(F.sum(weight).alias("w"))
    frame = sums.select(by).distinct().crossJoin(F.broadcast(digits))  # ten rows
    p = F.col("w") / F.sum("w").over(Window.partitionBy(by))
    full = frame.join(sums, [by, token], "left").withColumn("w", F.coalesce("w", F.lit(0.0))).withColumn("p", p)
    return full.groupBy(by).agg((-F.sum(F.col("p") * F.log(F.col("p") + EPS))).alias("entropy"), F.kurtosis("p").alias("kurtosis"))


def in_top(df: DataFrame, by: str, item: str, prob: str, gold: str, n: int = 3) -> DataFrame:
    """Whether each group's gold item is among its ``n`` largest non-zero probabilities."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(prob), item))
    ranked = df.where(F.col(prob) > 0).withColumn("_r", rank)
    return ranked.groupBy(by).agg(F.max((F.col("_r") <= n) & (F.col(item) == F.col(gold))).alias("hit"))


def method_report(df: DataFrame, by: str) -> DataFrame:
    """U16: accuracy, top-3 accuracy, mean and std of entropy by method (columns: right, top3, entropy)."""
    return df.groupBy(by).agg(
        F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg(F.col("top3").cast("double")).alias("top3"),
        F.avg("entropy").alias("entropy"), F.stddev_pop("entropy").alias("entropy_std"), F.count("*").alias("n"),
    )


def resumed_after(df: DataFrame, key: str, order: str, n: int, last: object) -> DataFrame:
    """The rows after the first ``n`` in order; an error unless row n has the key ``last``."""
    if not n:
        return df
    head = df.orderBy(order).limit(n).agg(F.max_by(key, order), F.max(order)).first()
    if head[0] != last:
        raise ValueError(f"row {n} is {head[0]!r}, not {last!r}")
    return df.where(F.col(order) > head[1])


def dashboard(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean and std of each metric."""
    return df.groupBy(by).agg(*(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_pop))))


def complete(df: DataFrame, by: str, variant: str, variants: list[str]) -> DataFrame:
    """Rows of samples that have all the variants."""
    whole = df.where(F.col(variant).isin(*variants)).groupBy(by).agg(F.count_distinct(variant).alias("_n")).where(F.col("_n") == len(variants))
    return df.join(whole.select(by), by, "left_semi")



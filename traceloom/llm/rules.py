"""Quality rules: text statistics and a learned decision list, all in DataFrame expressions.

Sequential covering learns rules for the low-quality class from labelled statistics. A rule is a
conjunction of thresholds, grown by information gain on one part of the labelled rows and pruned on the other;
rows it covers leave before the next is grown. Only counts by (feature, bin, label) reach the driver.
The rules become one ordered conditional expression. No Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

BLANK = r"\x20\x09-\x0D"
WINDOW = 8

#: Statistics that rules may test, over the columns of ``statistics``.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the array."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        def marked(s: Column) -> Column:
            def twin(k: Column) -> Column:
                here = F.get(s, k)["h"]
                before = F.coalesce(F.get(s, k - 1)["h"] == here, F.lit(False))
                return before | F.coalesce(F.get(s, k + 1)["h"] == here, F.lit(False))

            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: F.get(s, k)["at"]))

        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        starts = F.element_at(F.transform(F.array(placed), marked), 1)
        state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            F.aggregate(starts, state, step, lambda s: s["n"])
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    slid = F.transform(
        F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    )
    return F.when(n >= WINDOW, F.element_at(F.transform(slid, covered), 1)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of each document's whole text, as longs; null text counts as empty, null doc_id as -1.

    n_words, word_chars (characters within words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with
    a word that equal an earlier one), n_repeat_words (``repeated_window_words``), and more for rules.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    cut = documents(docs).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(f"([^{BLANK}]+)"), 1).alias("words"), lines.alias("lines")
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length("text") - F.regexp_count("text", F.lit(f"[{BLANK}]")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_window_words(F.col("words")),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count("text", F.lit(r"[0-9]")),
        "n_bangs": F.regexp_count("text", F.lit(r"[!?]")),
        "n_stops": F.regexp_count("text", F.lit(r"[.]")),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return cut.select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, side, threshold in rule:
        value = F.expr(FEATURES[feature])
        out = out & ((value > threshold) if side == ">" else (value <= threshold))
    return out


def learn(stats: DataFrame, labels: DataFrame, bins: int = 24, most_rules: int = 8, most_tests: int = 3, precision: float = 0.9) -> list[Rule]:
    """Ordered rules for label 0, from the statistics of labelled documents (``labels``: doc_id, quality).

    Without labels of both kinds there are no rules. Unlabelled rows and null labels do not count.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    )
    names = list(FEATURES)
    joined = stats.join(known, "doc_id").select(
        (F.col("quality") == 0).alias("low"),
        (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) == 0).alias("prune"),
        *(F.expr(FEATURES[f]).alias(f) for f in names),
    )
    rows = written(joined, "rules")
    marks = rows.agg(
        *(F.percentile_approx(f, [i / bins for i in range(1, bins)], 2000).alias(f) for f in names),
        F.count_if("low").alias("lows"),
        F.count_if(~F.col("low")).alias("highs"),
    ).first()
    if not marks["lows"] or not marks["highs"]:
        return []
    cuts = {f: sorted(set(marks[f])) for f in names}

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for feature, side, threshold in rule:
            out = out & ((F.col(feature) > threshold) if side == ">" else (F.col(feature) <= threshold))
        return out

    def binned(part: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
        each = [
            F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias("bin")) for f in names
        ]
        counted = part.select("low", F.explode(F.array(*each)).alias("x")).groupBy("x.f", "x.bin")
        return {(r.f, r.bin): (r.p, r.n) for r in counted.agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()}

    rules: list[Rule] = []
    for _ in range(most_rules):
        left = rows.where(~_any([holds(r) for r in rules]))
        rule: Rule = []
        for _ in range(most_tests):
            table = binned(left.where(~F.col("prune") & holds(rule)))
            all_p = sum(v[0] for k, v in table.items() if k[0] == names[0])
            all_n = sum(v[1] for k, v in table.items() if k[0] == names[0])
            if not all_p or not all_n:
                break
            base, best = math.log2(all_p / (all_p + all_n)), (1e-9, None)
            for f in names:
                p = n = 0
                for k, threshold in enumerate(cuts[f]):
                    more = table.get((f, k), (0, 0))
                    p, n = p + more[0], n + more[1]
                    for side, a, b in (("<=", p, n), (">", all_p - p, all_n - n)):
                        if a:
                            gain = a * (math.log2(a / (a + b)) - base)
                            if gain > best[0]:
                                best = (gain, (f, side, threshold))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = left.where("prune").agg(
            *(F.count_if(F.col("low") & holds(rule[:k])).alias(f"p{k}") for k in range(1, len(rule) + 1)),
            *(F.count_if(~F.col("low") & holds(rule[:k])).alias(f"n{k}") for k in range(1, len(rule) + 1)),
        ).first()
        worth = {k: (held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (worth[k], -k))
        if held[f"p{k}"] < precision * (held[f"p{k}"] + held[f"n{k}"]) or not held[f"p{k}"]:
            break
        rules.append(rule[:k])
    return rules


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def verdict(rules: list[Rule]) -> Column:
    """False where a rule holds, tried in order; true where none does."""
    out = F
    for rule in rules:
        out = out.when(_holds(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``statistics`` of every row of ``docs`` plus base_failed and kept (by the rules learned, false where the base fails)."""
    stats = written(statistics(docs), "statistics")
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))

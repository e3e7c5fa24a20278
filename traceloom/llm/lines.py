"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, A-Z in lower case. A run holds a row for each key hash it
has met: in how many documents, and the largest doc_id. Runs are written in buckets of the hash, sorted
inside, so that a batch merges with them bucket by bucket, without a shuffle of the runs. Each new batch is
merge-anti-joined with the runs: keys that some run already settles (found in enough documents) add nothing more,
the others are written as a run of level 0. Where a level holds ``fanout`` runs, they are compacted into one of the
next level. Documents come in batches of falling doc_id, so the largest doc_id of a settled key is settled too.
"""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, STRING, discard, documents, free_name, schema, shared_dir, written

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: str, least_chars: int) -> bytes | None:
    """The key of a line in UTF-8, None where it has fewer than ``least_chars`` code points."""
    key = line.strip(BLANKS)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least_chars else None  # of bytes, lower() takes A-Z alone


def line_keys(docs: DataFrame, least_chars: int, edges: list[int]) -> DataFrame:
    """h1, h2 (XXH64 of the key with two seeds), doc_id, salt (crc32 of the text), batch (0: doc_id above all ``edges``); a row for each line with a key."""
    batch = F.lit(len(edges))
    for edge in edges:
        batch = batch - (F.col("doc_id") > edge).cast("int")
    split = documents(docs).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("salt"), F.explode(F.split("text", "\n")).alias("line"))
    key = F.translate("key", ascii_uppercase, ascii_lowercase)
    trimmed = split.select("doc_id", "salt", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= least_chars)
    return trimmed.select("doc_id", "salt", batch.alias("batch"), key.alias("key")).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "salt", "batch"
    )


class LineRuns:
    """Levels of sorted runs: h1, h2, n (documents), last (largest doc_id).

    Batches must not share a doc_id, and come in falling order of doc_id where ``last`` of keys in ``enough``
    documents or more has to be the largest. Batches and runs may be empty.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 4):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        """``run``, already dealt to the buckets, as a table that knows its buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        place = f"{shared_dir(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", place).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _dealt(self, run: DataFrame) -> DataFrame:
        return run.repartition(self.buckets, *KEY)

    def add(self, keys: DataFrame) -> None:
        """A batch of h1, h2, doc_id: what no run settles becomes a run."""
        new = self._dealt(keys.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))
        for name in self.names():
            new = new.join(self.spark.table(name).where(F.col("n") >= self.enough).select(*KEY).hint("merge"), KEY, "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) == self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged(old), level + 1)
        self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        # read as files: Spark 4.1 takes a union of bucketed tables for dealt to buckets even where it reads them otherwise
        runs = self.spark.read.schema("h1 long, h2 long, n long, last long").parquet(*(f"{shared_dir(self.spark)}/{name}" for name in names))
        return self._dealt(runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self) -> DataFrame:
        """All runs as one: h1, h2, n, last."""
        return self._merged(self.names())

    def _drop(self, names: list[str]) -> None:
        for name in names:
            run = self.spark.table(name)
            self.spark.sql(f"drop table {name}")
            discard(run)

    def close(self) -> None:
        """Drops all runs."""
        self._drop(self.names())
        self.levels = []


def without_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with its texts less their common lines, plus ``_lines`` and ``_dropped`` (how many there were and went).

    A key of at least ``least_chars`` code points that stands in at least ``least_docs`` documents keeps its lines
    only in the largest doc_id that holds it: all of them there. Rows with equal doc_id are one document; null ids read as
    -1. A null or empty text is one empty line, and the text returned is then empty; a text that loses all lines is
    empty too. Texts are taken whole, however long. An empty table gives an empty one. All other columns are kept,
    whatever their names: an added one that is taken gets underscores before it.

    Documents go through the runs in ``batches`` batches of falling doc_id. Two hashes of 64 bits stand for keys; in a
    document one of them is compared with those the document has to lose.
    """
    spark = docs.sparkSession
    marks = documents(docs).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(m) for m in marks})
    keys = written(line_keys(docs, least_chars, edges), "line-keys", by=["batch"])
    runs = LineRuns(spark, least_docs, fanout)
    for k in range(len(edges) + 1):
        runs.add(keys.where(F.col("batch") == k))
    common = written(runs.merged().where(F.col("n") >= least_docs).select(*KEY, "last"), "common-lines")
    runs.close()
    # what a document loses follows from its doc_id alone; the salt keeps the lists of rows with equal ids apart
    hits = keys.join(common, KEY).where("doc_id != last").groupBy("doc_id", "salt").agg(F.collect_set("h1").alias("_hits"))
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")  # so that no name of theirs meets one of ours
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.crc32(text.cast("binary")).alias("salt"), text.alias("_text"))
    joined = keyed.join(hits, ["doc_id", "salt"], "left")

    @F.pandas_udf(schema(("text", STRING), ("dropped", LONG)))
    def cut(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for text, hit in zip(texts, hits):
            if hit is None:
                rows.append((None, 0))
                continue
            found, lines = {h & (1 << 64) - 1 for h in hit.tolist()}, text.split("\n")
            kept = [line for line in lines if (key := line_key(line, least_chars)) is None or xxhash.xxh64_intdigest(key, 42) not in found]
            rows.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "dropped"])

    hit_text = F.when(F.col("_hits").isNotNull(), F.col("_text"))  # others need not go to Python
    done = joined.select("row", "_text", cut(hit_text, "_hits").alias("_cut"))
    n_lines = F.size(F.split("_text", "\n"))
    return done.select(
        *(F.coalesce("_cut.text", "_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names),
        n_lines.cast("long").alias(free_name(docs, "_lines")), F.col("_cut.dropped").alias(free_name(docs, "_dropped")),
    )

"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import language, mixing, packing, simhash, spans
from traceloom.llm.common import discard, shared_dir
from traceloom.llm.queries import MIX_WEIGHTS

#: In rows and, where texts are long, in bytes. A stage called by itself leaves these in the session; ``run`` puts back what was there.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _small_batches(spark: SparkSession) -> None:
    """Stages share their executors' Python workers: batches of whole texts stay small, and what a task no longer needs goes back to the system."""
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_TRIM_THRESHOLD_", "1000000"), ("MALLOC_ARENA_MAX", "1")):
        spark.sparkContext.environment.setdefault(name, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, ``lang`` set to the one predicted; those without a letter are rejected.

    Rows are judged one by one, so null and repeated ids, null columns and extra ones change nothing. Without
    any row that has a ``lang``, nothing is learned and all are rejected.
    """
    _small_batches(spark)
    return language.accepted(docs, language.train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles or more): the one with the smallest id."""
    _small_batches(spark)
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of spans of sentences; documents with nothing left go."""
    _small_batches(spark)
    cut = spans.without_repeated_spans(docs, run=None)
    removed = F.col(cut.columns[-1])
    cut = cut.where((removed == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as are left, drawn to the target shares in at most two epochs."""
    _small_batches(spark)
    return mixing.mix(docs, MIX_WEIGHTS, epochs=2).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {key: spark.conf.get(key, None) for key in SMALL_BATCHES}
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            last, docs = docs, spark.read.parquet(f"{at}/{k}")
            if k:
                discard(last)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return docs

"""JSON and text in and out."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.json import is_json


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, n: int | None = None) -> DataFrame:
    """Whole, or ``n`` rows; an error if there are fewer."""
    df = spark.read.schema(schema).json(path)
    if n is None:
        return df
    if df.limit(n).count() < n:
        raise ValueError(f"{path} has fewer than {n} rows")
    return df.limit(n)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of each file as one JSON document (an object, or a list of them), or as JSON Lines, file by file.

    A file whose first line with text is JSON by itself holds JSON Lines; so does one that is no document as a whole. Of JSON
    Lines, the good lines are rows; ``bad_lines`` gives the others. Values that don't fit the schema are null in a document.
    """
    names = [f.name for f in schema.fields]
    documents, lines = _kinds_of_files(spark, path)
    rows = _lines(spark, lines, schema).where("_bad is null").select(*names)
    if documents:
        rows = rows.unionByName(spark.read.schema(schema).option("multiLine", True).json(documents))
    return rows


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """line: those of JSON Lines that are no JSON or don't fit the schema."""
    return _lines(spark, _kinds_of_files(spark, path)[1], schema).where("_bad is not null").select(F.col("_bad").alias("line"))


def _kinds_of_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files of one document each, files of JSON Lines); the driver lists files anyway."""

    def plain(uri: str) -> str:
        return re.sub(r"([\[\]{}*?])", r"\\\1", unquote(uri))  # these are patterns in paths

    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value").where(F.trim("value") != "")
    first = text.groupBy("file").agg(F.min_by("value", "at").alias("value")).select("file", (~is_json(F.col("value"))).alias("more")).collect()
    lines, whole = ([plain(r.file) for r in first if r.more == more] for more in (False, True))
    if whole:
        texts = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        broken = {plain(r.file) for r in texts.where(~is_json(F.col("value"))).select("file").collect()}
        lines, whole = lines + sorted(broken), [f for f in whole if f not in broken]
    return whole, lines


def _lines(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    both = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    if not files:
        return spark.createDataFrame([], both)
    parsed = F.from_json("value", both, {"columnNameOfCorruptRecord": "_bad"})
    listed = F.from_json("value", T.ArrayType(T.StructType(schema.fields)))  # a line may hold a list of rows
    good = F.transform(listed, lambda x: F.struct(*(x[f.name].alias(f.name) for f in schema.fields), F.lit(None).cast("string").alias("_bad")))
    bad = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), F.col("value").alias("_bad"))
    is_list = F.ltrim("value").startswith("[")
    rows = F.when(is_list & listed.isNotNull(), good).when(is_list, F.array(bad)).otherwise(F.array(parsed))
    return spark.read.text(files).where(F.trim("value") != "").select(F.inline(rows))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 within the file), line."""
    return numbered_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file", "value")


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """file, line_no, line from a table that holds a text in each row."""
    return df.select(F.col(key).alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(
        "file", (F.col("line_no") + 1).cast("long").alias("line_no"), "line"
    )


def read_tree(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.{json,jsonl}") -> DataFrame:
    """All JSON files below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def as_document(df: DataFrame, key: str, value: str, most: int = 1_000_000) -> DataFrame:
    """``document``: one JSON object of a bounded table, keys in order."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entries do not belong in one document; use write_jsonl")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("document"))


def write_document(df: DataFrame, key: str, value: str, path: str) -> None:
    as_document(df, key, value).coalesce(1).write.mode("overwrite").text(path)

"""Tables made from nested or loosely written sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.ordering import global_row_number, seeded


def flag_table(rules: DataFrame) -> DataFrame:
    """package, ordinal, flag, dir, alias from (package, rules: array of "-R dir Alias"); only -R and -Q stay."""
    each = rules.select("package", F.posexplode("rules").alias("ordinal", "rule")).withColumn("part", F.split(F.trim("rule"), r"\s+"))
    return each.select(
        "package", F.col("ordinal").cast("long").alias("ordinal"), F.get("part", 0).alias("flag"), F.get("part", 1).alias("dir"), F.get("part", 2).alias("alias")
    ).where(F.col("flag").isin("-R", "-Q"))


def tolerant_json(text: Column, schema: T.StructType) -> Column:
    """Strict JSON, else a relaxed dialect (single quotes, bare names), else null."""
    names = [f.name for f in schema.fields]
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])

    def parsed(**options: str) -> Column:
        out = F.from_json(text, bad, {"columnNameOfCorruptRecord": "_bad", **options})
        return F.when(out["_bad"].isNull() & text.isNotNull(), F.struct(*(out[n].alias(n) for n in names)))

    strict = parsed(allowSingleQuotes="false", allowUnquotedFieldNames="false")
    loose = parsed(allowSingleQuotes="true", allowUnquotedFieldNames="true", allowBackslashEscapingAnyCharacter="true")
    return F.coalesce(strict, loose)


def encode_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def decode_list(text: Column, kind: str = "double") -> Column:
    """"1.0,2.0" to an array; an empty text is an empty array."""
    return F.when(text == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x).cast(kind)))


def contiguous_shards(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """``df`` with ``shard``: n runs of equal length by key, the remainder in the last."""
    numbered = global_row_number(df, key, *ties)
    size = max(1, numbered.count() // n)
    return numbered.withColumn("shard", F.least(F.floor((F.col("rn") - 1) / size), F.lit(n - 1)).cast("long")).drop("rn")


def shuffled_shards(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """As ``contiguous_shards``, in seeded order."""
    return contiguous_shards(df.withColumn("_order", seeded(seed, key)), "_order", n, key).drop("_order")


def split_log(lines: DataFrame, header: str, subset: DataFrame | None = None) -> DataFrame:
    """Groups of lines under header lines: adds ``part`` (from 1) and ``path``, the header's first group.

    Lines before the first header go. ``subset``: a table of paths; only these groups stay.
    """
    over = Window.partitionBy("file").orderBy("line_no")
    path = F.regexp_extract("line", header, 1)
    is_header = F.col("line").rlike(header)
    out = (
        lines.withColumn("part", F.sum(F.when(is_header, 1).otherwise(0)).over(over))
        .withColumn("path", F.last(F.when(is_header, path), ignorenulls=True).over(over))
        .where("part > 0")
    )
    return out if subset is None else out.join(subset.select("path").distinct(), "path", "left_semi")

"""Registered queries: name -> callable(spark, sf_dir), and the equivalent SQL where there is one.

Modules of this package register their queries on import, in the order of the operator groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "u12_grouping_sets"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of ``documents`` for the SQL side: file, line_no from 1, line.
LINES_SQL = (
    "(select doc_id as file, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line"
    " from (select doc_id, string_split(text, chr(10)) as l from documents))"
)


def load() -> None:
    from traceloom.plans import (  # noqa: F401
        clarity, retrieval, runlog, sources, streams, text, traces, training, uncertainty, vocabulary,
    )

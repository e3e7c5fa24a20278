"""JSON texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; a null or blank one is not.

    Spark's parsers stop after the first value. In brackets, what follows it must end the list.
    """
    return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1, F.lit(False)) & (F.trim(text) != "")

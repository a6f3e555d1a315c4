"""Joins that treat null keys as equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` on ``key``; a null key meets a null key. ``table`` shares no other column name."""
    return rows.join(table.withColumnRenamed(key, "_lookup"), F.col(key).eqNullSafe(F.col("_lookup")), how).drop("_lookup")

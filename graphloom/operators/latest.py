"""The row that holds for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the one greatest in order, null being the least; ties go to the greatest of the other columns.

    Rows with a null key form one group, as in SQL. Only keys, order and columns are read and returned. It is one
    aggregation with map-side combination, so a key with very many rows costs no more than others.
    """
    rest = [c for c in dict.fromkeys([*order, *columns]) if c not in keys]
    held: Column = F.max(F.struct(*rest)).alias("_held")
    out = df.groupBy(*keys).agg(held)
    return out.select(*keys, *[F.col(f"_held.{c}").alias(c) for c in rest])

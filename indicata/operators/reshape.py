"""Pivot values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of ``column`` (nulls first).

    They become the column names of a wide table, so the driver holds them
    in any case; the distinct runs distributed with map-side dedup.  Tables
    with more names than a schema should hold stay in long form.
    """
    rows = (df.select(F.col(column).alias("v")).distinct()
              .orderBy(F.col("v").asc_nulls_first()).collect())
    return [r["v"] for r in rows]

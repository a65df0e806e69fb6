"""Row counts by metadata columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.profile import DEFAULT_PROFILE, ColumnProfile


def _sorted_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(*[F.col(c).asc_nulls_first() for c in [*keys, "count"]])


def datamap(df: DataFrame, source_metadata_columns, indicator_metadata_columns=()) -> DataFrame:
    """One row per metadata group with its row ``count``.

    A null key is a group of its own.  Sorted by the group columns, then by
    count, ascending with nulls first.  Partial aggregation runs map-side,
    so a hot group costs one row per task before the shuffle.
    """
    return _sorted_counts(df, [*source_metadata_columns, *(indicator_metadata_columns or ())])


def dt_map(df: DataFrame, code: bool = True, profile: ColumnProfile = DEFAULT_PROFILE) -> DataFrame:
    """Value counts of the profile's source columns (and the indicator code).

    Columns the table lacks are ignored; rows with a null in any counted
    column are dropped before counting.
    """
    roles = profile.source_metadata_columns + profile.indicator_metadata_columns[:1] * code
    present = profile.present(df, roles)
    return _sorted_counts(df.select(*present).dropna(how="any"), present)

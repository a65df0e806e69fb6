"""Per-indicator statistics (C5) and null-aware distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.expressions import n_unique, quote
from indicata.operators.order_stats import exact_quantiles

STAT_KEYS = ("source", "collection", "indicator_label")

BASE_STAT_COLUMNS = (
    "count_rows", "count_missing_value", "num_countries_with_data",
    "num_years_with_data", "mean_value", "median_value", "min_value",
    "max_value", "iqr_value", "min_year", "max_year", "pct_missing_value",
)


def observation_cells(df: DataFrame, keys=STAT_KEYS) -> DataFrame:
    """One row per (keys, sub-region, country, year): row and value counts,
    sum and extremes of the values.

    Everything but the quantiles of C4-C7 follows from it, so the table
    itself is scanned once.  The number of rows is bounded by the domain
    (groups x countries x years), not by the observations, and the partial
    aggregate runs map-side.  Extremes skip NaN (Spark would return it as the
    largest double).
    """
    places = [c for c in ("sub_region_name", "country", "year") if c in df.columns]
    return df.groupBy(*keys, *places).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"),
        F.sum("value").alias("total"),
        F.expr("min(value) FILTER (WHERE NOT isnan(value))").alias("least"),
        F.expr("max(value) FILTER (WHERE NOT isnan(value))").alias("most"))


def base_stats(df: DataFrame, keys=STAT_KEYS, sort: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """One row per (source, collection, indicator_label) with 12 measures.

    Counts, mean, extremes, spans and the two distinct counts (a null country
    or year counts as a value) are one aggregate over ``cells``
    (``observation_cells`` of the same table; made here if not given).
    Median and nearest-rank quartiles come from the exact order-statistics
    operator, never a whole hot group in one task.  The two meet in a union
    and an aggregate on the keys: null keys group natively and no join is
    needed.  Sorted by the keys.
    """
    keys = list(keys)
    cells = observation_cells(df, keys) if cells is None else cells
    has_value = F.col("n_values") > 0
    year = F.when(has_value, F.col("year"))
    null_year = F.coalesce(F.max((has_value & F.col("year").isNull()).cast("int")), F.lit(0))
    stats = cells.groupBy(*keys).agg(
        F.sum("n_rows").alias("count_rows"),
        F.sum(F.col("n_rows") - F.col("n_values")).alias("count_missing_value"),
        n_unique(F.col("country")).alias("num_countries_with_data"),
        (F.count_distinct(year) + null_year).alias("num_years_with_data"),
        F.try_divide(F.sum("total"), F.sum("n_values")).alias("mean_value"),
        F.min("least").alias("min_value"), F.max("most").alias("max_value"),
        F.min(year).alias("min_year"), F.max(year).alias("max_year"))
    quart = exact_quantiles(df.select(*keys, "value"), keys, "value", {
        "m": (0.5, "midpoint"), "a": (0.25, "nearest"), "b": (0.75, "nearest")})
    quart = quart.selectExpr(*[quote(k) for k in keys], "m AS median_value", "b - a AS iqr_value")
    merged = stats.unionByName(quart, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in BASE_STAT_COLUMNS[:-1]])
    out = merged.withColumn("pct_missing_value",
                            F.try_divide(F.col("count_missing_value"), F.col("count_rows")) * 100)
    return out.orderBy(*[F.col(k).asc_nulls_first() for k in keys]) if sort else out

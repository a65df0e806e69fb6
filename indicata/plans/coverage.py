"""Sub-region totals (C4), coverage (C6) and its colour scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.expressions import coverage_color, n_unique, quote
from indicata.operators.reshape import distinct_values


def sub_region_info(df: DataFrame) -> DataFrame:
    """C4: per sub-region, the number of countries and their sorted list.

    Pairs with a null country or sub-region are dropped.  The list per
    sub-region is bounded by the number of distinct countries.
    """
    pairs = df.select("country", "sub_region_name").distinct().dropna(how="any")
    return pairs.groupBy("sub_region_name").agg(
        F.count(F.lit(1)).alias("total_countries"),
        F.sort_array(F.collect_list("country")).alias("countries"))


def clean_name(region: str) -> str:
    return region.replace(" ", "_")


def region_names(info: DataFrame) -> list[str]:
    """Sorted sub-region names: collected to the driver, as they name columns."""
    names = distinct_values(info, "sub_region_name")
    cleaned = [clean_name(n).lower() for n in names]
    if len(set(cleaned)) != len(cleaned):
        raise ValueError("two sub-regions have the same name once spaces become '_' and case is ignored")
    return names


def coverage_long(df: DataFrame, info: DataFrame) -> DataFrame:
    """Per (indicator_label, sub_region_name): % of the region's countries
    with at least one value, rounded half-even to 3 places.

    The numerator counts a null country as a value (so it may exceed 100).
    A sub-region without a total (a null one) has a null ``pct``: it has no
    column in the wide table, but its row keeps the label there.
    """
    return coverage_of(df.where(F.col("value").isNotNull()), info)


def coverage_of(with_value: DataFrame, info: DataFrame) -> DataFrame:
    """``coverage_long`` of rows (or cells of rows) that have a value."""
    cov = (with_value.groupBy("indicator_label", "sub_region_name")
           .agg(n_unique(F.col("country")).alias("countries_with_data")))
    totals = info.select("sub_region_name", "total_countries")
    return (cov.join(totals, "sub_region_name", "left")
               .select("indicator_label", "sub_region_name",
                       F.bround(F.col("countries_with_data") / F.col("total_countries") * 100, 3)
                        .alias("pct")))


def coverage_wide(long: DataFrame, regions: list[str]) -> DataFrame:
    """Long coverage -> one row per label, ``pct_coverage_<region>`` columns
    (explicit value list, so Spark runs no extra distinct job); a region
    without values for a label gets 0."""
    wide = long.groupBy("indicator_label").pivot("sub_region_name", regions).agg(F.max("pct"))
    cols = [f"coalesce({quote(r)}, 0D) AS {quote('pct_coverage_' + clean_name(r))}"
            for r in regions]
    return wide.selectExpr("indicator_label", *cols)


def sub_region_coverage(df: DataFrame, info: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Coverage per indicator label and sub-region, sorted by label.

    ``cells`` (``kept_cells`` of the same table) are read in place of ``df``.
    """
    info = sub_region_info(df if cells is None else cells) if info is None else info
    regions = region_names(info)
    long = coverage_long(df, info) if cells is None else coverage_of(cells.where("n_values > 0"), info)
    return coverage_wide(long, regions).orderBy(F.col("indicator_label").asc_nulls_first())


def coverage_colors(coverage: DataFrame) -> DataFrame:
    """Add ``color_<region>`` (rgb text) for every ``pct_coverage_`` column."""
    pct_cols = [c for c in coverage.columns if c.startswith("pct_coverage_")]
    return coverage.select(
        *[F.col(quote(c)) for c in coverage.columns],
        *[coverage_color(F.col(quote(c))).alias("color_" + c[len("pct_coverage_"):])
          for c in pct_cols])

"""Indicator metadata with a completeness score (C7, the flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.expressions import quote, row_mean_sql
from indicata.plans.coverage import (clean_name, coverage_of, coverage_wide, region_names,
                                     sub_region_info)
from indicata.plans.stats import base_stats, observation_cells
from indicata.session import checkpoint_dir


def indicators_metadata(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Base statistics + sub-region coverage + ``completeness_score``.

    score = (temporal + geographic) / 2, where temporal is the share of
    years with data in the observed span (0 when there is none) and
    geographic the mean of the rounded sub-region coverages.  A label with
    no value at all has no coverage row, so its score is null; it sorts
    first (descending, nulls first).

    Plan: one scan of the table for the cells (``observation_cells``), which are
    checkpointed in the shared folder, and two for the quantiles.  ``cells`` of the
    same table that are stored already (``kept_cells``) save the first.
    Statistics, coverage, sub-region totals and the sub-region names (which
    name the pivot columns) all read the cells.  Every branch is one row per
    group before it meets another, so nothing proportional to the data is
    joined.  The checkpoint, the names and the quantiles' own checkpoint run
    as jobs at call time.
    """
    if cells is None:
        checkpoint_dir(df.sparkSession)
        cells = observation_cells(df).checkpoint(eager=True)
    info = sub_region_info(cells)
    regions = region_names(info)
    base = base_stats(df, sort=False, cells=cells)
    wide = coverage_wide(coverage_of(cells.where("n_values > 0"), info), regions)
    pct_cols = [f"pct_coverage_{clean_name(r)}" for r in regions]
    joined = base.join(wide, "indicator_label", "left")
    temporal = ("coalesce(try_divide(cast(num_years_with_data AS double), "
                "cast(max_year - min_year + 1 AS double)) * 100, 0D)")
    out = joined.selectExpr(
        *[quote(c) for c in base.columns], *[quote(c) for c in pct_cols],
        f"({temporal} + {row_mean_sql(pct_cols)}) / 2 AS completeness_score")
    return out.orderBy(F.col("completeness_score").desc_nulls_first())

"""Entry points under the names users of the original notebooks know.

Each is a ``DataFrame -> DataFrame`` function, so results can be chained,
filtered further, written with any Spark sink, or shown.  Nothing is collected
except the names of new columns.  Jobs run at call time only where a checkpoint
or those names are needed: quantiles (``calculate_base_stats``, ``describe``),
coverage, metadata, and pivots without ``values``.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.plans import checks, coverage, datamap as _datamap, kept_cells as _kept, metadata, metrics, pivot, stats
from indicata.profile import DEFAULT_PROFILE, ColumnProfile
from indicata.sources.parquet import load_obt, read_csv, read_parquet, write_csv

# C1, S1/S2, S4
load = load_obt
read = read_parquet
from_csv = read_csv
to_csv = write_csv

# C2, C15
datamap = _datamap.datamap
dt_map = _datamap.dt_map

# C3, C16, F8
filter_pivot = pivot.filter_pivot
src_tbl = pivot.src_tbl
first_cells = pivot.first_cells
first_maps = pivot.first_maps
select_collections = pivot.select_collections

# C4-C7, C18
get_sub_region_info = coverage.sub_region_info
calculate_base_stats = stats.base_stats
calculate_sub_region_coverage = coverage.sub_region_coverage
style_sub_region_coverage = coverage.coverage_colors
create_indicators_metadata = metadata.indicators_metadata
kept_cells = _kept.kept_cells
forget_cells = _kept.forget_cells

# C8-C13, I1-I5
income_check = checks.income_check
income_distribution = checks.income_distribution
null_income_count = checks.null_income_count
null_income_countries = checks.null_income_countries
top_indicators = checks.top_indicators
rank_groups = checks.rank_groups
shape = checks.shape
schema = checks.schema_table
describe = checks.describe
info = checks.info

# I6
plan_metrics = metrics.plan_metrics
row_flow = metrics.row_flow
observe = metrics.observe


def metadata_distinct_counts(df: DataFrame, profile: ColumnProfile = DEFAULT_PROFILE) -> DataFrame:
    """C12 over the profile's metadata columns; one the table lacks is an error."""
    return checks.distinct_counts(df, profile.metadata_columns, profile.metadata_groups)


def select_present(df: DataFrame, cols) -> DataFrame:
    """Select the listed columns the table has, ignoring the others."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def describe_src(df: DataFrame, ind: str = "code") -> DataFrame:
    """C17: ``src_tbl(df, ind).describe()`` as one row per indicator column."""
    col = pivot.indicator_column(ind)
    return checks.describe_cells(pivot.src_cells(df, ind), col)


def info_src(df: DataFrame, ind: str = "code") -> DataFrame:
    """C17: ``src_tbl(df, ind).info()`` as (column, non_null_count, dtype)."""
    col = pivot.indicator_column(ind)
    return checks.info_cells(pivot.src_cells(df, ind), col)


def inspect(df: DataFrame, mode: str = "formatted") -> str:
    """The query plan as text (Spark's ``explain``), without running it."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def observe_rows(df: DataFrame, name: str):
    """Attach a row-count metric filled in when an action runs.

    Returns ``(df, observation)``; read ``observation.get`` after the action.
    """
    return metrics.observe(df, name, rows=F.count(F.lit(1)))


def session(master: str | None = None, **kw) -> SparkSession:
    from indicata.session import build_session

    return build_session(master, **kw)

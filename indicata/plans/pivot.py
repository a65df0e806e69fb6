"""Long -> wide pivots (C3, C14, C16) and the selection semi-join (F8)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from indicata.functions.expressions import quote
from indicata.operators.reshape import distinct_values
from indicata.sources.parquet import ROW_ORDER, with_row_order

INDEX = ("country", "year")
_FIRST = -(1 << 63)  # the smallest long


def indicator_column(ind: str) -> str:
    if ind not in ("code", "label"):
        raise ValueError("ind must be 'code' or 'label'")
    return "indicator_code" if ind == "code" else "indicator_label"


def _check_names(df: DataFrame, values: list) -> None:
    """Reject indicators whose columns could not be told apart by name."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    seen: dict[str, str] = {c: c for c in INDEX}
    for name in ("null" if v is None else str(v) for v in values):
        key = name if exact else name.lower()
        if key in seen:
            raise ValueError(f"columns {seen[key]!r} and {name!r} have the same name in a wide table"
                             + ("" if exact else " (set spark.sql.caseSensitive to tell case apart)")
                             + "; first_cells and src_cells keep them apart")
        seen[key] = name


def _columns(df: DataFrame, ind_col: str, values: list | None) -> list:
    """The indicators that become columns: ``values`` or all, told apart by name."""
    values = distinct_values(df, ind_col) if values is None else values
    _check_names(df, values)
    return values


def _pivot(df: DataFrame, ind_col: str, agg: Column, values: list) -> DataFrame:
    # An explicit value list: Spark runs no extra distinct job
    # and plans a two-phase aggregate (per index+indicator, then per index).
    return df.groupBy(*INDEX).pivot(ind_col, values).agg(agg)


def _ordered(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW_ORDER``: its own column, or the rows' places in the files it reads."""
    if ROW_ORDER in df.columns:
        return df
    try:
        return with_row_order(df)
    except AnalysisException as none:
        raise ValueError("the rows have no order: load the table with row_order=True, which joins keep, "
                         "or name order_cols") from none


def _first_value(df: DataFrame, cols: list, order_cols: list) -> tuple[DataFrame, Column]:
    """The columns that a first value needs, and its aggregate (``filter_pivot`` tells the order)."""
    if not order_cols:
        df, order_cols = _ordered(df), [ROW_ORDER]
    narrow = df.select(*dict.fromkeys([*cols, *order_cols]))
    if len(order_cols) == 1 and isinstance(narrow.schema[order_cols[0]].dataType, IntegralType):
        # one long keeps the aggregate hash based; a null order comes first
        return narrow, F.min_by("value", F.coalesce(F.col(order_cols[0]).cast("long"), F.lit(_FIRST)))
    # a struct keeps rows whose order columns are null (min_by skips a
    # null ordering); slower, as struct buffers need sort aggregation
    return narrow, F.min_by("value", F.struct(*order_cols))


def filter_pivot(df: DataFrame, index_cols, ind: str = "label", order_cols=None,
                 values: list | None = None) -> DataFrame:
    """One row per (country, year), one column per indicator.

    A cell holds the first value of its (country, year, indicator) in row
    order; ``order_cols`` define that order (a null value is kept, a null
    indicator gets the column ``null``).  Without ``order_cols`` the order is
    that of the rows in the files read (file name, then position): the column
    ``ROW_ORDER`` that ``load_obt(row_order=True)`` adds and that joins keep, or
    the same found here where the frame reads files directly.  Both are one
    long, so the aggregate is a hash aggregate.  A frame without any order is
    an error.  ``values`` fixes the indicator columns; by default they are the
    sorted distinct indicators.  ``first_cells`` and ``first_maps`` hold the same
    values for more indicators than a table should have columns.
    """
    ind_col = indicator_column(ind)
    cols = [c.replace("indicator_label", "indicator_code") if ind == "code" else c
            for c in index_cols]
    if "value" not in cols or ind_col not in cols:
        raise ValueError("index columns must include the indicator and 'value'")
    values = _columns(df, ind_col, values)
    narrow, first = _first_value(df, cols, list(order_cols or []))
    return _pivot(narrow, ind_col, first, values)


def first_cells(df: DataFrame, ind: str = "label", order_cols=None) -> DataFrame:
    """The cells of ``filter_pivot`` in long form: (country, year, indicator, cell).

    No name goes through the driver and none becomes a column, so there is no
    limit on their number and names that differ by case alone, or a null beside
    the text ``null``, are kept apart.
    """
    ind_col = indicator_column(ind)
    narrow, first = _first_value(df, [*INDEX, ind_col, "value"], list(order_cols or []))
    return narrow.groupBy(*INDEX, ind_col).agg(first.alias("cell"))


def first_maps(df: DataFrame, ind: str = "label", order_cols=None) -> DataFrame:
    """The rows of ``filter_pivot`` with one map (indicator -> cell) in place of its columns.

    A map holds the indicators that its country and year have, so a sparse table
    stays small; its size is bounded by the number of indicators, not of rows, as
    cells are aggregated first.  A map has no null key: the cell of a null
    indicator is ``of_null`` (null also where there is none; ``first_cells`` tells them apart).
    """
    cells = first_cells(df, ind, order_cols)
    name = quote(indicator_column(ind))
    return cells.groupBy(*INDEX).agg(
        F.expr(f"map_from_entries(collect_list(struct({name}, cell)) FILTER (WHERE {name} IS NOT NULL))").alias("cells"),
        F.expr(f"max(cell) FILTER (WHERE {name} IS NULL)").alias("of_null"))


def select_collections(datamap_rows: DataFrame, obt: DataFrame, folders: bool = False, many: bool = False) -> DataFrame:
    """F8: keep the observations whose ``collection`` occurs in the chosen
    datamap rows (a left-semi join; null never matches).

    The chosen names, each once, are sent to every task, so no observation is
    shuffled and a hot collection stays spread over the tasks that read it.
    ``many`` is for more names than a task can hold: both sides are shuffled,
    and adaptive execution splits a hot collection.  With ``folders``,
    for a table that is stored with one folder per collection, the chosen names
    also reach the scan as a subquery, which runs with the query and before
    the scan, so that folders of other collections are not opened.  The list of
    names is no longer than that of the folders.
    """
    chosen = datamap_rows.select("collection").where(F.col("collection").isNotNull())
    if folders:
        names = chosen.agg(F.collect_set("collection")).scalar()
        obt = obt.where(F.array_contains(names, F.col("collection")))
    if many:  # without ``distinct`` there is no aggregate on the join's key, which would keep a hot partition whole
        return obt.join(chosen, "collection", "left_semi")
    # null-safe, though no chosen name is null: an equality would let the join skip folders, which is for ``folders`` to say
    same = F.col("o.collection").eqNullSafe(F.col("c.collection"))
    kept = obt.alias("o").join(F.broadcast(chosen.distinct()).alias("c"), same, "left_semi")
    return kept.select("collection", *[quote(c) for c in obt.columns if c != "collection"])


def src_tbl(df: DataFrame, ind: str = "code", values: list | None = None) -> DataFrame:
    """(country, year) x indicator table of means.

    Rows with a null country, year, indicator or value (or a NaN) are dropped first,
    so every column and row has at least one value.  Sorted by the index.
    """
    ind_col = indicator_column(ind)
    cols = [c for c in ("country", "year", ind_col, "value") if c in df.columns]
    narrow = df.select(*cols).dropna(how="any", subset=cols)
    return _pivot(narrow, ind_col, F.avg("value"), _columns(narrow, ind_col, values)).orderBy(*INDEX)


def src_cells(df: DataFrame, ind: str = "code") -> DataFrame:
    """The cells of ``src_tbl`` in long form: (country, year, indicator, cell)."""
    ind_col = indicator_column(ind)
    cols = ["country", "year", ind_col, "value"]
    return (df.select(*cols).dropna(how="any", subset=cols)
              .groupBy("country", "year", ind_col)
              .agg(F.avg("value").alias("cell")))


__all__ = ["filter_pivot", "first_cells", "first_maps", "select_collections", "src_tbl", "src_cells"]

"""Income checks, distinct counts, top-k and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NumericType

from indicata.functions.expressions import n_unique, quote
from indicata.operators.order_stats import exact_quantiles
from indicata.operators.ranks import with_rank
from indicata.session import checkpoint_dir

# The income flag columns, highest level first.
INCOME_FLAGS = ("high_income", "upper_middle_income", "lower_middle_income", "low_income")


def income_check(df: DataFrame, countries: list[str]) -> DataFrame:
    """One row per listed country with its level and the four flags.

    Where a country's rows disagree, the smallest (level, flags) tuple is
    kept, so the result is stable; an empty list gives no rows.
    """
    rest = ["income_level", *INCOME_FLAGS]
    picked = (df.where(F.col("country").isin(list(countries)))
                .groupBy("country")
                .agg(F.min(F.struct(*rest)).alias("_r")))
    return picked.select("country", *[F.col(f"_r.{c}").alias(c) for c in rest])


def income_distribution(df: DataFrame) -> DataFrame:
    """Rows per income level (null is a level), most frequent first."""
    return (df.groupBy("income_level").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc_nulls_first()))


def null_income_count(df: DataFrame) -> DataFrame:
    """Distinct countries (null counted) without an income level."""
    return (df.where(F.col("income_level").isNull())
              .agg(n_unique(F.col("country")).alias("num_countries")))


def null_income_countries(df: DataFrame) -> DataFrame:
    """C11: the countries without an income level, sorted (null first)."""
    return (df.where(F.col("income_level").isNull()).select("country").distinct()
              .orderBy(F.col("country").asc_nulls_first()))


def distinct_counts(df: DataFrame, columns, groups=None) -> DataFrame:
    """(column, distinct_count) with null counted as a value.

    The columns are taken in ``groups`` (lists of columns that vary together;
    by default all are one): the rows are reduced to a group's distinct
    combinations, map-side first, and only these are turned into (column,
    value) and counted.  No input row is copied, and each column is read once.
    Null stays a value of its own, so no separate null test is needed.  A
    column the table lacks is an error.
    """
    cols = list(columns)
    groups = [cols] if groups is None else [[c for c in g if c in cols] for g in groups]
    if sorted(c for g in groups for c in g) != sorted(cols):
        raise ValueError("every column must be in one of the groups, and in one only")
    long = None
    for group in filter(None, groups):
        combinations = df.select(*[F.col(quote(c)).cast("string").alias(c) for c in group]).distinct()
        one = combinations.unpivot([], group, "column", "value")
        long = one if long is None else long.union(one)
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))


def n_unique_of(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column (null counted), as one row."""
    return df.agg(n_unique(F.col(quote(column))).alias(f"n_unique_{column}"))


def top_indicators(df: DataFrame, k: int = 10, by: str = "indicator_label") -> DataFrame:
    """The ``k`` most frequent indicators with their rank.

    Counts are partial-aggregated; the top-k is a ``TakeOrderedAndProject``
    (each task keeps k rows), so no task sees all groups.  Ties in count
    are broken by the label, ascending with nulls first.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col(by).asc_nulls_first()]
    top = counts.orderBy(*order).limit(k)
    return top.select(by, "count", F.rank().over(Window.orderBy(*order)).alias("rank"))


def rank_groups(df: DataFrame, by) -> DataFrame:
    """Every group of ``by`` with its number of rows and its rank by it, most
    frequent first; groups of the same size share a rank."""
    checkpoint_dir(df.sparkSession)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).checkpoint(eager=True)
    return with_rank(counts, [("count", True)])


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a table as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"))


def schema_table(df: DataFrame) -> DataFrame:
    """(column, dtype) rows from the schema alone (no scan of the data)."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def describe(df: DataFrame, columns=None, interpolation: str = "nearest") -> DataFrame:
    """I3 (nearest quartiles) / I4 (``linear``): one row per column with
    count, null_count, mean, std, min, 25%, 50%, 75%, max.

    count/null count/min/max of every column come from one aggregate; the
    numeric columns are unpivoted to (column, value) and their quartiles
    come from the distributed order-statistics operator (each column is one
    group holding all rows, the hot-group case it is built for).  min and
    max are given as text because columns differ in type.
    """
    cols = list(columns or df.columns)
    num = [c for c in _numeric_cols(df) if c in cols]
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FractionalType)
              and not isinstance(f.dataType, DecimalType)}
    # one aggregate over all columns, written as SQL text (one driver call
    # per expression instead of a tree of Column calls per column)
    aggs = []
    for i, c in enumerate(cols):
        q = quote(c)
        # extremes skip NaN, which Spark would return as the largest value
        seen = f"FILTER (WHERE NOT isnan({q}))" if c in floats else ""
        aggs += [f"count({q}) AS _{i}_count", f"count_if({q} IS NULL) AS _{i}_null_count",
                 f"cast(min({q}) {seen} AS string) AS _{i}_min", f"cast(max({q}) {seen} AS string) AS _{i}_max"]
    one = df.agg(*[F.expr(a) for a in aggs])
    structs = ", ".join(
        f"named_struct('column', {_sql_str(c)}, 'count', _{i}_count, 'null_count', _{i}_null_count, "
        f"'min', _{i}_min, 'max', _{i}_max)" for i, c in enumerate(cols))
    rows = one.selectExpr(f"inline(array({structs}))")
    if not num:
        return rows.selectExpr("column", "count", "null_count",
                               *[f"cast(null AS double) AS `{n}`" for n in ("mean", "std", "25%", "50%", "75%")],
                               "min", "max")
    long = (df.selectExpr(*[f"cast({quote(c)} AS double) AS {quote(c)}" for c in num])
              .unpivot([], num, "column", "v"))
    method = "nearest" if interpolation == "nearest" else "linear"
    qs = exact_quantiles(long, ["column"], "v", {
        "p25": (0.25, method), "p50": (0.5, method), "p75": (0.75, method)})
    # moments and quartiles (one row per column) merged by union + one aggregate
    null_d = "cast(null AS double)"
    stats = (long.selectExpr("column", "0 AS _t", "v", f"{null_d} AS p25", f"{null_d} AS p50",
                             f"{null_d} AS p75")
             .unionByName(qs.selectExpr("column", "1 AS _t", f"{null_d} AS v", "p25", "p50", "p75"))
             .groupBy("column").agg(*[F.expr(x) for x in (
                 "avg(v) AS mean", "stddev_samp(v) AS std",
                 "max(CASE WHEN _t = 1 THEN p25 END) AS `25%`",
                 "max(CASE WHEN _t = 1 THEN p50 END) AS `50%`",
                 "max(CASE WHEN _t = 1 THEN p75 END) AS `75%`")]))
    return (rows.join(stats, "column", "left")
                .select("column", "count", "null_count", "mean", "std", "min",
                        "25%", "50%", "75%", "max"))


def info(df: DataFrame) -> DataFrame:
    """(column, non_null_count, dtype) for every column, from one
    aggregate (each count is partial-aggregated per task)."""
    counts = df.agg(*[F.expr(f"count({quote(c)}) AS _{i}") for i, c in enumerate(df.columns)])
    structs = ", ".join(
        f"named_struct('column', {_sql_str(c)}, 'non_null_count', _{i}, 'dtype', {_sql_str(t)})"
        for i, (c, t) in enumerate(df.dtypes))
    return counts.selectExpr(f"inline(array({structs}))")


def _sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def describe_cells(cells: DataFrame, ind_col: str) -> DataFrame:
    """C17 ``describe``: per indicator column of the mean table, pandas'
    count, mean, std (n-1), min, 25/50/75% (linear) and max, computed on
    the long cells so the wide table is never materialised.  The moments
    and the quartiles (one row per indicator) are merged by a union and one
    aggregate, not a join."""
    null_d = F.lit(None).cast("double")
    qs = exact_quantiles(cells, [ind_col], "cell", {
        "p25": (0.25, "linear"), "p50": (0.5, "linear"), "p75": (0.75, "linear")})
    rows = cells.select(ind_col, F.lit(0).alias("_t"), "cell",
                        null_d.alias("p25"), null_d.alias("p50"), null_d.alias("p75"))
    quart = qs.select(ind_col, F.lit(1).alias("_t"), null_d.alias("cell"), "p25", "p50", "p75")
    q = F.col("_t") == 1
    return (rows.unionByName(quart).groupBy(ind_col).agg(
                F.count("cell").alias("count"),
                F.avg("cell").alias("mean"),
                F.stddev_samp("cell").alias("std"),
                F.min("cell").alias("min"),
                F.max(F.when(q, F.col("p25"))).alias("25%"),
                F.max(F.when(q, F.col("p50"))).alias("50%"),
                F.max(F.when(q, F.col("p75"))).alias("75%"),
                F.max("cell").alias("max"))
            .withColumnRenamed(ind_col, "column"))


def info_cells(cells: DataFrame, ind_col: str) -> DataFrame:
    """C17 ``info``: (column, non_null_count, dtype) of the mean table, whose
    country and year are its index and not columns."""
    return cells.groupBy(ind_col).agg(F.count(F.lit(1)).alias("non_null_count")).select(
        F.col(ind_col).alias("column"), "non_null_count", F.lit("double").alias("dtype"))

"""Column builders (JVM-side expressions only, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Income flag texts and the level each one maps to, in the
# order the classification tests them (first match wins).
INCOME_RULES = (
    ("high_income", "High income", "High Income"),
    ("upper_middle_income", "Upper middle income", "Upper Middle Income"),
    ("lower_middle_income", "Lower middle income", "Lower Middle Income"),
    ("low_income", "Low income", "Low Income"),
)


def quote(name: str) -> str:
    """Backtick-quote a column name (indicator codes may hold dots)."""
    return "`" + name.replace("`", "``") + "`"


def income_level() -> Column:
    """Searched CASE over the four income flags; a null flag falls through."""
    expr = None
    for flag, text, level in INCOME_RULES:
        cond = F.col(flag) == F.lit(text)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(None).cast("string"))


def n_unique(c: Column) -> Column:
    """Exact distinct count in which null counts as one more value."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))



def row_mean_sql(names: list[str]) -> str:
    """SQL text of the mean over named columns of a row, nulls skipped (all null: null)."""
    arr = "array(" + ", ".join(f"cast({quote(n)} AS double)" for n in names) + ")"
    nonnull = f"filter({arr}, x -> x IS NOT NULL)"
    return (f"try_divide(aggregate({nonnull}, 0D, (acc, x) -> acc + x), "
            f"cast(size({nonnull}) AS double))")


def coverage_color(pct: Column) -> Column:
    """Red -> yellow -> green text for a coverage percentage (clamped 0..100).

    p <= 50: rgb(255, int(195 * p / 50), 0)
    p >  50: rgb(int(255 * (1 - (p - 50) / 50)), int(195 + 60 * (p - 50) / 50), 0)
    ``int`` truncates toward zero; a null percentage gives null.
    """
    p = F.least(F.greatest(pct.cast("double"), F.lit(0.0)), F.lit(100.0))
    low = F.format_string("rgb(255, %d, 0)", (F.lit(195.0) * (p / 50)).cast("int"))
    t = (p - 50) / 50
    high = F.format_string("rgb(%d, %d, 0)",
                           (F.lit(255.0) * (1 - t)).cast("int"),
                           (F.lit(195.0) + 60 * t).cast("int"))
    return F.when(pct.isNull(), F.lit(None).cast("string")).when(p <= 50, low).otherwise(high)

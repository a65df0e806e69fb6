from pyspark.sql import functions as F

from indicata.functions.expressions import coverage_color, income_level, n_unique, row_mean_sql
from indicata.plans.pivot import src_cells
from indicata.plans.stats import base_stats


def test_income_level_first_match_and_null(spark):
    df = spark.createDataFrame([
        ("High income", "Upper middle income", None, None),
        (None, None, "Lower middle income", None),
        (None, None, None, "Low income"),
        (None, None, None, None),
        ("high income", None, None, None),
    ], "high_income string, upper_middle_income string, lower_middle_income string, low_income string")
    got = [r[0] for r in df.select(income_level()).collect()]
    assert got == ["High Income", "Lower Middle Income", "Low Income", None, None]


def test_n_unique_counts_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    assert df.agg(n_unique(F.col("c"))).first()[0] == 3
    assert df.where("c is not null").agg(n_unique(F.col("c"))).first()[0] == 2


def test_coverage_color_scale(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (75.0,), (100.0,), (25.0,), (None,), (-5.0,)], "p double")
    got = [r[0] for r in df.select(coverage_color(F.col("p"))).collect()]
    assert got == ["rgb(255, 0, 0)", "rgb(255, 195, 0)", "rgb(127, 225, 0)", "rgb(0, 255, 0)",
                   "rgb(255, 97, 0)", None, "rgb(255, 0, 0)"]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.selectExpr(row_mean_sql(["a", "b", "c"])).collect()]
    assert got == [2.0, None]


def test_mean_over_the_whole_double_range(spark):
    nan, inf = float("nan"), float("inf")
    groups = {"tiny": [3e-10, 4e-10], "nan": [1.0, nan], "inf": [1.0, inf], "huge": [9e25, 9e25, 9e25],
              "mixed": [1.0, None, 2.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").selectExpr(
        "k as source", "'c' as collection", "k as indicator_label", "k as indicator_code", "'A' as country",
        "2000 as year", "v as value")
    by_stats = {r.source: r.mean_value for r in base_stats(df).collect()}
    by_cells = {r.indicator_code: r.cell for r in src_cells(df, "code").collect()}
    assert by_stats.pop("none") is None and "none" not in by_cells
    assert by_stats["nan"] != by_stats["nan"] and by_cells["nan"] == 1.0  # the mean table drops NaN rows first
    for got in (by_stats, by_cells):
        assert abs(got["tiny"] - 3.5e-10) < 1e-24 and got["inf"] == inf
        assert abs(got["huge"] / 9e25 - 1) < 1e-12 and got["mixed"] == 1.5


def test_extremes_skip_nan(spark):
    from indicata.plans.checks import describe

    nan = float("nan")
    df = spark.createDataFrame([("s", "c", "i", "A", 2000, v) for v in (1.0, nan, 3.0, None)],
                               "source string, collection string, indicator_label string, country string, "
                               "year int, value double")
    row = base_stats(df).first()
    assert (row.min_value, row.max_value, row.count_missing_value) == (1.0, 3.0, 1)
    said = {r.column: (r.min, r.max) for r in describe(df, ["year", "value"]).collect()}
    assert said == {"year": ("2000", "2000"), "value": ("1.0", "3.0")}

"""Worked answers on the literal 12-row table (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from indicata.plans import coverage as cov
from indicata.plans import datamap as dm
from indicata.plans import metadata as meta
from indicata.plans import pivot as pv
from indicata.plans import stats as st


def _key(r, cols):
    return tuple(r[c] for c in cols)


def test_counts_by_source_collection(edge):
    rows = dm.datamap(edge, ["source", "collection"]).collect()
    assert [(r.source, r.collection, r["count"]) for r in rows] == [("S1", "C1", 9), ("S2", "C2", 3)]


def test_sub_region_totals(edge):
    got = {r.sub_region_name: (r.total_countries, r.countries)
           for r in cov.sub_region_info(edge).collect()}
    assert got == {"North East": (2, ["A", "B"]), "South": (1, ["C"])}


def test_coverage(edge):
    rows = {r.indicator_label: r.asDict() for r in cov.sub_region_coverage(edge).collect()}
    # the null label has values in a null sub-region only: it stays, with 0 everywhere
    assert set(rows) == {None, "Tax", "Aid"}
    assert rows[None]["pct_coverage_North_East"] == rows[None]["pct_coverage_South"] == 0.0
    assert rows["Tax"]["pct_coverage_North_East"] == 150.0
    assert rows["Tax"]["pct_coverage_South"] == 100.0
    assert rows["Aid"]["pct_coverage_North_East"] == 50.0
    assert rows["Aid"]["pct_coverage_South"] == 0.0


def test_coverage_colors(edge):
    rows = {r.indicator_label: r for r in cov.coverage_colors(cov.sub_region_coverage(edge)).collect()}
    assert rows["Tax"].color_North_East == "rgb(0, 255, 0)"     # clamped to 100
    assert rows["Aid"].color_North_East == "rgb(255, 195, 0)"
    assert rows["Aid"].color_South == "rgb(255, 0, 0)"


def test_base_stats(edge):
    rows = st.base_stats(edge).collect()
    cols = ["count_rows", "count_missing_value", "num_countries_with_data", "num_years_with_data",
            "mean_value", "median_value", "min_year", "max_year"]
    got = {(r.source, r.collection, r.indicator_label): _key(r, cols) for r in rows}
    assert got == {
        ("S1", "C1", None): (1, 0, 1, 1, 5.0, 5.0, 2000, 2000),
        ("S1", "C1", "Debt"): (2, 2, 1, 0, None, None, None, None),
        ("S1", "C1", "Tax"): (6, 1, 3, 3, 3.8, 3.0, 2000, 2003),
        ("S2", "C2", "Aid"): (2, 0, 2, 2, 6.5, 6.5, 2000, 2001),
        ("S2", "C2", "Tax"): (1, 0, 1, 1, 8.0, 8.0, 2000, 2000),
    }
    # sorted by keys, nulls first
    assert [(r.source, r.collection, r.indicator_label) for r in rows] == sorted(
        got, key=lambda k: tuple((x is not None, x or "") for x in k))


def test_iqr_nearest(edge):
    got = {(r.source, r.indicator_label): r.iqr_value for r in st.base_stats(edge).collect()}
    assert got[("S1", "Tax")] == 2.0
    assert got[("S2", "Aid")] == 1.0
    assert got[("S2", "Tax")] == 0.0
    assert got[("S1", None)] == 0.0
    assert got[("S1", "Debt")] is None


def test_completeness_score_order(edge):
    rows = meta.indicators_metadata(edge).collect()
    scores = [(r.source, r.indicator_label, r.completeness_score) for r in rows]
    assert {s[:2] for s in scores[:2]} == {("S1", None), ("S1", "Debt")}
    assert all(s[2] is None for s in scores[:2])
    assert scores[2:] == [("S2", "Tax", 112.5), ("S1", "Tax", 100.0), ("S2", "Aid", 62.5)]
    assert len(rows) == st.base_stats(edge).count()  # the join does not fan out


def test_label_of_a_null_sub_region_keeps_its_score(spark):
    df = spark.createDataFrame(
        [("A", 2000, "I.1", "Tax", 1.0, "S1", "C1", "North East"), ("D", 2000, "I.3", "Aid", 5.0, "S2", "C2", None),
         ("D", 2001, "I.3", "Aid", 7.0, "S2", "C2", None)],
        "country string, year int, indicator_code string, indicator_label string, value double, "
        "source string, collection string, sub_region_name string")
    aid = {r.indicator_label: r for r in meta.indicators_metadata(df).collect()}["Aid"]
    assert (aid.pct_coverage_North_East, aid.completeness_score) == (0.0, 50.0)


def test_first_pivot_by_label(edge):
    out = pv.filter_pivot(edge, ["country", "year", "indicator_label", "value"],
                          ind="label", order_cols=["seq"])
    assert out.columns == ["country", "year", "null", "Aid", "Debt", "Tax"]
    rows = {(r.country, r.year): r for r in out.collect()}
    assert len(rows) == 9
    assert rows[("A", 2001)].Tax == 2.0
    assert all(rows[("B", 2000)][c] is None for c in ("null", "Aid", "Debt", "Tax"))
    assert rows[(None, 2000)].Tax == 3.0
    assert rows[("D", 2000)]["null"] == 5.0


def test_first_pivot_by_code_with_dots(edge):
    out = pv.filter_pivot(edge, ["country", "year", "indicator_label", "value"],
                          ind="code", order_cols=["seq"])
    assert "I.1" in out.columns
    rows = {(r.country, r.year): r.asDict() for r in out.collect()}
    assert rows[("A", 2001)]["I.1"] == 2.0


def test_mean_pivot(edge):
    out = pv.src_tbl(edge, ind="label")
    assert out.columns == ["country", "year", "Aid", "Tax"]
    rows = {(r.country, r.year): r for r in out.collect()}
    assert len(rows) == 5
    assert rows[("A", 2001)].Tax == 5.5


def test_pivot_roundtrip_first_values(edge):
    wide = pv.filter_pivot(edge, ["country", "year", "indicator_label", "value"],
                           ind="label", order_cols=["seq"])
    inds = [c for c in wide.columns if c not in ("country", "year")]
    back = wide.unpivot(["country", "year"], inds, "ind", "v").where(F.col("v").isNotNull())
    expect = {("A", 2000, "Tax", 1.0), ("A", 2001, "Tax", 2.0), ("B", 2003, "Tax", 4.0),
              ("C", 2000, "Tax", 8.0), (None, 2000, "Tax", 3.0), ("D", 2000, "null", 5.0),
              ("D", 2001, "Aid", 7.0), ("A", 2000, "Aid", 6.0)}
    assert {tuple(r) for r in back.collect()} == expect


def test_bad_ind_rejected(edge):
    with pytest.raises(ValueError):
        pv.filter_pivot(edge, ["country", "year", "indicator_label", "value"], ind="name")


@pytest.mark.parametrize("pair", [("GDP", "gdp"), (None, "null"), ("x", "Year")])
def test_indicators_with_the_same_column_name_are_rejected(spark, pair):
    df = spark.createDataFrame([("A", 2000, x, 1.0) for x in pair],
                               "country string, year int, indicator_label string, value double")
    with pytest.raises(ValueError, match="same name"):
        pv.filter_pivot(df, ["country", "year", "indicator_label", "value"])


def test_case_sensitive_sessions_keep_both_columns(spark):
    df = spark.createDataFrame([("A", 2000, x, v) for x, v in (("GDP", 1.0), ("gdp", 2.0))],
                               "country string, year int, indicator_label string, value double")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert [tuple(r) for r in pv.src_tbl(df, "label").collect()] == [("A", 2000, 1.0, 2.0)]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")

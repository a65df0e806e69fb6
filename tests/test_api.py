import pytest
from pyspark.errors import AnalysisException

from indicata import api

from support import SF_SMALL


def test_inspect_and_observe(spark, edge):
    plan = api.inspect(api.datamap(edge, ["source"]))
    assert "HashAggregate" in plan
    df, obs = api.observe_rows(edge, "rows_seen")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 12


def test_select_present_and_shape(spark, edge):
    out = api.select_present(edge, ["country", "nope", "year"])
    assert out.columns == ["country", "year"]
    r = api.shape(edge).first()
    assert (r.rows, r.columns) == (12, 9)


def test_describe_src_linear(spark, edge):
    rows = {r.column: r for r in api.describe_src(edge, "label").collect()}
    # cells of Tax: (A,2000)=1, (A,2001)=5.5, (B,2003)=4, (C,2000)=8
    tax = rows["Tax"]
    assert tax["count"] == 4 and tax["min"] == 1.0 and tax["max"] == 8.0
    assert tax["50%"] == 4.75           # linear between 4 and 5.5
    assert tax["25%"] == 3.25           # 1 + (4 - 1) * 0.75
    info = {r.column: r.non_null_count for r in api.info_src(edge, "label").collect()}
    assert info == {"Tax": 4, "Aid": 2}  # country and year are the index


def test_metadata_distinct_counts_and_info(spark):
    from indicata.sources.tpch import obt

    t = obt(spark, SF_SMALL)
    counts = {r.column: r.distinct_count for r in api.metadata_distinct_counts(t).collect()}
    assert set(counts) == set(api.DEFAULT_PROFILE.metadata_columns) and len(counts) == 14
    assert counts["income_level"] == t.select("income_level").distinct().count()
    with pytest.raises(AnalysisException):
        api.metadata_distinct_counts(t.drop("oecd_member"))
    info = {r.column: (r.non_null_count, r.dtype) for r in api.info(t.select("year", "value")).collect()}
    assert info["year"][1] == "int" and info["value"][1] == "double"
    assert info["value"][0] == t.where("value IS NOT NULL").count()
    assert api.session() is spark

import pytest
from pyspark.sql import functions as F

from indicata import api
from indicata.plans import checks
from indicata.sources.tpch import obt

from support import SF_SMALL


def test_plan_metrics_number_a_tree_and_count_rows(spark):
    table = obt(spark, SF_SMALL)
    rows = api.plan_metrics(api.datamap(table, ["source", "collection"])).collect()
    nodes = {r.node: r for r in rows}
    assert [n for n, r in nodes.items() if r.parent is None] == [0]
    assert all(r.parent < r.node and r.parent in nodes for r in rows if r.parent is not None)
    scans = [r for r in rows if r.operator.startswith("Scan") and r.metric == "numOutputRows"]
    assert [r.value for r in scans] == [table.count()]
    by_name = {(r.operator, r.metric): r.value for r in rows}
    assert by_name["Exchange", "shuffleRecordsWritten"] >= table.select("source", "collection").distinct().count()
    assert by_name["Exchange", "shuffleBytesWritten"] > 0
    assert any(r.metric == "filesSize" and r.value > 0 for r in rows)


def test_every_call_counts_anew(spark):
    frame = api.datamap(obt(spark, SF_SMALL), ["source"])
    once, twice = ({r.step: r.rows for r in api.row_flow(frame).collect()} for _ in range(2))
    frame.collect()
    assert once == twice == {r.step: r.rows for r in api.row_flow(frame).collect()}
    assert once["result"] == frame.count()


def test_a_filter_on_the_folder_shortens_the_scan(spark):
    table = obt(spark, SF_SMALL)
    flow = {r.step: r.rows for r in api.row_flow(api.datamap(table.where("source = 'FURNITURE'"), ["source"])).collect()}
    assert flow == {"scan": table.where("source = 'FURNITURE'").count(), "result": 1}


def test_joins_limits_and_subqueries_are_walked(spark):
    table = obt(spark, SF_SMALL)
    top = checks.top_indicators(table, 5)
    assert {r.step: r.rows for r in api.row_flow(top).collect()}["scan"] == table.count()
    joined = api.select_collections(table.where("year = 1997"), table).groupBy("country").count()
    rows = api.plan_metrics(joined)
    assert rows.where("operator like '%Join%' and metric = 'numOutputRows'").count() >= 1
    table.createOrReplaceTempView("flow")
    inner = spark.sql("select source from flow where year = (select max(year) from flow)")
    scans = api.plan_metrics(inner).where("operator like 'Scan%' and metric = 'numOutputRows'")
    assert scans.count() == 2
    spark.catalog.dropTempView("flow")


def test_frames_without_rows_columns_or_scans(spark, edge):
    flow = {r.step: r.rows for r in api.row_flow(obt(spark, SF_SMALL).where("source = 'no such'")).collect()}
    assert flow["scan"] == 0 and flow["result"] == 0
    twice = edge.select("year", F.col("year"))  # a name that occurs twice
    assert api.plan_metrics(twice).count() >= 1
    assert api.row_flow(spark.range(7)).where("step = 'result' and rows = 7").count() == 1


def test_observe_several_metrics(spark, edge):
    frame, seen = api.observe(edge, "some", rows=F.count(F.lit(1)), years=F.max("year"))
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 12, "years": edge.agg(F.max("year")).first()[0]}
    with pytest.raises(ValueError):
        api.observe(edge, "none")

"""Selections, quantiles and pivots have no path that depends on a size constant."""

import pytest
from pyspark.sql import functions as F

from indicata.operators import order_stats, reshape
from indicata.plans import coverage as cov
from indicata.plans import datamap as dm
from indicata.plans import pivot as pv
from indicata.session import session_settings
from indicata.sources.tpch import SEQ_COLUMN, obt

from support import SF_SMALL

INDEX = ["iso3", "country", "year", "indicator_label", "value"]


def _pivot_selected(spark):
    t = obt(spark, SF_SMALL, with_order=True)
    picked = dm.datamap(t, ["source", "database", "collection"]).where(
        F.col("collection").isin("1-URGENT", "5-LOW"))
    return pv.filter_pivot(pv.select_collections(picked, t), INDEX, ind="label",
                           order_cols=[SEQ_COLUMN])


def test_selection_is_a_semi_join_that_runs_nothing_at_call_time(spark):
    tracker = spark.sparkContext.statusTracker()
    t = obt(spark, SF_SMALL, with_order=True)
    picked = dm.datamap(t, ["source", "database", "collection"]).where(
        F.col("collection").isin("1-URGENT", "5-LOW"))
    spark.sparkContext.setJobGroup("select", "select")
    chosen = pv.select_collections(picked, t)
    assert list(tracker.getJobIdsForGroup("select")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "LeftSemi" in chosen._jdf.queryExecution().optimizedPlan().toString()
    assert {r[0] for r in chosen.select("collection").distinct().collect()} == {"1-URGENT", "5-LOW"}
    assert _pivot_selected(spark).count() > 0


def test_quantiles_never_window_over_raw_rows(spark):
    t = obt(spark, SF_SMALL)
    got = order_stats.exact_quantiles(t, ["source", "indicator_label"], "value", {"m": (0.5, "midpoint")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "percentile" not in plan


def test_region_names_that_collide_are_rejected(spark):
    df = spark.createDataFrame([("A", "North East"), ("B", "North_East")],
                               "country string, sub_region_name string")
    with pytest.raises(ValueError):
        cov.region_names(cov.sub_region_info(df))


def test_pivot_values_have_no_limit(spark):
    df = spark.range(0, 12_000).selectExpr("cast(id as string) as k")
    assert len(reshape.distinct_values(df, "k")) == 12_000


def test_selected_rows_are_not_dealt_by_collection(spark):
    t = obt(spark, SF_SMALL, with_order=True)
    picked = dm.datamap(t, ["source", "database", "collection"]).where(F.col("collection") == "1-URGENT")
    wanted = sorted(tuple(r) for r in t.where("collection = '1-URGENT'").select("ord_seq", "collection").collect())
    for options in ({}, {"folders": True}, {"many": True}):
        chosen = pv.select_collections(picked, t, **options)
        assert sorted(tuple(r) for r in chosen.select("ord_seq", "collection").collect()) == wanted
        joins = [x for x in chosen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in x]
        assert len(joins) == 1 and ("strategy=broadcast" in joins[0]) == (options != {"many": True})


def test_many_names_leave_a_hot_collection_to_be_split(spark):
    t = spark.range(40_000).selectExpr("if(id % 10 = 0, concat('c', id), 'hot') AS collection", "id", "repeat('x', 50) AS pad")
    names = t.select("collection").where("id < 30000")
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with session_settings(spark, settings):
        kept = pv.select_collections(names.distinct().where("collection is not null"), t.repartition(8), many=True)
        rows = kept.groupBy("collection").count()
        counts = {r[0]: r[1] for r in rows.collect()}
    assert counts["hot"] == 36_000 and len(counts) == 3_001

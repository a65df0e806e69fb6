"""Physical-plan checks: pushdown, pruning, broadcast, no row-at-a-time UDF."""

import pytest

from indicata import catalog
from indicata.plans import coverage as cov
from indicata.sources.tpch import obt

from support import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    return obt(spark, SF_SMALL)


def test_datamap_reads_only_its_columns(spark, table):
    df = catalog.QUERIES["datamap_source"](spark, SF_SMALL)
    plan = _plan(df)
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} <= {"source", "database", "collection"}


def test_filter_chain_pushed_to_scan(spark):
    df = catalog.QUERIES["pivot_source_year"](spark, SF_SMALL)
    plan = _plan(df)
    # the source test prunes folders; the year test reaches the Parquet reader
    parts = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in parts and "BUILDING" in parts
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(year,1997)" in pushed


def test_coverage_has_no_forced_broadcast(spark, table):
    plan = cov.sub_region_coverage(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_row_at_a_time_python(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_top_k_is_take_ordered(spark):
    plan = _plan(catalog.QUERIES["top10_indicators"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_build_broadcasts_only_bounded_dimensions(spark):
    from indicata.sources.tpch import mapped_obt
    plan = mapped_obt(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    # the fact-side joins are shuffle joins; only nation/region are broadcast up front
    for line in plan.splitlines():
        if "BroadcastExchange" in line:
            assert "l_orderkey" not in line and "o_orderkey" not in line
    assert plan.count("SortMergeJoin") >= 2


def test_base_stats_merges_without_joins(spark, table):
    from indicata.plans.stats import base_stats
    plan = _optimized(base_stats(table))
    # the branches meet in a union; the values near the ranks are checkpointed before
    assert "Join " not in plan and "Union" in plan


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n.startswith("pivot_")])
def test_first_pivots_are_hash_aggregates(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_flagship_scans_the_table_three_times(spark, table):
    """Once for the cells, twice for the quantiles (sketch, values near the ranks), counted over every plan that ran."""
    from indicata.plans.metadata import indicators_metadata

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    indicators_metadata(table).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    trees = [runs.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0] for i in range(before, runs.size())]
    assert len(trees) >= 3
    assert sum(t.split("== Final Plan ==")[-1].count("Scan parquet") for t in trees) == 3


def test_build_shuffles_facts_before_columns_are_derived(spark):
    from indicata.sources.tpch import dealt_obt
    lines = _plan(dealt_obt(spark, SF_SMALL)).split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    top = next(i for i, x in enumerate(lines) if "REBALANCE_PARTITIONS_BY_COL" in x)
    end = next((i for i in range(top + 1, len(lines)) if depth[i] <= depth[top]), len(lines))
    below = "\n".join(lines[top:end])
    assert "l_orderkey" in below and "p_brand" in below
    # nations, regions and derived texts meet the rows above the last shuffle
    assert "High income" not in below and "n_name" not in below and "IND." not in below


def test_build_cuts_its_shuffles_by_the_size_of_lineitem(spark, tmp_path):
    from indicata.session import session_settings
    from indicata.sources import tpch
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    pieces = []
    for mb in (1, 64, 640):
        with open(tmp_path / "lineitem.parquet", "wb") as f:
            f.truncate(mb << 20)   # listed, never read
        pieces.append(int(tpch._build_settings(spark, str(tmp_path))[key]))
    assert pieces == [4, 32, 320]
    with session_settings(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key, None) is None

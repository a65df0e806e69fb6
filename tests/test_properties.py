
from pyspark.sql import functions as F

from indicata.plans import checks as ck
from indicata.plans import datamap as dm
from indicata.plans import metadata as meta
from indicata.plans import stats as st
from indicata.sources.tpch import obt

from support import SF_SMALL


def test_counts_sum_to_rows(spark):
    t = obt(spark, SF_SMALL)
    n = t.count()
    assert dm.datamap(t, ["source", "database", "collection"]).agg(F.sum("count")).first()[0] == n
    assert ck.income_distribution(t).agg(F.sum("count")).first()[0] == n


def test_missing_not_above_rows_and_join_no_fanout(spark):
    t = obt(spark, SF_SMALL)
    base = st.base_stats(t)
    assert base.where("count_missing_value > count_rows").count() == 0
    assert meta.indicators_metadata(t).count() == base.count()


def test_sort_orders(spark):
    t = obt(spark, SF_SMALL)
    counts = [r["count"] for r in ck.income_distribution(t).collect()]
    assert counts == sorted(counts, reverse=True)
    scores = [r.completeness_score for r in meta.indicators_metadata(t).collect()]
    nulls = [s for s in scores if s is None]
    assert scores[:len(nulls)] == nulls
    rest = scores[len(nulls):]
    assert rest == sorted(rest, reverse=True)
    keys = [(r.source, r.database, r.collection, r["count"])
            for r in dm.datamap(t, ["source", "database", "collection"]).collect()]
    assert keys == sorted(keys)


def test_describe_quartiles_bracket(spark):
    t = obt(spark, SF_SMALL)
    for r in ck.describe(t.select("year", "value", "source")).collect():
        if r["25%"] is not None:
            assert r["25%"] <= r["50%"] <= r["75%"]


def test_row_sequence_follows_row_order(spark):
    from indicata.sources.tpch import ORDER_COLUMNS, SEQ_COLUMN
    t = obt(spark, SF_SMALL, with_order=True)
    by_seq = [tuple(r) for r in t.orderBy(SEQ_COLUMN).select(*ORDER_COLUMNS).collect()]
    assert by_seq == sorted(by_seq)
    assert t.select(SEQ_COLUMN).distinct().count() == t.count()

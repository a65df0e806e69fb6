"""Kept cells: only new files are read, and the merged batches equal a full rebuild."""

import glob
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from indicata import catalog
from indicata.plans import coverage as cov
from indicata.plans import metadata as meta
from indicata.plans import stats as st
from indicata.plans import kept_cells as kc
from indicata.sources.parquet import load_obt
from support import SF_SMALL

FLAGS = ("high_income", "upper_middle_income", "lower_middle_income", "low_income")
PLACES = ["source", "collection", "indicator_label", "sub_region_name", "country", "year"]


def _append(spark, edge, path, cond="true", factor=1):
    rows = edge.where(cond).withColumnRenamed("country", "country_or_area").withColumn("value", F.col("value") * factor)
    for flag in FLAGS:
        rows = rows.withColumn(flag, F.lit(None).cast("string"))
    rows.coalesce(1).write.mode("append").partitionBy("source").parquet(path)


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def _rebuilt(spark, path):
    return st.observation_cells(load_obt(spark, path))


def _table_scans(spark, run):
    """How many of the plans that ``run`` executed read the stored observation table."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    return sum(re.search(r"Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: [^\n]*/obt-", p) is not None for p in plans)


@pytest.fixture
def table(spark, edge, tmp_path):
    path = str(tmp_path / "obs")
    _append(spark, edge, path, "seq % 2 = 0")
    yield path
    kc.forget_cells(spark, path)


def test_new_files_alone_are_added(spark, edge, table):
    assert _rows(kc.kept_cells(spark, table)) == _rows(_rebuilt(spark, table))
    old = glob.glob(f"{table}/*/*.parquet")
    _append(spark, edge, table, "seq % 2 = 1 or seq = 2", factor=3)
    for f in old:  # the old files' content is not looked at again: only their listing counts
        size, when = os.path.getsize(f), os.stat(f).st_mtime_ns
        with open(f, "wb") as g:
            g.write(b"x" * size)
        os.utime(f, ns=(when, when))
        side = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(side):
            os.unlink(side)
    got = _rows(kc.kept_cells(spark, table))
    whole = edge.where("seq % 2 = 0").unionByName(
        edge.where("seq % 2 = 1 or seq = 2").withColumn("value", F.col("value") * 3))
    assert got == _rows(st.observation_cells(whole))
    assert len(kc._batches(spark, kc.store_of(spark, table))) == 2


def test_a_lost_or_changed_file_is_noticed(spark, edge, table):
    kc.kept_cells(spark, table)
    _append(spark, edge, table, "seq % 2 = 1")
    kc.kept_cells(spark, table)
    gone = sorted(glob.glob(f"{table}/source=S2/*.parquet"))[0]
    os.unlink(gone)
    assert _rows(kc.kept_cells(spark, table)) == _rows(_rebuilt(spark, table))
    shutil.rmtree(f"{table}/source=S1")
    _append(spark, edge, table, "seq in (1, 3) and source = 'S1'", factor=5)
    assert _rows(kc.kept_cells(spark, table)) == _rows(_rebuilt(spark, table))


def test_many_batches_are_merged(spark, edge, table, monkeypatch):
    monkeypatch.setattr(kc, "BATCHES", 2)
    for i in range(2):
        kc.kept_cells(spark, table)
        _append(spark, edge, table, f"seq > {3 * i}", factor=i + 2)
    got = kc.kept_cells(spark, table)
    assert _rows(got) == _rows(_rebuilt(spark, table))
    assert len({f.split("/batch-")[1].split("/")[0] for f in got.inputFiles()}) == 1


def test_batches_that_share_a_file_are_not_both_used():
    held = [{"here": True, "batches": ["a", "b"], "files": 2}, {"here": True, "batches": ["b"], "files": 1},
            {"here": True, "batches": ["c"], "files": 1}, {"here": False, "batches": ["d"], "files": 9},
            {"here": True, "batches": ["d"], "files": 1}, {"here": True, "batches": [], "files": 4}]
    assert kc._usable(held) == ["b", "c"]


def test_file_names_are_not_patterns(spark, edge, tmp_path):
    path = str(tmp_path / "obs")
    _append(spark, edge.withColumn("source", F.lit("a {b,c} [d]?*")), path)
    try:
        assert _rows(kc.kept_cells(spark, path)) == _rows(_rebuilt(spark, path))
    finally:
        kc.forget_cells(spark, path)


def test_a_table_without_files_has_no_cells(spark, edge, tmp_path):
    path = str(tmp_path / "none")
    os.makedirs(path)
    schema = edge.withColumnRenamed("country", "country_or_area").selectExpr(
        "*", *[f"cast(null AS string) AS {f}" for f in FLAGS]).schema
    assert kc.kept_cells(spark, path, schema).count() == 0


def test_results_from_kept_cells_equal_those_of_the_rows(spark, edge, table):
    _append(spark, edge, table, "seq % 2 = 1")
    cells, rows = kc.kept_cells(spark, table), load_obt(spark, table)
    assert _rows(st.base_stats(rows, cells=cells)) == _rows(st.base_stats(rows))
    assert _rows(cov.sub_region_coverage(rows, cells=cells)) == _rows(cov.sub_region_coverage(rows))
    assert _rows(meta.indicators_metadata(rows, cells=cells)) == _rows(meta.indicators_metadata(rows))


def test_second_query_scans_the_table_for_the_quantiles_alone(spark):
    catalog.QUERIES["base_stats"](spark, SF_SMALL).collect()  # makes the cells
    for name, scans in (("base_stats", 2), ("indicators_metadata", 2), ("sub_region_coverage", 0), ("sub_region_info", 0)):
        assert _table_scans(spark, lambda: catalog.QUERIES[name](spark, SF_SMALL).collect()) == scans, name

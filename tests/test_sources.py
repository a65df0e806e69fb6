import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from indicata.profile import ColumnProfile, DEFAULT_PROFILE
from indicata.sources.parquet import ROW_ORDER, classify, load_obt, read_csv, with_row_order, write_csv

from support import SF_SMALL


def test_classify_requires_country_column(spark):
    df = spark.createDataFrame([("x",)], "name string")
    with pytest.raises(ValueError):
        classify(df)


def test_parquet_roundtrip_and_csv_sink(spark):
    d = tempfile.mkdtemp(prefix="indicata-test-")
    rows = [("A", "High income", None, None, None), ("B", None, None, None, "Low income")]
    df = spark.createDataFrame(rows, "country_or_area string, high_income string, "
                               "upper_middle_income string, lower_middle_income string, low_income string")
    df.write.parquet(os.path.join(d, "t.parquet"))
    t = load_obt(spark, os.path.join(d, "t.parquet"))
    assert "country" in t.columns and "income_level" in t.columns
    write_csv(t.select("country", "income_level"), os.path.join(d, "out"))
    back = spark.read.option("header", True).csv(os.path.join(d, "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("A", "High Income"), ("B", "Low Income")]


def test_profile_from_yaml():
    d = tempfile.mkdtemp(prefix="indicata-test-")
    p = os.path.join(d, "config.yaml")
    with open(p, "w") as f:
        f.write("data:\n  table_path: x.parquet\nquery:\n  source_metadata_columns:\n    - source\n")
    prof = ColumnProfile.from_yaml(p)
    assert prof.source_metadata_columns == ("source",)
    assert prof.index_columns == DEFAULT_PROFILE.index_columns
    assert prof.data_path == "x.parquet"


def test_derived_tables_live_under_the_shared_checkpoint_root(spark):
    from indicata.session import checkpoint_dir, derived_table_dir

    conf_root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = derived_table_dir(spark, "probe")
    assert path.endswith("/indicata/tables/probe")
    if conf_root:
        # keyed at the configured root, not the per-application folder
        assert path.startswith(conf_root.rstrip("/"))
    assert checkpoint_dir(spark)   # RDD checkpoints have a folder too


def _copy_of_inputs(into, as_folder):
    import shutil

    from indicata.sources.tpch import TABLES

    for t in TABLES:
        source, target = f"{SF_SMALL}/{t}.parquet", os.path.join(into, f"{t}.parquet")
        if t == as_folder:
            os.mkdir(target)
            target = os.path.join(target, "part-0.parquet")
        shutil.copy(source, target)


def test_inputs_by_uri_and_changed_files_in_a_folder(spark):
    from indicata.sources import tpch

    d = tempfile.mkdtemp(prefix="indicata-test-")
    _copy_of_inputs(d, "part")
    uri = f"file://{d}"
    first = tpch._signature(spark, uri)
    assert first == tpch._signature(spark, uri)
    assert tpch.obt(spark, uri).count() == tpch.obt(spark, SF_SMALL).count()
    part = os.path.join(d, "part.parquet", "part-0.parquet")
    os.utime(part, (1, 1))
    assert tpch._signature(spark, uri) != first


def test_a_table_is_published_once(spark):
    from indicata.sources import tpch

    root = tempfile.mkdtemp(prefix="indicata-test-")
    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{root}/{name}")
    tpch._publish(spark, f"{root}/a", f"{root}/table")
    tpch._publish(spark, f"{root}/b", f"{root}/table")   # the second writer keeps the first one's table
    assert os.listdir(root) == ["table"] and spark.read.parquet(f"{root}/table").count() == 3


def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from indicata.session import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                              getConf=lambda: SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_first_pivot_follows_the_file_order(spark):
    from indicata.plans.pivot import filter_pivot

    d = tempfile.mkdtemp(prefix="indicata-test-")
    rows = [("A", 2000, "I", float(v)) for v in (7, 3, 9, 1)]
    spark.createDataFrame(rows, "country string, year int, indicator_label string, value double").coalesce(1) \
        .write.parquet(f"{d}/t")
    t = spark.read.parquet(f"{d}/t").where("value < 8").withColumn("extra", F.lit(1))
    cols = ["country", "year", "indicator_label", "value"]
    for frame in (t, t.repartition(3, "value")):
        assert [tuple(r) for r in filter_pivot(frame, cols).collect()] == [("A", 2000, 7.0)]


HARD = ["line1\nline2", "", " pad ", 'a,b "q" c', "back\\slash\\", None, '"', '""', "\r\nx", "\ttab", "#x", "null", "\\\"", "é漢", ",", "a\n\nb"]


def test_csv_is_lossless_for_spark_and_for_pandas(spark):
    import glob

    import pandas as pd

    d = tempfile.mkdtemp(prefix="indicata-test-")
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in HARD for b in HARD)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    write_csv(df, os.path.join(d, "out/"))
    assert sorted(tuple(r) for r in read_csv(spark, os.path.join(d, "out"), df.schema).collect()) == rows
    # pandas cannot tell an empty text from a null; all else is as it was
    back = pd.concat(pd.read_csv(f, keep_default_na=False, lineterminator=None) for f in glob.glob(os.path.join(d, "out", "*.csv")))
    got = sorted((int(i), a, b) for i, a, b in back.itertuples(index=False))
    assert got == [(i, a or "", b or "") for i, a, b in rows]
    raw = "".join(open(f, newline="").read() for f in sorted(glob.glob(os.path.join(d, "out", "*.csv"))))
    assert ',"",' in raw and '"a,b ""q"" c"' in raw


def test_csv_is_published_whole_or_not_at_all(spark):
    d = tempfile.mkdtemp(prefix="indicata-test-")
    path = os.path.join(d, "out")
    write_csv(spark.range(3), path)
    bad = spark.range(3).selectExpr("cast(raise_error('stop') as string) as x")
    with pytest.raises(Exception, match="stop"):
        write_csv(bad, path)
    assert read_csv(spark, path, spark.range(1).schema).count() == 3
    with pytest.raises(FileExistsError):
        write_csv(spark.range(5), path, mode="errorifexists")
    write_csv(spark.range(7), path)
    assert read_csv(spark, path, spark.range(1).schema).count() == 7
    assert [x for x in os.listdir(d) if not x.startswith("out-") and x != "out"] == []
    with pytest.raises(ValueError):
        write_csv(bad, path, mode="append")


def _ordered_files(spark, d):
    """Three files whose first rows by (file, position) are known."""
    for n, rows in (("b", [("A", 2000, "x", 5.0)]), ("a", [("A", 2000, "x", None), ("A", 2000, "y", 2.0), ("A", 2000, "x", 3.0)]),
                    ("c", [("A", 2000, "y", 9.0), ("B", 2001, "x", 4.0)])):
        frame = spark.createDataFrame(rows, "country_or_area string, year int, indicator_label string, value double")
        flags = ("high_income", "upper_middle_income", "lower_middle_income", "low_income")
        frame.selectExpr("*", "'k' as collection", *[f"cast(null as string) as {c}" for c in flags]).coalesce(1).write.parquet(
            os.path.join(d, "t", f"part={n}"))
    return os.path.join(d, "t")


def test_row_order_is_one_long_and_survives_joins(spark):
    from indicata.plans.pivot import filter_pivot, select_collections

    path = _ordered_files(spark, tempfile.mkdtemp(prefix="indicata-test-"))
    cols = ["country", "year", "indicator_label", "value"]
    table = load_obt(spark, path, row_order=True)
    assert dict(table.dtypes)[ROW_ORDER] == "bigint"
    order = [r[0] for r in table.orderBy(ROW_ORDER).select("value").collect()]
    assert order == [None, 2.0, 3.0, 5.0, 9.0, 4.0]
    chosen = select_collections(spark.createDataFrame([("k",)], "collection string"), table)
    wide = filter_pivot(chosen.repartition(5), cols)
    want = [("A", 2000, None, 2.0), ("B", 2001, 4.0, None)]
    assert sorted(tuple(r) for r in wide.collect()) == want
    assert sorted(tuple(r) for r in filter_pivot(load_obt(spark, path), cols).collect()) == want
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    lost = select_collections(spark.createDataFrame([("k",)], "collection string"), load_obt(spark, path))
    with pytest.raises(ValueError, match="row_order"):
        filter_pivot(lost, cols)


def test_many_files_are_joined_not_sent(spark, monkeypatch):
    from indicata.sources import parquet

    path = _ordered_files(spark, tempfile.mkdtemp(prefix="indicata-test-"))
    sent = with_row_order(spark.read.parquet(path))
    monkeypatch.setattr(parquet, "BROADCAST_FILES", 1)
    joined = with_row_order(spark.read.parquet(path))
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect()))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(parquet, "POSITION_BITS", 62)
    with pytest.raises(ValueError):
        with_row_order(spark.read.parquet(path))


def test_intermediate_folders_go_with_the_driver(tmp_path):
    import subprocess
    import sys

    made = tmp_path / "made"
    made.mkdir()
    (made / "part").write_text("x")
    code = ("from indicata.session import build_session, delete_at_exit\n"
            "spark = build_session('local[1]')\n"
            f"delete_at_exit(spark, {str(made)!r})\n"
            f"import os; assert os.path.exists({str(made)!r})\n"
            "spark.stop()\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
    for _ in range(50):
        if not made.exists():
            break
        time.sleep(0.2)
    assert not made.exists()


def test_csv_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    rows = spark.range(0, 250, 1, 1).selectExpr("id", "concat('a\nb', id) AS t")
    path = str(tmp_path / "many")
    write_csv(rows, path, file_rows=100)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 3
    assert sorted(map(tuple, read_csv(spark, path, rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    long = spark.range(0, 250_000, 1, 1)   # one task's rows
    write_csv(long, path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 3
    assert read_csv(spark, path, long.schema).count() == 250_000

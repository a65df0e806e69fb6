"""The distributed order-statistics operator against a sorted-list oracle."""

import random

import numpy as np
import pytest

from indicata.operators import order_stats
from indicata.operators.order_stats import exact_quantiles


def _brute(vals, q, method):
    v = sorted(vals)
    n = len(v)
    if method == "nearest":
        return v[int(np.floor((n - 1) * q + 0.5))]
    lo, hi = v[int(np.floor((n - 1) * q))], v[int(np.ceil((n - 1) * q))]
    if method == "midpoint":
        return (lo + hi) / 2
    pos = (n - 1) * q
    return lo + (hi - lo) * (pos - np.floor(pos))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_sorted_oracle(spark, seed):
    rnd = random.Random(seed)
    rows = []
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 7, "f": 8, None: 11, "hot": 5000}
    for g, n in sizes.items():
        for _ in range(n):
            v = float(rnd.randint(-30, 30)) if rnd.random() > 0.15 else None
            rows.append((g, v))
    rows.append(("only_null", None))
    df = spark.createDataFrame(rows, "g string, v double")
    spec = {"q25n": (0.25, "nearest"), "q75n": (0.75, "nearest"), "med": (0.5, "midpoint"),
            "p25": (0.25, "linear"), "p90": (0.9, "linear")}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", spec).collect()}
    assert "only_null" not in got
    for g in sizes:
        vals = [v for gg, v in rows if gg == g and v is not None]
        if not vals:
            assert g not in got
            continue
        r = got[g]
        assert r.n == len(vals)
        for name, (q, m) in spec.items():
            assert r[name] == pytest.approx(_brute(vals, q, m)), (g, name)


def test_hot_group_spans_partitions(spark):
    # one group holds almost all rows; it must still be answered exactly
    df = spark.range(0, 20000).selectExpr("case when id % 50 = 0 then 'cold' else 'hot' end as g",
                                          "cast((id * 7919) % 10007 as double) as v")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"m": (0.5, "midpoint")}).collect()}
    pdf = df.toPandas()
    for g in ("hot", "cold"):
        assert got[g].m == pytest.approx(float(pdf[pdf.g == g].v.median()))


def test_multi_key_with_null_keys_on_range_path(spark):
    rows = [(a, b, float((i * 37) % 101)) for i in range(3000)
            for a, b in [(["x", None][i % 2], ["p", None, "q"][i % 3])]]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    got = {(r.a, r.b): r.m for r in exact_quantiles(df, ["a", "b"], "v", {"m": (0.5, "midpoint")}).collect()}
    for key in {(a, b) for a, b, _ in rows}:
        vals = [v for a, b, v in rows if (a, b) == key]
        assert got[key] == pytest.approx(_brute(vals, 0.5, "midpoint")), key


def test_a_hot_group_sends_gap_rows_and_no_values(spark):
    """Of a third of the table in one group only what lies near a rank is kept value by value."""
    from pyspark.sql import functions as F

    from indicata.sources.tpch import obt
    from support import SF_SMALL

    t = obt(spark, SF_SMALL)
    hot = t.withColumn("indicator_label", F.when(
        F.xxhash64("iso3", "year", "value", "collection") % 3 == 0, F.lit("HOT"))
        .otherwise(F.col("indicator_label")))
    rows = hot.where("value IS NOT NULL").select("indicator_label", F.col("value").alias("_v"))
    kept = order_stats._kept(rows, ["indicator_label"], [0.25, 0.5], order_stats.MARGIN)
    own = kept.where("indicator_label = 'HOT'")
    of_table = rows.where("indicator_label = 'HOT'").agg(F.count("*"), F.count_distinct("_v")).first()
    assert own.where("_v IS NULL").count() <= 3 and own.count() < 0.1 * of_table[1]
    assert own.agg(F.sum("_c")).first()[0] == of_table[0]
    got = exact_quantiles(hot, ["indicator_label"], "value", {"m": (0.5, "midpoint"), "q": (0.25, "nearest")})
    pdf = hot.select("indicator_label", "value").toPandas().groupby("indicator_label", dropna=False)["value"]
    want = pdf.median()
    for r in got.collect():
        assert r.m == pytest.approx(want[r.indicator_label])


def _adversary(spark, seed, n=6000):
    rnd = random.Random(seed)
    kinds = {"ties": lambda: float(rnd.choice([1, 1, 1, 2])), "wide": lambda: rnd.random() * 10 ** rnd.randint(-9, 9),
             "nan": lambda: rnd.choice([float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.5]),
             "mostly_nan": lambda: float("nan") if rnd.random() < 0.9 else rnd.random(), "steps": lambda: float(rnd.randint(0, 900))}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


_SPEC = {"a": (0.25, "nearest"), "b": (0.5, "midpoint"), "c": (0.75, "nearest"), "d": (0.999, "linear"), "e": (0.0, "nearest"), "f": (1.0, "nearest")}


def _check(rows, got):
    for r in got:
        vals = np.sort(np.array([v for g, v in rows if g == r.g]))  # NaN last
        assert r.n == vals.size
        for name, (q, method) in _SPEC.items():
            with np.errstate(invalid="ignore"):
                assert r[name] == pytest.approx(_brute(vals.tolist() if not np.isnan(vals).any() else vals, q, method), nan_ok=True), (r.g, name)


@pytest.mark.parametrize("settings", [{}, {"GROUP_ROWS": 300, "PARTS": 8}, {"MARGIN": 1e-4, "SMALL": 1}, {"BROADCAST_GROUPS": 0}])
def test_refining_and_widening_are_exact(spark, monkeypatch, settings):
    """More rows than one window takes, brackets that miss, the join without a broadcast."""
    for name, x in settings.items():
        monkeypatch.setattr(order_stats, name, x)
    rows, df = _adversary(spark, 4)
    calls = []
    real = order_stats._refined
    monkeypatch.setattr(order_stats, "_refined", lambda *a: calls.append(1) or real(*a))
    sorted_rows = [(g, v) for g, v in rows]
    _check(sorted_rows, exact_quantiles(df, ["g"], "v", _SPEC).collect())
    assert bool(calls) == ("GROUP_ROWS" in settings)


def test_no_python_and_no_copy_of_the_values(spark):
    df = spark.range(0, 200_000).selectExpr("id % 3 as g", "cast(hash(id) as double) as v")
    rows = df.select("g", df["v"].alias("_v"))
    kept = order_stats._kept(rows, ["g"], [0.25, 0.5, 0.75], order_stats.MARGIN)
    assert kept.count() < 0.09 * 200_000
    plan = exact_quantiles(df, ["g"], "v", {"m": (0.5, "midpoint")})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_other_numeric_types_and_no_rows(spark):
    df = spark.range(0, 1000).selectExpr("cast(id as int) as i", "cast(id as decimal(20, 2)) as d", "id as l")
    for c in df.columns:
        assert exact_quantiles(df, [], c, {"m": (0.5, "midpoint")}).first() == (1000, 499.5)
    assert exact_quantiles(df.where("false"), ["l"], "i", {"m": (0.5, "midpoint")}).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "i", {"m": (0.5, "other")})

"""base_stats against a pandas brute force on random tables with nulls."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from indicata.plans.stats import base_stats

row = st.tuples(
    st.sampled_from(["S1", "S2", None]),          # source
    st.sampled_from(["C1", None]),                # collection
    st.sampled_from(["L1", "L2", None]),          # indicator_label
    st.sampled_from(["A", "B", "C", None]),       # country
    st.sampled_from([2000, 2001, 2005, None]),    # year
    st.one_of(st.none(), st.integers(-50, 50).map(lambda x: x / 4)),  # value
)


def _n_unique(s):
    return s.nunique(dropna=True) + int(s.isna().any())


def _brute(pdf):
    out = {}
    keys = ["source", "collection", "indicator_label"]
    for k, g in pdf.groupby(keys, dropna=False):
        k = tuple(None if (isinstance(x, float) and math.isnan(x)) else x for x in k)
        vals = np.sort(g["value"].dropna().to_numpy())
        n = len(vals)
        withv = g[g["value"].notna()]
        rec = {
            "count_rows": len(g),
            "count_missing_value": int(g["value"].isna().sum()),
            "num_countries_with_data": _n_unique(g["country"]),
            "num_years_with_data": _n_unique(withv["year"]) if len(withv) else 0,
            "mean_value": float(vals.mean()) if n else None,
            "median_value": float((vals[(n - 1) // 2] + vals[n // 2]) / 2) if n else None,
            "min_value": float(vals[0]) if n else None,
            "max_value": float(vals[-1]) if n else None,
            "iqr_value": float(vals[int(np.floor((n - 1) * 0.75 + 0.5))]
                               - vals[int(np.floor((n - 1) * 0.25 + 0.5))]) if n else None,
            "min_year": None if withv["year"].dropna().empty else int(withv["year"].min()),
            "max_year": None if withv["year"].dropna().empty else int(withv["year"].max()),
        }
        out[k] = rec
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=40))
def test_base_stats_matches_pandas(spark, rows):
    schema = ("source string, collection string, indicator_label string, country string, "
              "year int, value double")
    df = spark.createDataFrame(rows, schema)
    got = {(r.source, r.collection, r.indicator_label): r.asDict() for r in base_stats(df).collect()}
    pdf = pd.DataFrame(rows, columns=["source", "collection", "indicator_label", "country", "year", "value"])
    pdf["value"] = pdf["value"].astype("float64")
    pdf["year"] = pdf["year"].astype("float64")
    want = _brute(pdf)
    assert set(got) == set(want)
    for k, rec in want.items():
        for c, v in rec.items():
            if isinstance(v, float):
                assert got[k][c] == pytest.approx(v), (k, c)
            else:
                assert got[k][c] == v, (k, c)

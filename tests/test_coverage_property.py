"""Sub-region totals and coverage against a pure-Python brute force."""

from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from indicata.plans.coverage import sub_region_coverage, sub_region_info

row = st.tuples(
    st.sampled_from(["A", "B", "C", None]),         # country
    st.sampled_from(["North East", "South", None]),  # sub_region_name
    st.sampled_from(["L1", "L2", None]),           # indicator_label
    st.sampled_from([None, 1.0, 2.5]),             # value
)


def _brute(rows):
    pairs = {(c, r) for c, r, _, _ in rows if c is not None and r is not None}
    totals = {}
    for _, r in pairs:
        totals[r] = totals.get(r, 0) + 1
    seen = {}
    for c, r, lab, v in rows:
        if v is not None:
            seen.setdefault(lab, {}).setdefault(r, set()).add(c)
    out = {}
    for lab, per in seen.items():
        rec = {}
        for r in totals:
            k = len(per.get(r, set()))
            pct = Decimal(repr(k / totals[r] * 100)).quantize(Decimal("0.001"), ROUND_HALF_EVEN)
            rec["pct_coverage_" + r.replace(" ", "_")] = float(pct)
        out[lab] = rec
    return totals, out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=30))
def test_coverage_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "country string, sub_region_name string, "
                                     "indicator_label string, value double")
    totals, want = _brute(rows)
    got_totals = {r.sub_region_name: r.total_countries for r in sub_region_info(df).collect()}
    assert got_totals == totals
    if not totals:
        return
    got = {r.indicator_label: {k: v for k, v in r.asDict().items() if k != "indicator_label"}
           for r in sub_region_coverage(df).collect()}
    assert got == want

"""Summarise the executed (final AQE) plans of the registered queries.

Usage: python scripts/plans_report.py [sf_dir] > PLANS.md
For each query: shuffles (Exchange), join strategies, scans with their
read schema and pushed filters, Python nodes and aggregate kinds.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from indicata import catalog  # noqa: E402
from indicata.session import build_session  # noqa: E402


def summarize(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    ex = [re.sub(r"#\d+L?", "", l.strip(" :+-")) for l in lines
          if re.search(r"\b(Exchange|BroadcastExchange)\b", l) and "Reused" not in l
          and "ShuffleQueryStage" not in l and "BroadcastQueryStage" not in l]
    out = {
        "exchanges": [re.sub(r", \[plan_id=\d+\]", "", e)[:140] for e in ex],
        "joins": sorted({m for l in lines for m in re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)[^\n]*?(Inner|LeftOuter|LeftSemi|LeftAnti|FullOuter)?", l) for m in [m[0] + (" " + m[1] if m[1] else "")]}),
        "aggregates": sorted({a for l in lines for a in re.findall(r"(HashAggregate|ObjectHashAggregate|SortAggregate)", l)}),
        "python": sorted({p for l in lines for p in re.findall(r"(MapInPandas|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas)", l)}),
        "scans": [],
    }
    for l in lines:
        if "FileScan parquet" in l or "Scan parquet" in l:
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", l)
            pf = re.search(r"PushedFilters: \[([^\]]*)\]", l)
            pt = re.search(r"PartitionFilters: \[([^\]]*)\]", l)
            filt = (pf.group(1) if pf else "")[:160]
            if pt and pt.group(1):
                filt = (filt + "; folders: " + re.sub(r"#\d+", "", pt.group(1)))[:240]
            out["scans"].append(((rs.group(1) if rs else "?")[:160], filt))
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8)
    print(f"# PLANS\n\nFinal adaptive plans of the registered queries at `{os.path.basename(sf_dir)}`"
          " (generated by `scripts/plans_report.py`).\n")
    for name, q in catalog.QUERIES.items():
        df = q(spark, sf_dir)
        df.collect()  # runs this DataFrame's own plan, so AQE's final plan is recorded
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"## {name}\n")
        print(f"- shuffles: {len(s['exchanges'])}")
        for e in s["exchanges"]:
            print(f"  - `{e}`")
        print(f"- joins: {', '.join(s['joins']) or 'none'}")
        print(f"- aggregates: {', '.join(s['aggregates']) or 'none'}; python: {', '.join(s['python']) or 'none'}")
        for rs, pf in s["scans"]:
            print(f"- scan `{rs}`" + (f" pushed `{pf}`" if pf else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main()

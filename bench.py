"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_SHUFFLE_PARTITIONS
(default: BENCH_CPUS), BENCH_CPUS
(default 8), BENCH_RUNS (default 5).  The derived observation table is
built from the TPC-H tables into a fresh folder first (timed as
``setup_sec``) and the queries read that copy; each query then runs one
warm-up and BENCH_RUNS timed runs, the median is reported.  A run forces
the full result through Spark's ``noop`` sink (no ``count()`` shortcut).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from indicata import catalog  # noqa: E402
from indicata.session import build_session  # noqa: E402
from indicata.session import derived_table_dir  # noqa: E402
from indicata.sources.tpch import obt_path, write_obt  # noqa: E402

HEADLINE = ("datamap_source", "pivot_code", "base_stats", "sub_region_coverage",
            "indicators_metadata", "distinct_counts", "top10_indicators", "src_tbl_mean")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(f"local[{cpus}]", app="indicata-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          extra={"spark.driver.memory": "16g"})
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start-up, not the build
    # setup: derive the observation table from the TPC-H tables (five joins,
    # the row-order sort and the Parquet write) into a fresh folder
    fresh = derived_table_dir(spark, f"bench-obt-{uuid.uuid4().hex[:12]}")
    t0 = time.perf_counter()
    write_obt(spark, sf_dir, fresh)
    setup = time.perf_counter() - t0
    obt_path(spark, sf_dir, path=fresh)

    times = {}
    for name in HEADLINE:
        q = catalog.QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 4)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "setup_sec": round(setup, 4),
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

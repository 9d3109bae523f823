"""Benchmark the headline queries.

Runs every query registered with ``bench=True`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``, executing each plan fully
through the ``noop`` sink (no driver collect), and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txnflow.plans.catalog import QUERIES  # noqa: E402
from txnflow.session import build_session, clear_materialized  # noqa: E402
from txnflow.sources import testdata  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", app="txnflow-bench", shuffle_partitions=max(8, cpus),
                          conf={"spark.driver.memory": "16g"})
    testdata.input_partitions = cpus     # each test file is one row group: scan it with all cores
    # Warm-up (JIT, class loading) on the smallest query, not timed.
    QUERIES["journey_extract"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name, q in QUERIES.items():
        if not q.bench:
            continue
        t0 = time.perf_counter()
        q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        clear_materialized(spark)        # the query's materialised inputs are no longer needed (untimed)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": float(sf) if sf else None}))
    clear_materialized(spark)
    spark.stop()


if __name__ == "__main__":
    main()

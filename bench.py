"""Benchmark the headline queries.

Runs each query once to warm up, then three timed runs (median reported).
A run is plan construction plus full execution into Spark's ``noop`` sink,
so nothing is collected to the driver.  Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millwright.plans import catalog  # noqa: E402
from millwright.session import local_session  # noqa: E402

HEADLINE = [
    "oee_by_line", "oee_rollup", "oee_extremes", "join_plant_safe", "downtime_pareto", "mtbf_gaps", "asset_risk",
    "remaining_risk", "cost_risk_matrix", "spc_by_line", "cpk_plant", "dq_iqr", "dq_jumps", "dq_assoc_rules",
    "sensor_iforest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=cpus, app="millwright-bench")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = catalog.QUERIES.get(name)
        if fn is None:
            continue
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = fn(spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver).  Before timing, every headline query runs
once on the smallest tables to warm the JVM (JIT, codegen caches) and the
bench tables are read once, so the timings are steady-state.  Prints one JSON line:
{"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "loan_features",            # flagship: ranks, split, target, history features, rolling rates
    "default_in_window",
    "history_target_split",
    "upb_change_rate",
    "prior_default_rows",
    "origination_default_table",
    "score_trend",
    "adverse_selection_ttest",
    "lender_msa",
    "monthly_prep",
    "origination_prep",
    "msa_series",
    "unit_root",
    "histogram",
    "bins",
    "knn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("BENCH_CPUS", cpus)
    from loanpanel.plans.catalog import QUERIES
    from loanpanel.session import build_session

    spark = build_session(master=f"local[{cpus}]", app="loanpanel-bench")
    names = [a for a in sys.argv[1:]] or HEADLINE
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    # touch the bench tables once (file listing, footers, OS cache)
    for table in ("orders", "customer", "events"):
        path = f"{sf_dir.rstrip('/')}/{table}.parquet"
        if os.path.exists(path):
            spark.read.parquet(path).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

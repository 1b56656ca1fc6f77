"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1); BENCH_CPUS  local threads (default 8);
BENCH_QUERIES  comma-separated names, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavelane import session  # noqa: E402
from wavelane.plans import load_all  # noqa: E402
from wavelane.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "a01_manifest_summary", "a03_strata_summary", "a04_recording_mean", "a06_cluster_bootstrap_ci", "a09_win_loss", "a10_distribution",
    "a12_coverage_audit", "a20_band_decomposition", "a35_validation_aggregate", "v01_validate_manifest", "j01_paired", "j06_overlap",
    "j07_plan_degradations", "x03_stratified_cap", "x07_weighted_draws", "w02_interval_union_length", "w05_hangover", "w06_ema",
    "w07_virtual_backlog", "g01_alias_components", "g03_greedy_distinct", "f01_stft", "f08_lsd", "f17_loss_parts", "r06_health_counters",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = session.build(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "a03_strata_summary", sf)  # warm the JVM and the file cache
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

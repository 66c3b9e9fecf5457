"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores. Every query runs once to warm the JVM and is then timed on a
full execution (noop sink, nothing collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from talus.plans import load_all  # noqa: E402
from talus.session import build_session, drop_tables  # noqa: E402

HEADLINE = [
    "kernel_events",
    "kernel_cohort",
    "cohort_funnel",
    "event_interval_join",
    "window_variants",
    "clip_ranges",
    "skew_describe",
    "cyclic_loads",
    "nz_loads_two_stage",
    "ceiling_sweep",
    "imbalance_table",
    "permutation_bootstrap",
    "config_summary",
    "slowest_threads",
    "auroc_rank",
    "subject_bootstrap_ci",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "talus-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    timings = {}
    for name in names:
        seconds = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    result = {
        "metric": "headline_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name,
    }
    if timings.get("kernel_events"):
        result["kernel_records_per_s"] = round(events / timings["kernel_events"])
    drop_tables(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()

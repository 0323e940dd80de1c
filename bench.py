"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores and
``BENCH_REPEATS`` the timed runs (the median counts, after one warm-up).
Every query runs to its last row into a sink that discards it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from devicelog.plans import catalog  # noqa: E402
from devicelog.session import build_session  # noqa: E402

# From raw cells (clean_log, elect_ts_format), then on stored tables.
HEADLINE = [
    "clean_log",
    "elect_ts_format",
    "session_summary",
    "parameter_stats",
    "alarm_events",
    "alarm_kpis",
    "compare_summary",
    "compare_overlay",
    "cohort_stats",
    "box_stats",
    "box_outliers",
    "histogram",
    "correlation_matrix",
    "rolling_features",
    "alarm_target",
    "train_test_split",
    "audit_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{"spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    def full(name: str):
        return lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    def load_store() -> None:
        catalog.forget()
        catalog.loaded(spark, folder)

    load_store()
    seconds = {"load_store": statistics.median(timed(load_store) for _ in range(repeats))}
    for name in HEADLINE:
        timed(full(name))
        seconds[name] = statistics.median(timed(full(name)) for _ in range(repeats))
    seconds = {name: round(s, 3) for name, s in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "device-log headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

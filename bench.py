"""Time the headline queries and print one JSON line.

Each query is built and run to the ``noop`` sink: one warm-up, then the median
of ``BENCH_RUNS`` runs (3).  BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (a comma
list) choose the data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zealmark.plans.registry import queries  # noqa: E402
from zealmark.session import build_session  # noqa: E402

HEADLINE = (
    "sessions_bookmarked",
    "sessions_speakers_viewed",
    "sessions_timespent",
    "combine_6",
    "lead_scores",
    "leads",
    "topic_scores",
    "topic_validation",
    "event_grade",
    "cohorts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    built = queries()
    took = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            built[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_query_time",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

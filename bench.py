"""Time the headline queries: the median of three runs after a first one. Prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "customer_day_facts",
    "labelled_facts",
    "customer_features_main",
    "day_features_main",
    "customer_tests",
    "day_tests",
    "combined_result_main",
    "cohort_grid",
    "customer_delta",
    "timeline_sales_all",
    "test_vs_control_sales_all_14",
    "real_result",
    "synthetic_result",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")

    from liftgauge.catalog.queries import QUERIES
    from liftgauge.session import local_session

    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["date_bounds"].on_spark(spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        took = []
        # The first run compiles the query's code; the median of the next three is what is told.
        for _ in range(4):
            start = time.perf_counter()
            # All rows are worked out and thrown away, so that the driver's memory is not what is timed.
            QUERIES[name].on_spark(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time every registered query after a warm-up and print one JSON line.

The warm-up runs each query once on the smaller folder next to the data folder, so plans
are compiled before they are timed.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local threads,
``BENCH_RUNS`` the timed runs per query (the median counts) and ``BENCH_ONLY`` an
optional comma-separated list of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from turnledger.catalog import QUERIES
from turnledger.session import local_session


def seconds(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    smaller = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    warm_dir = smaller if os.path.isdir(smaller) else sf_dir
    spark = local_session("bench", cpus)
    times: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        seconds(spark, fn, warm_dir)
        times[name] = round(statistics.median(seconds(spark, fn, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())

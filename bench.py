"""Time every catalog query, second run, and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated name prefixes), BENCH_BUDGET (seconds after which no
further query starts, default 1500).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallyframe.plans.catalog import CATALOG


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    deadline = time.monotonic() + float(os.environ.get("BENCH_BUDGET", "1500"))
    seconds, missing = {}, []
    for name, entry in CATALOG.items():
        if only and not name.startswith(only):
            continue
        if time.monotonic() > deadline:
            print(f"budget used up before {name}", file=sys.stderr)
            missing.append(name)
            continue
        for _ in range(2):
            start = time.perf_counter()
            entry(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    print(json.dumps({
        "metric": "total seconds of all queries, warm" if not missing else "INCOMPLETE: seconds of some queries, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "missing": missing,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

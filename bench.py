"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every
query is run to the end through the ``noop`` sink; the best of two runs counts,
so that neither JVM start nor code compilation is measured.
"""

from __future__ import annotations

import json
import os
import time

from tidemill import catalog
from tidemill.session import build_session, with_local_folder

HEADLINE = (
    "extract_features",
    "validate_features",
    "agg_user_window",
    "agg_user_all",
    "assemble_training",
    "dedup_first",
    "fs_upsert",
    "fs_snapshots",
    "fs_vector",
    "per_user_30d",
    "velocity",
    "zscore_roll",
    "session_batch",
    "st_tumbling",
    "success_rate_5m",
    "latency_quantiles",
    "latency_histogram_quantiles",
    "histogram_stats",
    "slo",
    "alerts_for",
    "drift",
    "describe",
    "auc",
    "split",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidemill-bench",
        f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    with_local_folder(spark)
    registered = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()

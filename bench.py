"""Time the headline loads and operators; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEAT (default 3: the first run is reported apart,
``queries`` holds the median of the later runs).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loadkit.catalog import QUERIES  # noqa: E402
from loadkit.session import build_session  # noqa: E402

HEADLINE = [
    "dimension_scd2_load", "dimension_scd1_load", "fact_load", "flat_file_load",
    "generic_load", "merge_join", "multi_dimension_lookup", "dedup_keep_last",
    "scd2_merge", "scd1_upsert", "surrogate_key", "route_errors_rejected",
    "partitioned_append", "restartable_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    scratch = tempfile.mkdtemp(prefix="loadkit-bench-")
    spark = build_session(
        "loadkit-bench", master=f"local[{cpus}]", shuffle_partitions=2 * cpus,
        extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": scratch,
               # Small tables: let even a small shuffle spread over the cores.
               "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB"})
    spark.sparkContext.setLogLevel("ERROR")

    first: dict[str, float] = {}
    later: dict[str, list[float]] = {}
    for name in HEADLINE:
        for i in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt_ = time.perf_counter() - t0
            if i == 0:
                first[name] = round(dt_, 3)
            else:
                later.setdefault(name, []).append(dt_)
    med = {k: round(statistics.median(v), 3) for k, v in later.items()} if later else dict(first)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_median_query_sec",
        "value": round(sum(med.values()), 3),
        "unit": "sec",
        "queries": med,
        "first_run": first,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
        "spark": spark.version,
        "shuffle_partitions": 2 * cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

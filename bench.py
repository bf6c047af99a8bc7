"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import time

from driftwatch.plans.queries import QUERIES
from driftwatch.session import get_spark

HEADLINE = [
    "size_baseline",
    "size_anomalies",
    "full_baseline",
    "health_card",
    "schema_drift",
    "semantic_velocity",
    "backtest_velocity",
    "write_stats",
    "runway_rate",
    "scan_threats",
    "scan_threats_nested",
    "scan_requests",
    "similar_incidents",
    "incident_reports",
    "document_incidents",
    "correlation_windows",
    "suppress_refires",
    "rate_limit",
    "resolve_approvals",
    "seal_verify",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", cores, **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "scan_docs_per_sec": round(docs / seconds["scan_threats"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query runs once, planning included; all result
rows are produced and dropped.
"""

from __future__ import annotations

import json
import os
import time

from recordloom.catalog.queries import QUERIES
from recordloom.session import local_session

HEADLINE = (
    "list_open_threads",
    "threads_title_contains",
    "threads_by_relation",
    "open_actions",
    "request_results",
    "memories_filtered",
    "term_search",
    "term_search_batch",
    "term_search_passages",
    "memory_update",
    "invalid_threads",
    "command_outcomes",
    "invalid_information",
    "semantic_report",
    "manual_updates",
    "relation_checks",
    "applied_relations",
    "mechanism_classes",
    "routing",
    "execution_plans",
    "plan_decisions",
    "applied_plans",
    "persistent_after_plans",
    "request_responses",
    "thread_actions_after_log",
    "stream_command_outcomes",
    "stream_idempotency",
    "stream_ingest",
    "history_gaps",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "recordloom-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

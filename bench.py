"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from clerkwise.plans import registry
from clerkwise.session import build_session

QUERIES = [
    "ledger_queues", "analytics_totals", "overdue_documents", "unassigned_queue", "activity_feed", "default_workspace",
    "effective_plan", "subscription_fold", "billing_stats", "system_health", "latency_histogram", "import_outcomes",
    "transition_apply", "review_merge", "update_by_key", "upsert_snapshot", "sla_scan", "slug_unique", "mask_pii",
    "documents_fields", "documents_classified", "template_render", "servicenow_listing", "outbox_auto", "workflow_match",
    "workflow_changes", "workflow_audit", "workflow_notifications", "workflow_outbox", "workflow_status_pass", "quota_admission", "processed_documents", "queue_snapshot", "reply_precedence", "sliding_admission",
    "admission_saturated", "stream_admission", "stream_processing",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, {"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = registry.queries()
    only = sys.argv[1:] or QUERIES
    runs["by_status"](spark, folder).collect()
    times: dict[str, float] = {}
    for name in only:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            runs[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{folder}/orders.parquet").count()
    rate = round(documents / times["processed_documents"]) if "processed_documents" in times else None
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "documents_per_second": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

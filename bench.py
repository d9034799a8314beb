"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from plateworks.plans import load
from plateworks.plans.bindings import Tables
from plateworks.plans.stage_queries import state_table
from plateworks.session import local_session

HEADLINE = (
    "agg_stats_states", "evt_last", "evt_fail_count", "evt_retry_plan", "evt_notify_dedup", "evt_idempotent_write", "stg_state", "agg_review_queue", "agg_problem_counts", "rep_plan",
    "jn_export_check", "src_register_dedup", "txt_normalize", "txt_keyword_normalize", "txt_claims", "gate_text_item", "gate_people", "exp_collect", "img_sharpness",
    "img_tile_sharpness", "rdy_category_map", "rdy_evaluate")

BUDGET = float(os.environ.get("BENCH_BUDGET_SEC", "240"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", tempfile.mkdtemp(prefix="plateworks-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times, skipped = {}, []
    tables = Tables(spark, folder)
    for name, build in (("table_log", lambda: tables.view("b_events")), ("table_catalogue", lambda: tables.view("b_catalog")), ("table_state", lambda: state_table(tables))):
        start = time.perf_counter()  # what several queries share is timed on its own
        build()
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        if name not in queries:
            continue
        if sum(times.values()) > BUDGET:  # named in the output, so that a skipped query is seen
            skipped.append(name)
            continue
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "not_run": skipped, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

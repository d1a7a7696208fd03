"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES
(comma-separated names, or "all") chooses the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from uipatterns.catalog import QUERIES  # noqa: E402
from uipatterns.session import build_session  # noqa: E402

HEADLINE = [
    "page_report", "page_scan_scores", "x01_explode_nodes", "x15_collapse_nested", "f02_infer_role", "f05_infer_field",
    "f12_propose_groups", "r12_run_rules", "m04_score_distinct", "m09_decide", "m12_merge_findings", "m14_page_score",
    "d02_fill_templates", "d07_split_by_group", "d08_split_random", "d15_drop_cross_part", "d18_dataset_stats",
    "d19_exclusive_vocab", "e02_per_class", "e03_average_precision", "e04_summary", "e10_sweep", "e13_parity_total",
    "e14_fertility", "e18_latency_report", "g01_dedupe_entries", "g02_stratified_sample", "t02_latest_per_scan", "t03_trace_index",
    "t06_report_summary", "p04_build_prompts", "w01_dedupe_batch", "w02_cadence", "w07_value_trend",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/part.parquet").count()  # start the engine
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetpulse.plans.catalog import QUERIES
from fleetpulse.session import build_session

HEADLINE = [
    "scan_log_readings", "flat_export", "flatten_samples", "fold_nested_duplicates", "series_aggregates", "feed_meta",
    "sampling_gaps", "logger_health", "threshold_events", "rate_events", "stale_events", "missing_events",
    "source_unavailable_events", "all_rules_events", "hot_feed_events", "top_movers", "digest_documents", "load_bands", "pivot_readings",
    "minute_peaks", "incidents", "escalation_tiers", "notification_decisions", "stream_rule_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start-up is not measured
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

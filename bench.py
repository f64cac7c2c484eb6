"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowtide.checks import queries
from flowtide.session import local_session

HEADLINE = ["flow_sessionize", "flow_features", "flow_idle_sessions", "portscan_probe_count", "alert_dedup", "policy_cascade",
            "alert_aggregate", "traffic_overview", "trend_hourly", "report_distributions", "top_source_ips",
            "preprocess_fit_transform", "stratified_split", "classification_report", "roc_auc", "train_decision_tree", "score_batch"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="flowtide-bench")
    spark.read.parquet(f"{folder}/events.parquet").count()
    known, seconds = queries(), {}
    # One run on the smallest tables first, so that class loading and code generation are not measured.
    warm_up = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(warm_up) else []:
        known[name](spark, warm_up).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(scale[1]) if scale else None}))
    spark.stop()


main()

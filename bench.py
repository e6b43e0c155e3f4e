"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spindle.plans import QUERIES  # noqa: E402
from spindle.session import build_session  # noqa: E402

HEADLINE = (
    "ag1_device_counts",
    "ag2_counts_of_files",
    "prj1_pick_device",
    "tw1_tumbling_windows",
    "ag5_percentiles",
    "ag7_window_characteristics",
    "ag11_trace_characteristic",
    "ds1_ecdf",
    "ds3_sampled_cdf",
    "ds9_tangent_knee",
    "wf1_interarrival",
    "wf18_pending_pages",
    "lb1_label_slow_filtered",
    "fe1_feature_set",
    "wf12_stability",
    "dr8_drifts",
    "ev1_confusion_scores",
    "ev7_confidence_cases",
    "sm1_thinned",
    "snk3_window_files",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, partitions=int(cores))
    spark.read.parquet(f"{folder}/events.parquet").write.format("noop").mode("overwrite").save()  # start the executor
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stormline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "resample_mean", "resample_ffill", "combine_priority", "interp_limit_both", "impute_gap_rule", "drop_long_gaps", "run_segments",
    "rolling_mean", "rolling_std_samp", "rolling_slope", "lag_diff", "ffill_bfill", "asof_last_event", "merge_features",
    "dst_features_split", "imf_windows", "kp_features", "ssn_windows", "flux_windows", "xray_windows", "cme_windows",
    "storm_onsets", "greedy_spacing", "hazard_labels", "upsert_replace", "dedupe_last", "group_last", "parse_hourly_matrix",
    "parse_json_series", "corr_pairs", "pr_curve", "average_precision", "cumulative_prob", "filter_date_range", "retention",
]


def main() -> None:
    from queries import load

    known, _ = load()
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    times = {}
    for name in wanted:
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 4)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

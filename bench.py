"""Headline queries at one scale, and steps beside their obvious forms: prints a single JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name-prefix ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bench_compare import compare  # noqa: E402
from signalloom.catalog import QUERIES  # noqa: E402
from signalloom.session import build_session, set_scratch  # noqa: E402

HEADLINE = [
    "entry_subject_alarms",
    "w1_sessionize_positives",
    "w5_merge_intervals",
    "j4_event_match_join",
    "g6_label_windows",
    "r13_event_metrics",
    "r2_threshold_sweep",
    "r3_r4_ranking_metrics",
    "r10_per_subject_metrics",
    "a12_score_distribution_by_subject",
    "a1_subject_summary",
    "a8_channel_moments",
    "a17_window_quality",
    "d3_duplicate_keys",
    "g3_bandpass",
    "g4_zscore_chunks",
    "g5_windows_from_chunks",
    "g11_fft_features",
    "g13_stft_power",
    "g15_w8_sequences",
    "j2_position_mapping",
    "k4_stratified_sample",
    "k5_balanced_resample",
    "s2_read_annotations",
    "x1_j10_perturbation_masks",
    "x3_weighted_ridge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = HEADLINE
    if sys.argv[1:]:
        names = [n for n in QUERIES if n.startswith(tuple(sys.argv[1:]))]
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    set_scratch(spark)
    QUERIES["r1_confusion"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs):
            spark.catalog.clearCache()  # each run does all its work
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.catalog.clearCache()
    beside = {} if sys.argv[1:] else compare(spark, sf_dir, int(os.environ.get("BENCH_COPIES", "10")), runs)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "chosen_beside_obvious": beside,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries over whole tables and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma list).
Every query runs once to warm up and once timed; its rows are produced in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "a29_window_counts", "w1_w2_a5_impute", "w3_row_windows", "a5_median_fallback", "s10_split_summary",
    "r2_w5_sampled_index", "r5_balanced_ratio", "x1_frame_statistics", "x5_sequence", "c10_window_phrase", "a6_train_scaler",
    "m1_best_threshold", "m3_curve_threshold", "a14_sum_rounds", "m6_o6_reconstruct",
    "l6_assign_and_novelty", "j4_embedding_prototypes", "j11_nearest_neighbours", "c7_neighbour_vote", "k2_s4_window_store",
    "m11_u7_parameter_sweep", "m11_sweep_rates", "k7_w1_w3_incremental_windows", "s1_scan_daily_logs", "ttf_table_shared_indices", "status_table_all_rounds",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from fleetpulse import get_session
    from fleetpulse.registry import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    catalog.load_all()
    shared = tempfile.TemporaryDirectory(prefix="bench-")  # goes with all tables in it when the run ends
    spark = get_session("bench", f"local[{cpus}]", spark__checkpoint__dir=shared.name, spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__driver__memory="16g",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for run in range(2):
            spark.conf.set("fleetpulse.learned.dir", f"{shared.name}/learned/{name}-{run}")  # learning is part of every timed run
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shared.cleanup()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

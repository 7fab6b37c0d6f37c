"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; names on
the command line replace the default list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from echoframe.catalog import QUERIES
from echoframe.session import build_session

HEADLINE = [
    "convolve_exp", "convolve_exp_long", "convolve_exp_unclipped", "convolve_gamma", "convolve_normal",
    "convolve_skew_normal", "convolve_hrf5", "convolve_lcg", "convolve_two_sources", "convolved_products",
    "window_history", "window_cutoff", "window_one_series", "window_ties", "combined_window",
    "window_event_counts", "cosdist2d", "lag_spillover", "events_with_trial", "filter_conjunction",
    "filter_count", "standardised", "composed_transforms", "dummies", "interactions", "partition_mod",
    "ols_coefs", "ablation_family", "kernel_candidates", "evaluate_partitions", "baseline_merge_ols",
    "random_effects", "loglik_continuous", "correlation_matrix", "permutation_p", "bootstrap_coefs",
    "adjusted_p", "trapezoid_integral",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's compilers, as a running cluster's would be.
    QUERIES["window_history"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()

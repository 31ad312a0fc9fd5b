"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores, BENCH_REPEATS the timed runs per query (median is reported) and
BENCH_QUERIES a comma-separated choice of catalogue names.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "library_size",
    "qc_cells",
    "normalise_log1p",
    "top_variance_features",
    "treatment_shift",
    "proxy_matrix",
    "group_mean_baseline",
    "baseline_suite",
    "mean_feature_pearson",
    "calibration_error",
    "correlation_graph",
    "extract_windows",
    "rank_bins",
    "split_all",
    "leakage_report",
    "auroc",
    "embed_cells",
    "iv_graph",
    "bootstrap_intervals",
    "predict_distribution",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)

    from treatlens.plans.catalogue import QUERIES
    from treatlens.session import local_session

    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["library_size"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's compilers

    times: dict[str, float] = {}
    for name in chosen:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)),
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()

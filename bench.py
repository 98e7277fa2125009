"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up; the figure is the median of three runs after that
(``$BENCH_RUNS`` changes the number).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import load_all  # noqa: E402
from cohortry.session import build_session  # noqa: E402

HEADLINE = (
    "c3_cohort",
    "c4_drug_flags",
    "c7_final_flags",
    "c9_drug_rates",
    "c11_numeric_by_group",
    "c13_stratum_report",
    "t14_kruskal",
    "a12_describe",
    "j17_knn_exact",
    "m6_kmeans_sweep",
    "m10_dbscan",
    "m14_silhouette",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, _ = load_all()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries, median of runs after a warm-up",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

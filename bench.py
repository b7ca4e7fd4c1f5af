"""Times of the headline queries as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads, ``BENCH_RUNS`` the runs after a
first one that warms up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from cohortframe.session import local_session
from driver_queries import QUERIES

HEADLINE = [
    "S22_population_shares",
    "D7_crosstab_with_zeros",
    "D8_pseudobulk",
    "D2_distinct_count",
    "D10_group_profile",
    "D11_box_stats",
    "W4_average_ranks",
    "C2_W3_zscore_vs_global",
    "C3_join_features",
    "C5_attach_by_ordinal",
    "W5_benjamini_hochberg",
    "X1_D10_long_profile",
    "S1_marker_welch_t",
    "S2_marker_wilcoxon",
    "S6_tmm_factors",
    "S9_S10_paired_de",
    "S11_enrichment",
    "S12_rank_score",
    "S18_label_transfer",
    "S19_shared_neighbour_graph",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "12g"))
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    line = {
        "metric": "headline queries, warm median",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

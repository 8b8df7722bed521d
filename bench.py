"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from kadenz.plans import catalog
from kadenz.session import local_session

HEADLINE = (
    "j5_interval_containment", "j7_nearest_sample", "i1_segments", "a2_statistics_per_interval", "i8_alignment_pipeline", "w1_rolling_statistics", "w5_hop_windows",
    "e3_wilcoxon", "e7_spearman", "e13_accuracy_and_e15_weighted", "e16_auc_one_vs_rest", "e19_metric_selection", "e20_metrics_over_clusters", "r1_poisson_bootstrap", "r2_clustered_bootstrap",
    "r5_conformal_sets", "x4_stratified_split", "a20_lexicon_shares", "v10_similarities", "h1_grid_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    found, names = catalog.queries(), sys.argv[1:] or HEADLINE
    run = lambda n: found[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(names[0])  # starts the JVM's code paths and the file cache
    times = {}
    for n in names:
        began = time.perf_counter()
        run(n)
        times[n] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

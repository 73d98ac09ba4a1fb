"""Time the headline queries and print one JSON line.

Each query is run to the end into the ``noop`` sink, after one small warm-up query.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from haptrace.plans import registry  # noqa: E402
from haptrace.session import build_session  # noqa: E402

HEADLINE = [
    "touch_features_end_to_end", "statistical_features", "velocity_and_acceleration", "mean_before_activity", "session_forward_fill",
    "cartesian_labels", "outlier_bounds", "response_tuning", "tuning_bins", "nearest_vertex", "touch_response_maps", "population_heatmap",
    "grid_response_maps", "cell_intensity", "bias_test", "precision_test", "distribution_test", "kruskal_wallis",
    "raster_derivatives", "centroid_quality", "quadratic_fit", "line_fit",
    "cell_metrics", "spatial_tuning", "dbscan_clusters", "kmeans_clusters", "mann_whitney",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf).name.removeprefix("sf")}))


main()

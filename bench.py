"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "s03_grid_scan",
    "s04_grid_to_rows",
    "a02_daily_mean_right_closed",
    "a03_grid_average",
    "a04_monthly_climatology",
    "a10_station_metrics",
    "a14_metric_medians",
    "a17_box_stats",
    "a22_sweep_metrics",
    "w01_rolling_sum",
    "w03_temporal_split",
    "w07_match_moments",
    "w09_interpolate",
    "w10_upsample_daily",
    "w11_sequence_windows",
    "m01_spatial_split",
    "m07_stratified_folds",
    "j02_assemble_features",
    "j04_extract_points",
    "j05_reconcile",
    "j06_regrid_bilinear",
    "j07_merge_products",
    "c01_monthly_maps",
    "c04_metric_collection",
    "c06_discussion_summary",
    "m13_product_baseline",
    "m14_predict_grid",
    "m15_predict_ensemble_linear",
    "x01_partial_dependence",
    "x03_accumulated_effects",
    "x04_permutation_importance",
    "x05_shapley_importance",
    "x06_station_top_features",
]


def main() -> None:
    from geoseries.session import build_session
    from geoseries.suite import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = os.path.abspath("spark-warehouse/_shared")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": shared,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("flagship_station_scores")  # warm-up: JVM, code generation, file listing
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

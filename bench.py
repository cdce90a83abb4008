"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumetrics.plans.registry import QUERIES  # noqa: E402
from plumetrics.session import build_session  # noqa: E402

HEADLINE = (
    "scan_parquet", "ingest_gate", "left_join_dim", "left_join_monthly", "group_site_season_tod", "median_by_group",
    "quartiles", "robust_range", "impact_score", "median_quadrant", "topk_extremes", "systematic_sample",
    "city_month_mean", "median_of_medians", "proximity_pairs", "spatial_clusters", "cluster_stats", "nearest_within",
    "ols_global", "ols_by_season", "ols_interaction", "ols_by_season_no2", "season_report", "stream_city_month",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "plumetrics-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__sql__files__maxPartitionBytes="16m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_non_missing"](spark, sf_dir).collect()  # start-up is not what is measured
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

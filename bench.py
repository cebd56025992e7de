"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores; BENCH_ALL=1 times every registered query;
BENCH_RUNS sets the warm runs whose median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from rainshed.session import local_session

HEADLINE = [
    "precip_comparison", "precip_comparison_sum", "basin_mean", "basin_cumulative", "basin_mask_keep", "wrf_hourly_precip",
    "daily_mean_temp", "daily_precip_positive", "water_year_total", "water_year_peak", "merge_variables", "hrrr_merge",
    "station_cube", "embed_dem_regular", "embed_dem_irregular", "nearest_cell_series", "manifest_wrf", "manifest_gaps",
    "hrrr_cube", "wrf_cube", "prism_cube", "ornl_cube", "snotel_cube", "storm_map", "text_grid", "cube_roundtrip",
    "pnnl_cube", "event_slices_table", "station_request", "dem_clip", "open_store", "event_slices_store", "precip_by_grid", "nearest_cells_table",
    "store_replace", "store_merge", "point_series_store", "series_scan", "event_totals", "download_plan", "basin_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus.isdigit() else 8)
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:] or taken), 3)
    print(json.dumps({
        "metric": "total_warm_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

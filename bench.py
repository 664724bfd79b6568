"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the number of
local cores (default: all). Every query computes its whole result; the smaller of two runs
counts, so that the first one's code generation does not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandara.queries import QUERIES  # noqa: E402
from demandara.session import build_session  # noqa: E402

HEADLINE = [
    "a01_daily_demand", "s02_stock_latest_day", "a06_inventory_summary", "a12_alert_board",
    "l04_alert_trim", "i01_safety_stock", "i04_abc_xyz", "p01_series_filter",
    "s08_ingest_consumption", "w01_lags", "w05_rolling_extended", "w07_ewma",
    "w15_moving_avg_baseline", "m01_feature_matrix", "m03_short_series_fallback",
    "m05_ridge_test_metrics", "m19_mass_forecast", "m09_trend_test_metrics",
    "m11_seasonal_ar", "d01_quality_score", "d04_outlier_mad", "d05_outlier_isolation",
    "d10_anomalies_by_material", "e06_walk_forward", "e06_walk_forward_linear",
    "e12_temporal_cv", "e13_search_ridge", "m21_forecast_run",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR"})
    times = {}
    for key in wanted:
        runs = []
        for _ in range(2):
            start = time.time()
            QUERIES[key].run(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[key] = round(min(runs), 3)
        print(f"{key}: {runs[0]:.2f} {runs[1]:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total time of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

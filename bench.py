"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandgrid.catalog import QUERIES, load_all  # noqa: E402
from demandgrid.session import build_session  # noqa: E402

HEADLINE = (
    "adi_cv2_classes", "demand_statistics", "mean_band_filter", "quantile_positive_filter", "sale_interval_stats",
    "hierarchy_rollup", "seasonal_profiles", "monthly_change_signs", "periods_since_last_sale", "rolling_stats",
    "features_with_calendar_and_prices", "price_level_demand", "event_impact", "similar_series_in_store",
    "baseline_backtest", "evaluate_all_grains", "in_sample_scaled_by_cutoff", "ridge_backtest", "column_profile",
    "numeric_description", "dataset_features", "one_lag_search", "ridge_forecast_one_lag")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # start the executor before the clock
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

"""Timings of the headline queries over one data folder; prints one JSON line.

``prepare_orders`` reads the raw tables, joins, de-duplicates and stores the orders;
``prepare_enriched`` engineers and stores the features. The other queries read these stored
tables, as a dashboard would. Every result is computed in full and discarded.
``etl_chain`` is the whole chain over stored raw tables: load, validate, engineer, roll up,
save. Storing the raw tables for it is not timed. The four models are trained at full size on
the folder in ``BENCH_MODELS_DIR`` (6,000 rows by default; 60,000 are about the sample the published
training time is for).
"""

from __future__ import annotations

import json
import os
import time

from lastleg.ml import train
from lastleg.plans import etl
from lastleg.plans.registry import QUERIES
from lastleg.plans.warehouse import warehouse
from lastleg.session import build_session, new_stage_path, release_stages
from lastleg.sources import tables

HEADLINE = (
    "city_daily_kpis", "vw_sla_monitoring", "store_daily_load", "geo_grid", "kpis_by_city",
    "rider_performance", "store_performance", "hourly_stress", "vw_rider_performance",
    "weather_nearest", "recommendations", "filter_last_30d", "stratified_split", "clf_metrics", "delivery_clusters",
)


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads

    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    w = warehouse(spark, data_dir)
    timed("prepare_orders", lambda: w.orders)
    timed("prepare_enriched", lambda: w.enriched)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, data_dir).write.format("noop").mode("overwrite").save())
    raw, derived = new_stage_path(spark, "raw"), new_stage_path(spark, "derived")
    tables.save_tables(w.raw, raw, tables.RAW_TABLES)
    timed("etl_chain", lambda: etl.run(spark, raw, derived))
    models_dir = os.environ.get("BENCH_MODELS_DIR", "/root/testdata/sf0.001")
    small = warehouse(spark, models_dir)
    timed("model_table", lambda: small.model_table)
    timed("train_models", lambda: train.train_all(small.model_table))
    release_stages(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(data_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Shape of the physical plans of the heavy queries."""

import re

import pytest

from conftest import DATA
from lastleg.plans.registry import QUERIES
from lastleg.plans.warehouse import refresh, warehouse
from lastleg.session import release_stages

# Queries that train models or write tables run jobs while they are built.
LAZY = sorted(set(QUERIES) - {
    "ml_late", "ml_breach", "ml_delay", "ml_congestion", "model_results", "model_status", "model_top_features",
    "score_orders", "saved_tables", "etl_run", "delivery_clusters", "star_schema", "load_with_fallback",
})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan


def test_scan_reads_only_needed_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(warehouse(spark, DATA).city_daily.select("*"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    columns = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", plan).group(1)))
    assert columns == {
        "order_id", "created_at", "city", "is_late", "actual_delivery_min", "delay_minutes", "total_cost_inr",
        "congestion_factor", "route_efficiency_score"}


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_city"](spark, DATA))
    assert "EqualTo(city,Mumbai)" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(QUERIES["filter_last_30d"](spark, DATA))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("created_at" in f for f in re.findall(r"DataFilters: \[(.*?)\], Format", plan))


@pytest.mark.parametrize("name", ["city_daily_kpis", "hourly_stress", "geo_grid", "vw_sla_monitoring", "kpis_by_city", "hourly_demand"])
def test_rows_are_combined_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "partial_" in plan.split("Exchange hashpartitioning", 1)[1]


def test_facts_stay_in_place_for_small_lookups(spark):
    plan = plan_of(QUERIES["join_rider"](spark, DATA))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_split_does_not_shuffle_facts(spark):
    plan = plan_of(QUERIES["stratified_split"](spark, DATA))
    outer = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in outer and "Sort" not in outer


@pytest.mark.parametrize("name", ["filter_last_30d", "filter_combined", "q1_congested_zones"])
def test_relative_dates_skip_folders(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("order_date" in f for f in filters)


@pytest.mark.parametrize("name", ["store_daily_load", "weather_nearest", "city_hour_congestion"])
def test_lookups_are_derived_once(spark, name):
    """The finished query reads the stored lookup; the aggregate over the facts is not in its plan."""
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "HashAggregate" not in plan and "Window" not in plan


def test_queries_run_after_a_release(spark):
    before = QUERIES["city_daily_kpis"](spark, DATA).count()
    release_stages(spark)
    assert QUERIES["city_daily_kpis"](spark, DATA).count() == before
    assert refresh(spark, DATA) is warehouse(spark, DATA)

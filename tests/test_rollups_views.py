import datetime as dt
from decimal import Decimal as D

import pytest

from lastleg.operators import features, filters, rollups
from lastleg.plans import datasets, views


def test_null_keys_are_dropped(make_orders):
    df = make_orders({}, {"dark_store_id": None, "rider_id": None, "city": None, "hour_of_day": None})
    assert rollups.city_daily_kpis(df).count() == 1
    assert rollups.rider_performance(df).count() == 1
    assert rollups.hourly_stress(df).count() == 1
    assert rollups.store_performance(features.join_store_load(df, True)).count() == 1


def test_sum_of_nothing_is_zero(make_orders):
    row = rollups.city_daily_kpis(make_orders({"total_cost_inr": None, "is_late": None})).first()
    assert (row.total_cost_inr, row.late_orders, row.cost_per_order) == (0.0, 0, 0.0)


def test_peak_load_falls_back_to_order_count(make_orders):
    assert rollups.store_performance(make_orders({}, {})).first().peak_load == 2


def test_utilization_is_relative_to_the_busiest(make_orders):
    df = make_orders(*[{"rider_id": "A"}] * 5, {"rider_id": "B"})
    got = {r.rider_id: r.utilization_score for r in rollups.rider_performance(df).collect()}
    assert got == {"A": 1.0, "B": 0.25}


def tables(spark, make_orders):
    riders = spark.createDataFrame(
        [("R1", "Mumbai", 3, "Cycle", "Night", 4.0), ("R2", "Pune", 5, "Cycle", "Night", 3.0)],
        "rider_id string, city string, experience_months int, vehicle_type string, shift_type string, rating double")
    stores = spark.createDataFrame(
        [("DS1", "Mumbai", "Tier-1", 0, 2.5), ("DS2", "Pune", "Tier-2", 10, 2.5)],
        "store_id string, city string, tier string, max_capacity int, zone_coverage_km double")
    return {"orders": make_orders({"is_late": 1}, {}, {}), "riders": riders, "stores": stores}


def test_riders_and_stores_without_orders_stay(spark, make_orders):
    t = tables(spark, make_orders)
    idle = views.view(spark, "vw_rider_performance", **t).where("rider_id = 'R2'").first()
    assert (idle.total_deliveries, idle.late_deliveries, idle.late_rate_pct) == (0, None, None)
    busy = views.view(spark, "vw_rider_performance", **t).where("rider_id = 'R1'").first()
    assert (busy.total_deliveries, busy.late_deliveries, busy.late_rate_pct) == (3, 1, 33.33)
    load = {r.store_id: r.monthly_capacity_util_pct for r in views.view(spark, "vw_store_load_analysis", **t).collect()}
    assert load == {"DS1": None, "DS2": 0.0}       # zero capacity gives no value, not an error


def test_views_register(spark, make_orders):
    for name in views.create_views(spark, **tables(spark, make_orders)):
        assert spark.table(name).count() >= 0
        spark.catalog.dropTempView(name)


def test_invariants(spark):
    from conftest import DATA
    from lastleg.plans.warehouse import warehouse
    w = warehouse(spark, DATA)
    assert w.city_daily.agg({"total_orders": "sum"}).first()[0] == w.orders.count() == w.enriched.count()
    assert w.city_daily.where("late_rate < 0 OR late_rate > 1").count() == 0
    assert w.rider_performance.where("utilization_score < 0 OR utilization_score > 1").count() == 0


def test_filters(make_orders):
    df = make_orders(
        {"created_at": dt.datetime(2024, 3, 31, 12)}, {"created_at": dt.datetime(2024, 3, 1, 12)},
        {"created_at": dt.datetime(2024, 3, 1, 11, 59)}, {"city": "Delhi", "order_type": "standard", "created_at": dt.datetime(2023, 1, 1)})
    assert filters.OrderFilter().apply(df).count() == 4
    assert filters.OrderFilter(date_preset="Last 30 Days").apply(df).count() == 2
    assert filters.OrderFilter(city="Delhi", date_preset="Last 30 Days").apply(df).count() == 1
    assert filters.OrderFilter(order_types=("standard",)).apply(df).count() == 1
    assert filters.by_city(df, "Pune").count() == 0
    assert filters.by_city(df, "Pune", fall_back=True).count() == 4
    assert filters.by_city(df, "Delhi", fall_back=True).count() == 1
    assert filters.by_city(df, "All").count() == 4


def test_congested_zones_defaults(make_orders):
    df = make_orders(*[{}] * 51, *[{"delivery_lat": D("20.000000")}] * 50)
    assert [(r.lat_bin, r.order_count) for r in views.congested_zones(df).collect()] == [(19.0, 51)]


def test_sparse_pivot_is_zero(make_orders):
    row = datasets.hourly_pivot(make_orders({}, {"hour_of_day": 3})).first()
    assert (row.h12, row.h03, row.h04) == (1, 1, 0) and len(row) == 25


def test_delay_histogram_keeps_the_last_edge(make_orders):
    df = make_orders({"is_late": 1, "delay_minutes": D("60.0")}, {"is_late": 1, "delay_minutes": D("99.0")}, {"is_late": 1})
    got = {r.bin: (r.orders, r.density) for r in datasets.delay_hist(df).collect()}
    assert got == {0: (1, 1 / 4.5), 39: (2, 2 / 4.5)}


def test_trend_falls_back_to_all_cities(make_orders):
    daily = rollups.city_daily_kpis(make_orders({}, {"city": "Delhi"}))
    assert datasets.daily_volume_late(daily, "Pune").first().total_orders == 2
    assert datasets.daily_volume_late(daily, "Delhi").first().total_orders == 1
    assert datasets.sla_trend(daily, "Pune").count() == 0

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lastleg import settings
from lastleg.operators import kpi, rules


def one(df):
    return df.first().asDict()


def test_hand_made_kpis(spark, make_orders):
    df = make_orders(
        {"is_late": 1, "delay_minutes": D("12.5"), "weather_delay_min": D("6.0")},
        {"is_late": 1, "delay_minutes": D("4.0"), "is_peak_hour": 0, "created_at": dt.datetime(2024, 1, 4, 11, 59)},
        {"is_peak_hour": 0}, {},
    )
    riders = spark.createDataFrame([("a", True), ("b", False)], "rider_id string, is_active boolean")
    stores = spark.createDataFrame([(10, 300), (20, 100)], "total_orders bigint, max_capacity int")
    got = one(kpi.compute_kpis(df, riders, stores))
    assert list(got) == list(kpi.KPI_NAMES)
    assert got["on_time_delivery_rate"] == 50.0
    assert got["sla_breach_pct"] == 25.0
    assert got["avg_delay_minutes"] == round((12.5 + 4.0) / 2, 1)
    assert got["throughput_per_day"] == 2          # 2 full days between first and last
    assert got["peak_hour_stress_score"] == 1.0
    assert got["weather_disruption_score"] == 25.0
    assert got["rider_utilization_pct"] == round(4 / (1 * 40 * 30) * 100, 1)
    assert got["dark_store_utilization_pct"] == round(15 / (200 * 30) * 100, 1)
    assert got["total_orders_analyzed"] == 4


def test_edge_cases(make_orders):
    got = one(kpi.compute_kpis(make_orders({}, {})))
    assert got["throughput_per_day"] == 2          # a single day counts as one
    assert got["avg_delay_minutes"] == 0.0         # nothing late
    assert got["peak_hour_stress_score"] == 2.0    # no off-peak orders: divide by one
    assert got["rider_utilization_pct"] == 74.2 and got["dark_store_utilization_pct"] == 68.3


def test_no_orders_no_row(make_orders):
    df = make_orders({})
    assert kpi.compute_kpis(df, city="Pune").count() == 0
    assert kpi.compute_kpis(df.where("false"), by=("city",)).count() == 0


def test_missing_columns_take_constants(make_orders):
    df = make_orders({"is_late": 1}, {}, drop=(
        "route_efficiency_score", "prep_time_min", "total_cost_inr", "congestion_factor", "weather_delay_min", "is_peak_hour", "delay_minutes"))
    got = one(kpi.compute_kpis(df))
    for name in ("route_inefficiency_score", "fulfillment_latency_min", "cost_per_shipment_inr", "congestion_impact_factor", "weather_disruption_score"):
        assert got[name] == settings.KPI_DEFAULTS[name]
    assert got["sla_breach_pct"] == 50.0           # without delays every late order counts
    assert got["peak_hour_stress_score"] == 1.0    # all rows stand for both sides


def test_riders_without_activity_flag_or_rows(spark, make_orders):
    df = make_orders({})
    all_active = spark.createDataFrame([("a",)], "rider_id string")
    assert one(kpi.compute_kpis(df, all_active))["rider_utilization_pct"] == round(1 / 1200 * 100, 1)
    assert one(kpi.compute_kpis(df, all_active.where("false")))["rider_utilization_pct"] == 74.2


def test_bands_and_health(make_orders):
    kpis = kpi.compute_kpis(make_orders({}), by=("city",))
    bands = {r.kpi: r.band for r in kpi.kpi_bands(kpis).collect()}
    assert bands["on_time_delivery_rate"] == "success" and bands["dark_store_utilization_pct"] == "success"
    health = {r.metric: (r.actual, r.target) for r in kpi.health_matrix(kpis).collect()}
    assert health["On-Time Rate"] == (100.0, 88.0) and health["Route Efficiency"][0] == 100.0
    assert set(health) == {"On-Time Rate", "SLA Breach Rate", "Rider Utilization", "Route Efficiency", "Dark Store Capacity"}


CALM = {
    "sla_breach_pct": 5.0, "rider_utilization_pct": 70.0, "dark_store_utilization_pct": 50.0, "route_inefficiency_score": 1.1,
    "congestion_impact_factor": 1.2, "peak_hour_stress_score": 1.0, "weather_disruption_score": 5.0,
}
FIRING = {
    "R1": {"sla_breach_pct": 15.01}, "R2": {"rider_utilization_pct": 54.9}, "R3": {"rider_utilization_pct": 90.1},
    "R4": {"dark_store_utilization_pct": 85.1}, "R5": {"route_inefficiency_score": 1.301}, "R6": {"congestion_impact_factor": 1.451},
    "R7": {"peak_hour_stress_score": 2.01}, "R8": {"weather_disruption_score": 20.1}, "R9": {},
}


def recommend(spark, *rows, **how):
    names = list(CALM)
    data = [(f"c{i}", *[{**CALM, **r}[n] for n in names]) for i, r in enumerate(rows)]
    kpis = spark.createDataFrame(data, ", ".join(["city string", *[f"{n} double" for n in names]]))
    return rules.recommendations(kpis, **how)


def test_each_rule_alone(spark):
    found = recommend(spark, *FIRING.values()).orderBy("city").collect()
    assert [r.rule for r in found] == list(FIRING)


def test_limits_are_exclusive(spark):
    limits = {"sla_breach_pct": 15.0, "rider_utilization_pct": 55.0, "dark_store_utilization_pct": 85.0, "route_inefficiency_score": 1.3,
              "congestion_impact_factor": 1.45, "peak_hour_stress_score": 2.0, "weather_disruption_score": 20.0}
    assert [r.rule for r in recommend(spark, limits).collect()] == ["R9"]


def test_all_rules_in_order(spark):
    every = {k: v for r, d in FIRING.items() if r != "R3" for k, v in d.items()}
    found = recommend(spark, every).orderBy("position").collect()
    assert [r.rule for r in found] == ["R1", "R2", "R4", "R5", "R6", "R7", "R8"]
    assert [r.position for r in found] == list(range(7))


def test_texts_format_values_like_python(spark):
    rows = [{"sla_breach_pct": v} for v in (15.25, 15.35, 15.05, 16.0)]
    titles = [r.title for r in recommend(spark, *rows).orderBy("city").collect()]
    assert titles == [f"SLA Breach Rate Critical ({v:.1f}%)" for v in (15.25, 15.35, 15.05, 16.0)]
    text = recommend(spark, {"sla_breach_pct": 20.0}).first()
    assert "in c0." in text.description and text.icon == "🔴"


def test_thresholds_are_arguments(spark):
    assert [r.rule for r in recommend(spark, {}, thresholds={"congestion_high": 1.0}).collect()] == ["R6"]


def test_absent_kpis_take_defaults(spark):
    kpis = spark.createDataFrame([("x",)], "city string")
    assert [r.rule for r in rules.recommendations(kpis).collect()] == ["R9"]

"""Rollup tables by city and day, rider, store, and city and hour.

Every rollup is one partial and one final hash aggregate: a hot key is combined inside each
map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lastleg.functions import dates
from lastleg.functions.numeric import clip, dbl, exact_avg, np_round, ratio, total
from lastleg.operators.joins import lookup_join


def _present(df: DataFrame, *keys: str) -> DataFrame:
    return df.na.drop("any", subset=list(keys))


def city_daily_kpis(orders: DataFrame) -> DataFrame:
    daily = _present(orders.withColumn("date", dates.day("created_at")), "city", "date")
    out = daily.groupBy("city", "date").agg(
        F.count("order_id").alias("total_orders"),
        total("is_late").cast("bigint").alias("late_orders"),
        exact_avg("actual_delivery_min").alias("avg_delivery_min"),
        exact_avg("delay_minutes").alias("avg_delay_min"),
        total("total_cost_inr").cast("double").alias("total_cost_inr"),
        exact_avg("congestion_factor").alias("avg_congestion"),
        exact_avg("route_efficiency_score").alias("avg_route_efficiency"),
    )
    return out.withColumns({
        "late_rate": np_round(ratio("late_orders", "total_orders"), 4),
        "cost_per_order": np_round(ratio("total_cost_inr", "total_orders"), 2),
    })


def rider_performance(orders: DataFrame) -> DataFrame:
    by_rider = _present(orders, "rider_id").groupBy("rider_id")
    busiest = (
        by_rider.agg(F.count("order_id").alias("n")).select((F.max("n") * F.lit(0.8)).alias("full_load")).scalar()
    )
    out = by_rider.agg(
        F.count("order_id").alias("total_deliveries"),
        total("is_late").cast("bigint").alias("late_deliveries"),
        exact_avg("actual_delivery_min").alias("avg_delivery_min"),
        exact_avg("delivery_distance_km").alias("avg_distance_km"),
        total("total_cost_inr").cast("double").alias("total_earnings_inr"),
        exact_avg("customer_rating").alias("avg_rating"),
    )
    return out.withColumns({
        "late_rate": np_round(ratio("late_deliveries", "total_deliveries"), 4),
        "utilization_score": np_round(clip(ratio(F.col("total_deliveries"), busiest), 0.0, 1.0), 4),
    })


def store_performance(
    orders: DataFrame, stores: DataFrame | None = None, small: bool | None = None, day_counts: DataFrame | None = None,
) -> DataFrame:
    """Per store, from enriched orders; without the daily load the order count stands in.

    ``day_counts``, the orders by store and day, give the peak of plain orders without a load for each of them.
    """
    peak = F.max("store_daily_load") if "store_daily_load" in orders.columns else F.count("order_id")
    out = _present(orders, "dark_store_id").groupBy("dark_store_id").agg(
        F.count("order_id").alias("total_orders"),
        total("is_late").cast("bigint").alias("late_orders"),
        exact_avg("prep_time_min").alias("avg_prep_time"),
        *([peak.alias("peak_load")] if day_counts is None else []),
    )
    if day_counts is not None:
        peaks = day_counts.groupBy("dark_store_id").agg(F.max("store_daily_load").alias("peak_load"))
        out = out.join(peaks, "dark_store_id", "left")
    out = out.withColumn("sla_breach_rate", np_round(ratio("late_orders", "total_orders"), 4))
    if stores is None:
        return out
    attributes = stores.select(
        F.col("store_id").alias("dark_store_id"), "store_id", "city", "latitude", "longitude", "max_capacity", "tier")
    # One row per store on both sides: no key can be hot.
    return out.join(attributes, "dark_store_id", "left")


def hourly_stress(orders: DataFrame) -> DataFrame:
    by_hour = _present(orders, "city", "hour_of_day").groupBy("city", "hour_of_day")
    busiest = by_hour.agg(F.count("order_id").alias("n")).select(F.max("n")).scalar()
    out = by_hour.agg(
        F.count("order_id").alias("orders_per_hour"),
        exact_avg("is_late").alias("late_rate"),
        exact_avg("congestion_factor").alias("avg_congestion"),
        exact_avg("weather_delay_min").alias("avg_weather_delay"),
    )
    return out.withColumn("stress_score", np_round(
        ratio(F.col("orders_per_hour"), busiest) * F.lit(0.4)
        + F.col("late_rate") * F.lit(0.35)
        + (F.col("avg_congestion") - F.lit(1.0)) / F.lit(0.8) * F.lit(0.25),
        4,
    ))

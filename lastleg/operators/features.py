"""Feature engineering: the enriched orders table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lastleg import settings
from lastleg.functions import dates
from lastleg.functions.numeric import clip, dbl, exact_avg, np_round
from lastleg.operators.joins import lookup_join
from lastleg.session import stage

ENGINEERED = (
    "hour_sin", "hour_cos", "day_sin", "day_cos", "week_of_year", "quarter",
    "is_express", "is_high_distance", "distance_per_min", "delay_ratio", "efficiency_gap",
    "experience_months", "base_efficiency_score", "rating",
    "store_daily_load", "city_hour_avg_congestion", "late_risk_score",
)


def time_features() -> dict[str, Column]:
    hour_sin, hour_cos = dates.cycle("hour_of_day", 24)
    day_sin, day_cos = dates.cycle("day_of_week", 7)
    return {
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos,
        "week_of_year": F.weekofyear("created_at"), "quarter": F.quarter("created_at"),
    }


def operational_flags() -> dict[str, Column]:
    return {
        "is_express": (F.coalesce(F.col("order_type"), F.lit("")) == "express").cast("int"),
        "is_high_distance": F.coalesce(F.col("delivery_distance_km") > settings.HIGH_DISTANCE_KM, F.lit(False)).cast("int"),
    }


def ratio_features() -> dict[str, Column]:
    return {
        "distance_per_min": np_round(dbl("delivery_distance_km") / clip(dbl("actual_delivery_min"), low=1.0), 4),
        "delay_ratio": np_round(dbl("delay_minutes") / clip(dbl("sla_minutes"), low=1.0), 4),
        "efficiency_gap": np_round(dbl("route_efficiency_score") - F.lit(1.0), 4),
    }


def late_risk_score() -> Column:
    return np_round(
        dbl("congestion_factor") * F.lit(0.35)
        + dbl("route_efficiency_score") * F.lit(0.25)
        + (dbl("weather_delay_min") / F.lit(30.0)) * F.lit(0.20)
        + dbl("is_peak_hour") * F.lit(0.20),
        4,
    )


def join_riders(
    orders: DataFrame, riders: DataFrame | None, small: bool | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Rider attributes by rider id; constants when there is no rider table."""
    if riders is None:
        return orders.withColumns({name: F.lit(v) for name, v in settings.RIDER_DEFAULTS.items()})
    attributes = riders.select("rider_id", *settings.RIDER_DEFAULTS)
    return lookup_join(orders, attributes, "rider_id", small=small, keys_from=source)


def per_rider_row(orders: DataFrame, riders: DataFrame) -> DataFrame:
    """Orders as often as ``join_riders`` gives them: once for each row of their rider. Only riders with several rows are joined."""
    times = riders.where(F.col("rider_id").isNotNull()).groupBy("rider_id").agg(F.count("*").alias("_times")).where("_times > 1")
    times = stage(times, "repeated_riders")
    if times.isEmpty():
        return orders
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_times", F.lit(1)))).alias("_copy")
    return lookup_join(orders, times, "rider_id").select(*orders.columns, each).drop("_copy")


def store_day_counts(orders: DataFrame) -> DataFrame:
    return (
        orders.select("dark_store_id", dates.day("created_at").alias("_day"))
        .na.drop("any")
        .groupBy("dark_store_id", "_day")
        .agg(F.count("*").alias("store_daily_load"))
    )


def join_store_load(orders: DataFrame, small: bool | None = None, source: DataFrame | None = None) -> DataFrame:
    """Orders of the same store on the same day; null where the store is unknown.

    A count per store and day is joined back, rather than a window over the orders, so a
    store with a large share of all orders never has to fit one task.
    """
    source = orders if source is None else source
    day = dates.day("created_at")
    joined = lookup_join(
        orders.withColumn("_day", day), store_day_counts(source), ["dark_store_id", "_day"], small=small,
        keys_from=source.withColumn("_day", day))
    return joined.drop("_day")


def city_hour_congestion(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("city").isNotNull() & F.col("hour_of_day").isNotNull())
        .groupBy("city", "hour_of_day")
        .agg(exact_avg("congestion_factor").alias("city_hour_avg_congestion"))
    )


def join_city_congestion(orders: DataFrame, small: bool | None = None, source: DataFrame | None = None) -> DataFrame:
    source = orders if source is None else source
    return lookup_join(orders, city_hour_congestion(source), ["city", "hour_of_day"], small=small, keys_from=source)


def engineer(
    orders: DataFrame, riders: DataFrame | None = None, small: bool | None = None, averages_over: DataFrame | None = None,
) -> DataFrame:
    """Orders with all engineered columns.

    ``orders`` is read several times (rows, store-day counts, city-hour means), each time with
    only the columns needed, so pass a stored table. ``small`` forces the join strategy of
    every lookup; by default each lookup's size is checked. Where ``orders`` holds some days only, whole ones,
    ``averages_over`` names all orders for the city-hour means.
    """
    rows = orders.withColumns({
        **time_features(), **operational_flags(), **ratio_features(), "late_risk_score": late_risk_score(),
    })
    rows = join_riders(rows, riders, small, orders)
    rows = join_store_load(rows, small, orders)
    rows = join_city_congestion(rows, small, orders if averages_over is None else averages_over)
    return rows.select(*orders.columns, *ENGINEERED)

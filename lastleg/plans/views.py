"""The analytical views and report queries, as Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lastleg.functions.numeric import exact_avg
from lastleg.operators.filters import last_days
from lastleg.sources.schemas import DECIMAL_SCALES


def _sum(column: str) -> str:
    scale = DECIMAL_SCALES.get(column)
    return f"SUM({column})" if scale is None else f"SUM(CAST({column} AS DECIMAL(8,{scale})))"


def _avg(column: str) -> str:
    return f"try_divide(CAST({_sum(column)} AS DOUBLE), CAST(COUNT({column}) AS DOUBLE))"


def _num(expression: str, digits: int) -> str:
    """NUMERIC rounding, half away from zero."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _pct(part: str, whole: str, digits: int) -> str:
    return _num(f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)) * 100", digits)


CITY_DAILY = f"""
SELECT city,
       date_trunc('day', created_at) AS date,
       COUNT(*) AS total_orders,
       SUM(is_late) AS late_orders,
       {_num(_avg('actual_delivery_min'), 1)} AS avg_delivery_min,
       {_num(_avg('delay_minutes'), 1)} AS avg_delay_min,
       {_num(_sum('total_cost_inr'), 2)} AS total_revenue_inr,
       {_num(_avg('congestion_factor'), 3)} AS avg_congestion,
       {_num(_avg('route_efficiency_score'), 3)} AS avg_route_efficiency,
       {_pct('SUM(is_late)', 'COUNT(*)', 2)} AS late_rate_pct,
       {_num(f"try_divide(CAST({_sum('total_cost_inr')} AS DOUBLE), COUNT(*))", 2)} AS cost_per_order
FROM {{orders}}
GROUP BY city, date_trunc('day', created_at)
"""

# Orders are reduced to one row per rider (or store) before the join, so the join moves
# rollup rows only and never meets a hot key.
RIDER_PERFORMANCE = f"""
SELECT r.rider_id, r.city, r.experience_months, r.vehicle_type, r.shift_type,
       r.rating AS profile_rating,
       coalesce(o.n, 0) AS total_deliveries,
       o.late AS late_deliveries,
       o.avg_delivery_min, o.avg_distance_km, o.total_earnings_inr, o.avg_customer_rating, o.late_rate_pct
FROM {{riders}} r
LEFT JOIN (
    SELECT rider_id,
           COUNT(order_id) AS n,
           SUM(is_late) AS late,
           {_num(_avg('actual_delivery_min'), 1)} AS avg_delivery_min,
           {_num(_avg('delivery_distance_km'), 2)} AS avg_distance_km,
           {_num(_sum('total_cost_inr'), 2)} AS total_earnings_inr,
           {_num(_avg('customer_rating'), 2)} AS avg_customer_rating,
           {_pct('SUM(is_late)', 'COUNT(*)', 2)} AS late_rate_pct
    FROM {{orders}} WHERE rider_id IS NOT NULL GROUP BY rider_id
) o ON r.rider_id = o.rider_id
"""

STORE_LOAD = f"""
SELECT s.store_id, s.city, s.tier, s.max_capacity, s.zone_coverage_km,
       coalesce(o.n, 0) AS total_orders,
       o.late AS total_late,
       o.avg_prep_time_min, o.avg_congestion, o.sla_breach_rate_pct,
       {_num("try_divide(CAST(coalesce(o.n, 0) AS DOUBLE), CAST(s.max_capacity * 30 AS DOUBLE)) * 100", 1)}
           AS monthly_capacity_util_pct
FROM {{stores}} s
LEFT JOIN (
    SELECT dark_store_id,
           COUNT(order_id) AS n,
           SUM(is_late) AS late,
           {_num(_avg('prep_time_min'), 1)} AS avg_prep_time_min,
           {_num(_avg('congestion_factor'), 3)} AS avg_congestion,
           {_pct('SUM(is_late)', 'COUNT(*)', 2)} AS sla_breach_rate_pct
    FROM {{orders}} WHERE dark_store_id IS NOT NULL GROUP BY dark_store_id
) o ON s.store_id = o.dark_store_id
"""

# The window runs over at most 24 aggregated rows per city.
HOURLY_STRESS = f"""
SELECT city, hour_of_day,
       COUNT(*) AS orders_per_hour_avg,
       {_num(f"{_avg('is_late')} * 100", 2)} AS late_rate_pct,
       {_num(_avg('congestion_factor'), 3)} AS avg_congestion,
       {_num(_avg('weather_delay_min'), 1)} AS avg_weather_delay_min,
       {_num(f'''CAST(COUNT(*) AS DOUBLE) / CAST(MAX(COUNT(*)) OVER (PARTITION BY city) AS DOUBLE) * 0.4D
        + {_avg('is_late')} * 0.35D
        + ({_avg('congestion_factor')} - 1D) / 0.8D * 0.25D''', 4)} AS stress_index
FROM {{orders}}
GROUP BY city, hour_of_day
"""

# First one row per delivery time within a group: the exact percentile then sees each
# distinct time once, however many orders or map tasks a hot group has.
SLA_MONITORING = f"""
WITH by_time AS (
    SELECT city, order_type, date_trunc('week', created_at) AS week, actual_delivery_min,
           COUNT(*) AS n,
           SUM(is_late) AS late,
           SUM(CASE WHEN is_late = 1 THEN CAST(delay_minutes AS DECIMAL(8,1)) END) AS late_delay,
           COUNT(CASE WHEN is_late = 1 THEN delay_minutes END) AS late_n
    FROM {{orders}}
    GROUP BY city, order_type, date_trunc('week', created_at), actual_delivery_min
)
SELECT city, order_type, week,
       SUM(n) AS total_orders,
       SUM(late) AS breached,
       {_pct('SUM(late)', 'SUM(n)', 2)} AS breach_rate_pct,
       {_num('try_divide(CAST(SUM(late_delay) AS DOUBLE), CAST(SUM(late_n) AS DOUBLE))', 1)} AS avg_breach_delay_min,
       {_num('percentile(actual_delivery_min, 0.95D, n)', 1)} AS p95_delivery_min
FROM by_time
GROUP BY city, order_type, week
"""

VIEWS = {
    "vw_city_daily_kpis": CITY_DAILY,
    "vw_rider_performance": RIDER_PERFORMANCE,
    "vw_store_load_analysis": STORE_LOAD,
    "vw_hourly_stress": HOURLY_STRESS,
    "vw_sla_monitoring": SLA_MONITORING,
}


def view(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """The result of one view over the given orders, riders and stores."""
    text = VIEWS[name]
    used = {k: v for k, v in tables.items() if f"{{{k}}}" in text}
    return spark.sql(text, **used)


def create_views(spark: SparkSession, **tables: DataFrame) -> list[str]:
    """Register all views in the session."""
    for name in VIEWS:
        view(spark, name, **tables).createOrReplaceTempView(name)
    return list(VIEWS)


def congested_zones(orders: DataFrame, precision: int = 3, min_orders: int = 50, days: int = 30, top: int = 20) -> DataFrame:
    """The most congested cells of the recent past with enough orders."""
    recent = last_days(orders, days)
    cells = recent.groupBy(
        F.round("delivery_lat", precision).cast("double").alias("lat_bin"),
        F.round("delivery_lon", precision).cast("double").alias("lon_bin"),
    ).agg(
        F.count("*").alias("order_count"),
        exact_avg("is_late").alias("late_rate"),
        exact_avg("congestion_factor").alias("avg_congestion"),
    )
    return cells.where(F.col("order_count") > min_orders).orderBy(F.desc("avg_congestion"), "lat_bin", "lon_bin").limit(top)


def late_riders(rider_view: DataFrame, min_deliveries: int = 50, min_late_pct: float = 20.0) -> DataFrame:
    """Riders who need attention, worst first."""
    return (
        rider_view.where((F.col("total_deliveries") >= min_deliveries) & (F.col("late_rate_pct") > min_late_pct))
        .select("rider_id", "city", "total_deliveries", "late_rate_pct", "avg_delivery_min")
        .orderBy(F.desc("late_rate_pct"), "rider_id")
    )


def city_hours(stress_view: DataFrame, city: str = "Mumbai") -> DataFrame:
    """Late rate and stress of one city by hour."""
    return stress_view.where(F.col("city") == city).select("hour_of_day", "late_rate_pct", "stress_index").orderBy("hour_of_day")

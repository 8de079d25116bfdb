"""Row-level derivations: calendar, SLA, status, cost and duration columns, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lastleg import settings
from lastleg.functions import dates
from lastleg.functions.numeric import clip, dbl, np_round


def calendar_columns(time: str = "created_at") -> dict[str, Column]:
    return {
        "hour_of_day": F.hour(time),
        "day_of_week": dates.weekday0(time),
        "month": F.month(time),
        "is_weekend": (dates.weekday0(time) >= 5).cast("int"),
        "is_peak_hour": dates.is_peak(F.hour(time)).cast("int"),
    }


def promised_minutes(order_type: str = "order_type") -> Column:
    out = None
    for name, minutes in settings.SLA_MINUTES.items():
        out = (F if out is None else out).when(F.col(order_type) == name, F.lit(minutes))
    return out


def lateness(forced: Column) -> tuple[Column, Column]:
    """Late flag and delay minutes; ``forced`` marks deliveries late for another reason."""
    actual, sla = dbl("actual_delivery_min"), promised_minutes().cast("double")
    late = (actual > sla) | forced
    delay = np_round(F.when(late, F.greatest(actual - sla, F.lit(0.0))).otherwise(0.0), 1)
    return late.cast("int"), delay


def delivery_status(failed: Column, late: Column) -> Column:
    return F.when(failed, "failed").when(late, "late").otherwise("on_time")


def order_cost(peak: Column) -> Column:
    """Distance price with the peak surcharge."""
    base = F.lit(settings.COST_BASE) + dbl("delivery_distance_km") * F.lit(settings.COST_PER_KM)
    return F.when(peak, base * F.lit(settings.COST_PEAK_FACTOR)).otherwise(base)


def expected_duration() -> Column:
    """Minutes a delivery should take by distance, congestion, preparation and weather."""
    travel = dbl("delivery_distance_km") / F.lit(settings.TRAVEL_SPEED_KMH) * F.lit(60.0)
    minutes = travel * dbl("congestion_factor") + dbl("prep_time_min") + dbl("weather_delay_min")
    return np_round(clip(minutes, settings.DURATION_MIN, settings.DURATION_MAX), 1)


def labels() -> dict[str, Column]:
    """Targets of the models."""
    return {
        "sla_breach": ((F.col("is_late") == 1) & (F.col("delay_minutes") > settings.BREACH_DELAY_MIN)).cast("int"),
        "high_congestion": (F.col("congestion_factor") > F.lit(settings.HIGH_CONGESTION)).cast("int"),
        "delay_target": clip(dbl("delay_minutes"), 0.0, float(settings.DELAY_TARGET_MAX)),
    }


def row_derivations(orders: DataFrame, forced: Column, failed: Column) -> DataFrame:
    """Recompute the derived columns of each order from its base columns.

    ``forced`` and ``failed`` are draws outside the row: a delivery late for another reason
    than its duration, and a failed one.
    """
    calendar = calendar_columns()
    late, delay = lateness(forced)
    return orders.select(
        "order_id",
        *[c.alias(name) for name, c in calendar.items()],
        promised_minutes().alias("sla_minutes"),
        late.alias("is_late"),
        delay.alias("delay_minutes"),
        np_round(dbl("actual_delivery_min") - dbl("prep_time_min"), 1).alias("travel_time_min"),
        np_round(order_cost(calendar["is_peak_hour"] == 1), 4).alias("distance_cost_inr"),
        delivery_status(failed, late == 1).alias("status"),
    )

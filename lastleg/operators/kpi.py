"""Operational KPIs: one conditional aggregate, for all orders or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lastleg import settings
from lastleg.functions import dates
from lastleg.functions.numeric import clip, dbl, exact_avg, np_round, py_round, ratio
from lastleg.operators.filters import by_city

KPI_NAMES = (
    "on_time_delivery_rate", "avg_delivery_min", "sla_breach_pct", "avg_delay_minutes",
    "route_inefficiency_score", "rider_utilization_pct", "throughput_per_day",
    "fulfillment_latency_min", "peak_hour_stress_score", "cost_per_shipment_inr",
    "congestion_impact_factor", "weather_disruption_score", "dark_store_utilization_pct",
    "total_orders_analyzed",
)


def _mean_or_default(orders: DataFrame, column: str, digits: int, kpi: str) -> Column:
    if column in orders.columns:
        return np_round(exact_avg(column), digits)
    return F.lit(settings.KPI_DEFAULTS[kpi])


def _fleet(riders: DataFrame, by: list[str]) -> DataFrame:
    active = F.col("is_active") if "is_active" in riders.columns else F.lit(True)
    return riders.groupBy(*by).agg(F.count("*").alias("riders"), F.count_if(active).alias("active"))


def _capacity(stores: DataFrame, by: list[str]) -> DataFrame:
    return stores.groupBy(*by).agg(
        ratio(F.sum("total_orders"), F.count("total_orders")).alias("load"),
        ratio(F.sum("max_capacity"), F.count("max_capacity")).alias("capacity"),
    )


def compute_kpis(
    orders: DataFrame,
    riders: DataFrame | None = None,
    stores: DataFrame | None = None,
    city: str = "All",
    by: tuple[str, ...] = (),
    scope_dims: bool = False,
) -> DataFrame:
    """The KPI row of the chosen orders, or one row per group; no row without orders.

    ``stores`` is the store performance table. Rider and store utilization relate to the
    whole fleet and all stores, also for one city; ``scope_dims=True`` with ``by=("city",)``
    relates each city to its own.
    """
    has = set(orders.columns)
    rows = by_city(orders, city)
    if by:
        rows = rows.na.drop("any", subset=list(by))
    late = F.col("is_late") == 1
    late_sum = F.sum("is_late")
    breached = (
        F.sum(F.when(F.col("delay_minutes") > settings.BREACH_DELAY_MIN, F.col("is_late")).otherwise(0))
        if "delay_minutes" in has else late_sum
    )
    n = F.count(F.lit(1))
    if "is_peak_hour" in has:
        peak, off_peak = F.count_if(F.col("is_peak_hour") == 1), F.count_if(F.col("is_peak_hour") == 0)
    else:
        peak, off_peak = n, n
    days = F.greatest(dates.whole_days(F.min("created_at"), F.max("created_at")), F.lit(1))
    weather = (
        ratio(F.count_if(F.col("weather_delay_min") > settings.WEATHER_IMPACT_MIN), n) * 100.0
        if "weather_delay_min" in has else F.lit(settings.KPI_DEFAULTS["weather_disruption_score"])
    )
    delay = exact_avg("delay_minutes", F.when(late, F.col("delay_minutes"))) if "delay_minutes" in has else F.lit(0.0)
    facts = rows.groupBy(*by).agg(
        n.alias("total_orders_analyzed"),
        np_round((F.lit(1.0) - ratio(late_sum, n)) * 100.0, 2).alias("on_time_delivery_rate"),
        np_round(exact_avg("actual_delivery_min"), 1).alias("avg_delivery_min"),
        np_round(ratio(breached, n) * 100.0, 2).alias("sla_breach_pct"),
        F.coalesce(delay, F.lit(0.0)).alias("avg_delay_minutes"),
        _mean_or_default(rows, "route_efficiency_score", 3, "route_inefficiency_score").alias("route_inefficiency_score"),
        F.rint(ratio(n, days)).cast("bigint").alias("throughput_per_day"),
        _mean_or_default(rows, "prep_time_min", 1, "fulfillment_latency_min").alias("fulfillment_latency_min"),
        ratio(peak, F.greatest(off_peak, F.lit(1))).alias("peak_hour_stress_score"),
        _mean_or_default(rows, "total_cost_inr", 2, "cost_per_shipment_inr").alias("cost_per_shipment_inr"),
        _mean_or_default(rows, "congestion_factor", 3, "congestion_impact_factor").alias("congestion_impact_factor"),
        weather.alias("weather_disruption_score"),
    ).where("total_orders_analyzed > 0")

    scoped = scope_dims and by == ("city",)
    facts, fleet = _attach(facts, None if riders is None else _fleet(riders, ["city"] if scoped else []), scoped)
    usable = stores is not None and "total_orders" in stores.columns
    facts, capacity = _attach(facts, _capacity(stores, ["city"] if scoped else []) if usable else None, scoped)
    facts = facts.withColumns({
        "rider_utilization_pct": _rider_utilization(fleet),
        "dark_store_utilization_pct": _store_utilization(capacity),
    })
    # Ratios of counts are scalar numbers: rounded last, on plain columns.
    digits = {"avg_delay_minutes": 1, "peak_hour_stress_score": 2, "weather_disruption_score": 1, "rider_utilization_pct": 1}
    facts = facts.withColumns({name: py_round(name, n) for name, n in digits.items()})
    return facts.select(*by, *KPI_NAMES)


def _attach(facts: DataFrame, dim: DataFrame | None, scoped: bool) -> tuple[DataFrame, Column | None]:
    """The dimension aggregate as one struct: a scalar subquery, or joined per city."""
    if dim is None:
        return facts, None
    if not scoped:
        return facts, dim.select(F.struct(*dim.columns)).scalar()
    name = f"_dim_{dim.columns[-1]}"
    packed = dim.select("city", F.struct(*[c for c in dim.columns if c != "city"]).alias(name))
    return facts.join(packed, "city", "left"), F.col(name)


def _rider_utilization(fleet: Column | None) -> Column:
    default = F.lit(settings.KPI_DEFAULTS["rider_utilization_pct"])
    if fleet is None:
        return default
    monthly = fleet["active"] * F.lit(settings.RIDER_MAX_DAILY_DELIVERIES) * F.lit(30)
    used = clip(ratio(F.col("total_orders_analyzed"), monthly), high=1.0) * 100.0
    return F.when(F.coalesce(fleet["riders"], F.lit(0)) == 0, default).otherwise(used)


def _store_utilization(capacity: Column | None) -> Column:
    default = F.lit(settings.KPI_DEFAULTS["dark_store_utilization_pct"])
    if capacity is None:
        return default
    used = np_round(ratio(capacity["load"], capacity["capacity"] * F.lit(30.0)) * 100.0, 1)
    return F.when(capacity["load"].isNull(), default).otherwise(used)


def band_of(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The band of the first limit the value exceeds."""
    out = None
    for limit, name in bands:
        if limit is None:
            return F.lit(name) if out is None else out.otherwise(name)
        out = (F if out is None else out).when(value > F.lit(limit), name)
    return out


def kpi_bands(kpis: DataFrame, label: str = "city") -> DataFrame:
    """Long table of the banded KPIs with their severity."""
    names = list(settings.KPI_BANDS)
    long = kpis.select(label, *[dbl(n).alias(n) for n in names]).unpivot(label, names, "kpi", "value")
    out = None
    for name in names:
        out = (F if out is None else out).when(F.col("kpi") == name, band_of(F.col("value"), settings.KPI_BANDS[name]))
    return long.withColumn("band", out)


def health_matrix(kpis: DataFrame, label: str = "city") -> DataFrame:
    """Five scores, clamped to 0..100, next to their targets."""
    scores = {
        "On-Time Rate": (F.col("on_time_delivery_rate"), 88.0),
        "SLA Breach Rate": (F.lit(100.0) - F.col("sla_breach_pct"), 90.0),
        "Rider Utilization": (F.col("rider_utilization_pct"), 75.0),
        "Route Efficiency": ((F.lit(2.5) - F.col("route_inefficiency_score")) / F.lit(1.5) * F.lit(100.0), 80.0),
        "Dark Store Capacity": (F.lit(100.0) - F.col("dark_store_utilization_pct"), 30.0),
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), clip(score.cast("double"), 0.0, 100.0).alias("actual"),
                 F.lit(min(100.0, max(0.0, target))).alias("target"))
        for name, (score, target) in scores.items()
    ])
    return kpis.select(label, F.inline(rows))

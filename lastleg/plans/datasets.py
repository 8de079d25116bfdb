"""The tables behind the dashboard charts and the exploration notebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lastleg import settings
from lastleg.functions.numeric import clip, dbl, exact_avg, histogram_bin, np_round, ratio, share
from lastleg.functions.text import zone_label
from lastleg.operators.filters import by_city
from lastleg.operators.geo import geo_grid
from lastleg.operators.kpi import band_of
from lastleg.operators.sampling import hash_sample


def _mean_of(c: str, digits: int = 10) -> Column:
    """Mean of rollup values, added as decimals so row order does not matter."""
    return ratio(F.sum(F.col(c).cast(f"decimal(18,{digits})")), F.count(c))


def _pct(c: Column | str, digits: int = 1) -> Column:
    return np_round(dbl(c) * F.lit(100.0), digits)


def _present(df: DataFrame, *keys: str) -> DataFrame:
    return df.na.drop("any", subset=list(keys))


# --- Trends ------------------------------------------------------------------------------

def daily_volume_late(city_daily: DataFrame, city: str = "All") -> DataFrame:
    """Orders per day and the mean of the cities' late rates (not weighted by orders)."""
    rows = by_city(city_daily, city, fall_back=True)
    return rows.groupBy("date").agg(
        F.sum("total_orders").cast("bigint").alias("total_orders"),
        _pct(_mean_of("late_rate", 4)).alias("late_rate_pct"),
    ).orderBy("date")


def city_avg_minutes(city_daily: DataFrame) -> DataFrame:
    means = city_daily.groupBy("city").agg(_mean_of("avg_delivery_min").alias("m"))
    return means.select(
        "city", np_round("m", 1).alias("avg_delivery_min"),
        band_of(F.col("m"), [(50.0, "danger"), (40.0, "warning"), (None, "success")]).alias("band"),
    ).orderBy("avg_delivery_min", "city")


def hourly_demand(orders: DataFrame) -> DataFrame:
    return _present(orders, "city", "hour_of_day").groupBy("city", "hour_of_day").agg(F.count("*").alias("orders"))


def hourly_pivot(orders: DataFrame) -> DataFrame:
    """One column per hour of the day, zero where a city has no orders."""
    counts = hourly_demand(orders).groupBy("city").pivot("hour_of_day", list(range(24))).agg(F.sum("orders"))
    return counts.na.fill(0).select("city", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def city_hour_bars(orders: DataFrame, city: str) -> DataFrame:
    bars = hourly_demand(by_city(orders, city)).groupBy("hour_of_day").agg(F.sum("orders").alias("orders"))
    return bars.withColumn("highlight", F.col("hour_of_day").isin(*settings.PEAK_HIGHLIGHT_HOURS)).orderBy("hour_of_day")


def city_cost(city_daily: DataFrame) -> DataFrame:
    means = city_daily.groupBy("city").agg(_mean_of("cost_per_order", 2).alias("m"))
    return means.select("city", np_round("m", 1).alias("cost_per_order")).orderBy(F.desc("cost_per_order"), "city")


def order_type_mix(orders: DataFrame) -> DataFrame:
    rows = _present(orders, "order_type")
    everything = rows.agg(F.count("*")).scalar()
    return rows.groupBy("order_type").agg(F.count("*").alias("orders")).withColumn(
        "share_pct", _pct(ratio(F.col("orders"), everything))).orderBy(F.desc("orders"), "order_type")


def weather_monthly(orders: DataFrame) -> DataFrame:
    return _present(orders, "month").groupBy("month").agg(
        np_round(exact_avg("weather_delay_min"), 1).alias("avg_delay"),
        _pct(share(F.col("weather_delay_min") > settings.WEATHER_IMPACT_MIN)).alias("pct_impacted"),
    ).orderBy("month")


# --- Geography ---------------------------------------------------------------------------

def store_locations(stores: DataFrame, city: str = "All") -> DataFrame:
    return by_city(stores, city).select(
        "store_id", "city", dbl("latitude").alias("latitude"), dbl("longitude").alias("longitude"),
        "tier", dbl("zone_coverage_km").alias("zone_coverage_km"))


def top_late_zones(orders: DataFrame, k: int = 8, precision: int = 2) -> DataFrame:
    cells = geo_grid(orders, precision, ordered=False)
    top = cells.orderBy(F.desc("late_rate"), F.desc("order_count"), "lat_bin", "lon_bin").limit(k)
    return top.select(
        "lat_bin", "lon_bin", "late_rate", "order_count",
        zone_label("lat_bin", "lon_bin").alias("zone"),
        _pct("late_rate").alias("late_rate_pct"),
        band_of(F.col("late_rate"), [(0.20, "danger"), (None, "warning")]).alias("band"))


# --- Riders and stores -------------------------------------------------------------------

def rider_late_hist(riders: DataFrame, width: float = 5.0) -> DataFrame:
    """Riders per band of late percentage, with the mean of all riders."""
    mean = riders.agg(_mean_of("late_rate", 4)).scalar()
    bins = riders.groupBy(histogram_bin(dbl("late_rate") * F.lit(100.0), width).alias("bin")).agg(F.count("*").alias("riders"))
    return bins.select("bin", (F.col("bin") * F.lit(width)).alias("from_pct"), "riders",
                       (mean * F.lit(100.0)).alias("mean_late_pct")).orderBy("bin")


def rider_scatter(riders: DataFrame, n: int = 500) -> DataFrame:
    sample = hash_sample(riders, "rider_id", n)
    return sample.select(
        "rider_id", (F.col("utilization_score") * F.lit(100.0)).alias("utilization_pct"),
        (F.col("late_rate") * F.lit(100.0)).alias("late_pct"), "avg_rating")


def _busiest_riders(riders: DataFrame, k: int) -> DataFrame:
    return riders.orderBy(F.desc("total_deliveries"), "rider_id").limit(k)


def top_riders(riders: DataFrame, k: int = 10) -> DataFrame:
    return _busiest_riders(riders, k).select(
        "rider_id", "total_deliveries", "late_rate", "avg_rating", _pct("late_rate").alias("late_pct"))


def rider_table(riders: DataFrame, k: int = 50) -> DataFrame:
    return _busiest_riders(riders, k).select(
        F.col("rider_id").alias("Rider ID"), F.col("total_deliveries").alias("Deliveries"),
        _pct("late_rate").alias("Late Rate (%)"), np_round("avg_delivery_min", 1).alias("Avg Time (min)"),
        _pct("utilization_score").alias("Utilization (%)"), np_round("avg_rating", 1).alias("Rating"))


def top_stores(stores: DataFrame, k: int = 15, city: str = "All") -> DataFrame:
    top = by_city(stores, city).orderBy(F.desc("total_orders"), "dark_store_id").limit(k)
    return top.select("dark_store_id", "total_orders", _pct("sla_breach_rate").alias("breach_pct"))


def tier_prep(stores: DataFrame, city: str = "All") -> DataFrame:
    rows = _present(by_city(stores, city), "tier")
    return rows.groupBy("tier").agg(np_round(_mean_of("avg_prep_time"), 1).alias("avg_prep_time")).orderBy("tier")


def store_table(stores: DataFrame, city: str = "All") -> DataFrame:
    return by_city(stores, city).select(
        F.col("dark_store_id").alias("Store ID"), "city", F.col("total_orders").alias("Orders"),
        _pct("sla_breach_rate").alias("SLA Breach (%)"), F.col("avg_prep_time").alias("Avg Prep (min)"), "tier")


# --- SLA and risk ------------------------------------------------------------------------

def sla_trend(city_daily: DataFrame, city: str = "All") -> DataFrame:
    rows = by_city(city_daily, city).groupBy("date").agg((_mean_of("late_rate", 4) * F.lit(100.0)).alias("p"))
    band = F.when(F.col("p") >= 15, "CRITICAL").when(F.col("p") >= 10, "WARNING").otherwise("OK")
    return rows.select("date", np_round("p", 2).alias("late_rate_pct"), band.alias("band")).orderBy("date")


def sla_by_type(orders: DataFrame) -> DataFrame:
    rows = _present(orders, "order_type").groupBy("order_type").agg(
        F.count("order_id").alias("total"), F.sum("is_late").alias("late"))
    rate = np_round(ratio("late", "total") * F.lit(100.0), 1)
    return rows.withColumn("breach_rate", rate).withColumn(
        "band", band_of(F.col("breach_rate"), [(15.0, "danger"), (10.0, "warning"), (None, "success")]))


def delay_hist(orders: DataFrame, bins: int = 40, top: float = 60.0) -> DataFrame:
    """Density of the delay of late orders, cut to 0..60 minutes."""
    width = top / bins
    late = orders.where((F.col("is_late") == 1) & F.col("delay_minutes").isNotNull())
    everything = late.agg(F.count("*")).scalar()
    index = F.least(histogram_bin(clip(dbl("delay_minutes"), 0.0, top), width), F.lit(bins - 1))
    counts = late.groupBy(index.cast("bigint").alias("bin")).agg(F.count("*").alias("orders"))
    return counts.select(
        "bin", (F.col("bin") * F.lit(width)).alias("from_min"), "orders",
        ratio(F.col("orders"), dbl(everything) * F.lit(width)).alias("density")).orderBy("bin")


def risk_hist(orders: DataFrame, width: float = 0.05) -> DataFrame:
    return _present(orders, "is_late", "late_risk_score").groupBy(
        "is_late", histogram_bin("late_risk_score", width).alias("bin")).agg(F.count("*").alias("orders"))


def risk_by_hour(orders: DataFrame) -> DataFrame:
    return _present(orders, "hour_of_day").groupBy("hour_of_day").agg(
        np_round(_mean_of("late_risk_score", 4), 3).alias("risk"), np_round(exact_avg("is_late"), 3).alias("late"),
    ).orderBy("hour_of_day")


# --- Exploration -------------------------------------------------------------------------

def eda_summary(orders: DataFrame) -> DataFrame:
    late_delay = F.when(F.col("is_late") == 1, F.col("delay_minutes"))
    return orders.agg(
        F.count("*").alias("orders"),
        exact_avg("is_late").alias("late_rate"),
        exact_avg("actual_delivery_min").alias("avg_delivery_min"),
        exact_avg("delay_minutes", late_delay).alias("avg_late_delay_min"),
        exact_avg("total_cost_inr").alias("avg_cost_inr"),
        exact_avg("is_peak_hour").alias("peak_share"),
        share(F.col("weather_delay_min") > settings.WEATHER_IMPACT_MIN).alias("weather_share"),
    )


def eda_hourly(orders: DataFrame) -> DataFrame:
    return _present(orders, "hour_of_day").groupBy("hour_of_day").agg(F.count("*").alias("orders")).orderBy("hour_of_day")


def eda_city(orders: DataFrame) -> DataFrame:
    return _present(orders, "city").groupBy("city").agg(
        F.count("order_id").alias("orders"), exact_avg("is_late").alias("late_rate"),
        exact_avg("actual_delivery_min").alias("avg_time"), exact_avg("total_cost_inr").alias("avg_cost"),
    ).withColumn("late_pct", _pct("late_rate")).orderBy(F.desc("late_pct"), "city")


def late_correlations(orders: DataFrame) -> DataFrame:
    """Pearson correlation of each feature with lateness, strongest first, in one pass."""
    names = [c for c in settings.CORRELATION_FEATURES if c in orders.columns]
    row = orders.agg(*[np_round(F.corr(dbl(c), dbl("is_late")), 4).alias(c) for c in names])
    return row.select(F.lit(1).alias("_one"), *names).unpivot("_one", names, "feature", "correlation").drop("_one").orderBy(
        F.desc("correlation"), "feature")

"""Every query by name: ``QUERIES[name](spark, data_dir)`` returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from lastleg import settings
from lastleg.functions import dates, text
from lastleg.functions.numeric import clip, dbl, dec_round, exact_avg, np_round
from lastleg.ml import prepare, score, store, train
from lastleg.operators import derive, features, filters, geo, joins, kpi, metrics, quality, resample, rollups, rules, sampling, selection
from lastleg.plans import datasets, etl, views
from lastleg.plans.warehouse import Warehouse, warehouse
from lastleg.session import new_stage_path, stage
from lastleg.sources import schemas, tables
from lastleg.sources.star_adapter import CITY_NAMES, code_map

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in common types: decimals as double, integers as bigint."""
    def column(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f"`{f.name}`").cast("bigint").alias(f.name)
        return F.col(f"`{f.name}`")
    return df.select(*[column(f) for f in df.schema.fields])


def query(build: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register a query under the function's name (without a trailing underscore)."""
    @wraps(build)
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return plain(build(warehouse(spark, data_dir)))
    QUERIES[build.__name__.rstrip("_")] = run
    return build


# --- Validation and quality ---------------------------------------------------------------

@query
def dedup_orders(w):
    return quality.keep_first(w.deliveries).select(*[f.name for f in schemas.ORDERS.fields])


@query
def dedup_counts(w):
    return quality.dedup_counts(w.deliveries)


@query
def null_profile(w):
    return quality.null_profile(w.orders)


@query
def dq_domain(w):
    return quality.domain_violations(w.spoiled)


@query
def dq_unique(w):
    return quality.unique_violations(w.raw)


@query
def dq_orphans(w):
    return quality.orphans(w.raw)


@query
def dq_not_null(w):
    return quality.null_violations(w.spoiled)


@query
def apply_defaults(w):
    known = w.orders.select("rider_id").distinct().join(w.riders, "rider_id", "left")
    filled = schemas.apply_defaults(known, schemas.RIDERS)
    return filled.select("rider_id", "experience_months", "is_active")


@query
def store_defaults(w):
    filled = schemas.apply_defaults(w.spoiled["dark_stores"], schemas.DARK_STORES)
    return filled.select("store_id", "max_capacity", "is_active")


# --- Sources and sinks --------------------------------------------------------------------

def _table_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = [
        tables.read_table(spark, folder, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name in tables.DERIVED_TABLES
    ]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


@query
def saved_tables(w):
    """The five derived tables written and read back."""
    folder = new_stage_path(w.spark, "saved")
    tables.save_tables({"orders_enriched": w.enriched, **etl.build_rollups(w.enriched, w.stores)}, folder)
    return _table_counts(w.spark, folder)


@query
def etl_run(w):
    """Raw tables stored in tie-break order, then the whole chain over the files."""
    folder = new_stage_path(w.spark, "raw")
    raw = {**w.raw, "orders": w.deliveries_in_order}
    tables.save_tables(raw, folder, tables.RAW_TABLES)
    built = etl.run(w.spark, folder, new_stage_path(w.spark, "derived"))
    return built["city_daily_kpis"]


@query
def etl_update(w):
    """All orders but the newest day's, then an update that brings that day."""
    folder, out = new_stage_path(w.spark, "raw"), new_stage_path(w.spark, "derived")
    newest = w.deliveries.agg(F.max(F.to_date("created_at"))).first()[0]
    ordered = w.deliveries_in_order
    earlier = ordered.where(~F.to_date("created_at").eqNullSafe(F.lit(newest)))
    tables.save_tables({**w.raw, "orders": earlier}, folder, tables.RAW_TABLES)
    etl.update(w.spark, folder, out)
    tables.write_table(ordered, folder, "orders")
    return etl.update(w.spark, folder, out)["city_daily_kpis"]


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _rows_by_name(found: dict[str, DataFrame], use: str) -> DataFrame:
    return _union_all([
        df.agg(F.count("*").alias("rows"), F.count_if(F.lit("late_risk_score" in df.columns)).alias("enriched_rows"))
        .select(F.lit(use).alias("use"), F.lit(name).alias("table_name"), "rows", "enriched_rows") for name, df in found.items()])


@query
def load_with_fallback(w):
    """What the dashboard, the trainer and the notebook read, with enriched orders stored and without."""
    full, plain_only = new_stage_path(w.spark, "full"), new_stage_path(w.spark, "plain")
    sources = {"orders": w.orders, "riders": w.riders, "dark_stores": w.stores}
    tables.save_tables({**sources, "orders_enriched": w.enriched}, full, ("orders_enriched", *sources))
    tables.save_tables(sources, plain_only, tuple(sources))
    return _union_all([
        _rows_by_name(tables.load_dashboard(w.spark, full), "dashboard"),
        _rows_by_name(tables.load_dashboard(w.spark, plain_only), "dashboard, no features"),
        _rows_by_name({"training": tables.load_training(w.spark, full)}, "trainer"),
        _rows_by_name({"training": tables.load_training(w.spark, plain_only)}, "trainer, no features"),
        _rows_by_name(tables.load_tables(w.spark, full, tables.NOTEBOOK_TABLES), "notebook"),
    ])


@query
def star_schema(w):
    """The star schema created in a database of its own, filled from the raw tables and counted.

    Columns the raw tables lack take their declared defaults. The database goes again; its files go with
    the stages.
    """
    spark, before = w.spark, w.spark.catalog.currentDatabase()
    name, folder = f"star_{uuid.uuid4().hex}", new_stage_path(w.spark, "star")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    spark.catalog.setCurrentDatabase(name)
    try:
        counted = []
        sources = {**w.raw, "orders": w.orders}
        for table in schemas.create_star_schema(spark, folder):
            columns = [f.name for f in schemas.TABLES[table].fields if f.name in sources[table].columns]
            listed = ", ".join(f"`{c}`" for c in columns)
            spark.sql(f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {{source}}", source=sources[table])
            filled = [F.count(f.name) == F.count("*") for f in schemas.TABLES[table].fields if f.default is not None]
            row = spark.table(table).agg(F.count("*").alias("rows"), *[c.alias(f"f{i}") for i, c in enumerate(filled)]).first()
            counted.append((table, row["rows"], len(spark.table(table).columns), all(row[f"f{i}"] for i in range(len(filled)))))
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame(counted, "table_name string, rows bigint, columns bigint, defaults_filled boolean")


# --- Filters ------------------------------------------------------------------------------

_ORDER_BRIEF = ("order_id", "city", "order_type", "created_at")


@query
def filter_city(w):
    return filters.OrderFilter(city="Mumbai").apply(w.orders).select(*_ORDER_BRIEF)


@query
def filter_order_type(w):
    return filters.OrderFilter(order_types=("express", "scheduled")).apply(w.orders).select(*_ORDER_BRIEF)


@query
def filter_last_30d(w):
    return filters.OrderFilter(date_preset="Last 30 Days").apply(w.orders).select(*_ORDER_BRIEF)


@query
def filter_combined(w):
    chosen = filters.OrderFilter("Delhi", ("express", "standard"), "Last 90 Days").apply(w.orders)
    return chosen.agg(F.count("*").alias("orders"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query
def filter_fallback(w):
    return filters.by_city(w.city_daily, "Nowhere", fall_back=True).select("city", "date", "total_orders")


@query
def filter_flags(w):
    late, delay = F.col("is_late") == 1, F.col("delay_minutes")
    return w.orders.agg(
        F.count("*").alias("orders"),
        F.count_if(late).alias("late"), F.count_if(~late).alias("on_time"),
        F.count_if(delay > settings.BREACH_DELAY_MIN).alias("breached"),
        F.count_if(F.col("weather_delay_min") > settings.WEATHER_IMPACT_MIN).alias("weather_impacted"),
        F.count_if(F.col("is_peak_hour") == 1).alias("peak"), F.count_if(F.col("is_peak_hour") == 0).alias("off_peak"),
        F.count_if(F.col("delivery_lat").isNotNull() & F.col("delivery_lon").isNotNull()).alias("located"),
    )


# --- Features and derivations -------------------------------------------------------------

def _smooth_cycles(df: DataFrame) -> DataFrame:
    """Sine and cosine to 12 places: math libraries differ in the last bit."""
    return df.withColumns({c: np_round(c, 12) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")})


@query
def features_(w):
    return _smooth_cycles(w.enriched.select("order_id", *features.ENGINEERED))


@query
def time_features(w):
    return _smooth_cycles(w.orders.select("order_id", *[c.alias(n) for n, c in features.time_features().items()]))


@query
def operational_flags(w):
    return w.orders.select("order_id", *[c.alias(n) for n, c in features.operational_flags().items()])


@query
def ratio_features(w):
    return w.orders.select("order_id", *[c.alias(n) for n, c in features.ratio_features().items()])


@query
def late_risk(w):
    return w.orders.select("order_id", features.late_risk_score().alias("late_risk_score"))


@query
def row_derivations(w):
    return derive.row_derivations(w.orders, F.col("forced_late"), F.col("delivery_failed"))


@query
def expected_duration(w):
    return w.orders.select("order_id", derive.expected_duration().alias("expected_min"))


@query
def labels_ml(w):
    return w.orders.select("order_id", *[c.alias(n) for n, c in derive.labels().items()])


@query
def hour_weight(w):
    hours = w.orders.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("orders"))
    return hours.withColumn("weight", dates.hour_weight("hour"))


@query
def weather_code_map(w):
    return w.weather.groupBy("condition").agg(
        F.count("*").alias("readings"), F.min("delay_impact_min").alias("min_impact"), F.max("delay_impact_min").alias("max_impact"),
    ).withColumns({
        "base_delay_min": code_map("condition", settings.WEATHER_DELAY_MIN),
        "visibility_km": code_map("condition", settings.WEATHER_VISIBILITY_KM),
    })


# --- Joins --------------------------------------------------------------------------------

@query
def join_rider(w):
    return features.join_riders(w.orders.select("order_id", "rider_id"), w.riders)


@query
def store_daily_load(w):
    joined = features.join_store_load(w.orders.select("order_id", "dark_store_id", "created_at"))
    return joined.select("order_id", "dark_store_id", "store_daily_load")


@query
def city_hour_congestion(w):
    joined = features.join_city_congestion(w.orders.select("order_id", "city", "hour_of_day", "congestion_factor"))
    return joined.select("order_id", "city_hour_avg_congestion")


@query
def weather_nearest(w):
    found = joins.nearest_reading(
        w.orders.select("order_id", "created_at"), w.weather, "created_at", "timestamp", "delay_impact_min")
    return found.select("order_id", "delay_impact_min")


@query
def weather_by_city(w):
    """Readings of the even hours belong to the first city, the others to the second; other cities have none."""
    even = F.hour("timestamp") % 2 == 0
    placed = w.weather.withColumn("city", F.when(even, CITY_NAMES[0]).otherwise(CITY_NAMES[1]))
    found = joins.nearest_reading(
        w.orders.select("order_id", "city", "created_at"), placed, "created_at", "timestamp", "delay_impact_min", by="city")
    return found.select("order_id", "city", "delay_impact_min")


@query
def store_lookup(w):
    fallback = (settings.FALLBACK_LAT, settings.FALLBACK_LON)
    found = joins.store_lookup(w.orders.select("order_id", "dark_store_id"), w.stores, fallback)
    return found.select("order_id", "store_city", "store_lat", "store_lon")


@query
def store_roster(w):
    return sampling.roster(w.stores, "city", "store_id")


@query
def rider_roster(w):
    return sampling.roster(w.riders, "assigned_store", "rider_id")


# --- Rollups and views --------------------------------------------------------------------

@query
def city_daily_kpis(w):
    return w.city_daily


@query
def rider_performance(w):
    return w.rider_performance


@query
def store_performance(w):
    return w.store_performance


@query
def hourly_stress(w):
    return w.hourly_stress


@query
def vw_city_daily_kpis(w):
    return w.view("vw_city_daily_kpis")


@query
def vw_rider_performance(w):
    return w.view("vw_rider_performance")


@query
def vw_store_load_analysis(w):
    return w.view("vw_store_load_analysis")


@query
def vw_hourly_stress(w):
    return w.view("vw_hourly_stress")


@query
def vw_sla_monitoring(w):
    return w.view("vw_sla_monitoring")


@query
def q1_congested_zones(w):
    return views.congested_zones(w.orders, precision=1, min_orders=10)


@query
def q2_late_riders(w):
    return views.late_riders(w.view("vw_rider_performance"), min_deliveries=30)


@query
def q3_city_hours(w):
    return views.city_hours(w.view("vw_hourly_stress"))


# --- KPIs and recommendations -------------------------------------------------------------

def _kpis(w: Warehouse, **how) -> DataFrame:
    return kpi.compute_kpis(w.orders, w.riders, w.store_totals, **how)


@query
def kpis_all(w):
    return _kpis(w)


@query
def kpis_by_city(w):
    return _kpis(w, by=("city",))


@query
def kpis_by_city_scoped(w):
    return _kpis(w, by=("city",), scope_dims=True)


@query
def kpis_city_mumbai(w):
    return _kpis(w, city="Mumbai")


@query
def kpi_bands(w):
    return kpi.kpi_bands(_kpis(w, by=("city",)))


@query
def health_matrix(w):
    return kpi.health_matrix(_kpis(w, by=("city",)))


@query
def recommendations(w):
    found = rules.recommendations(_kpis(w, by=("city",)))
    return found.select("city", "position", "rule", "priority", "category", "impact")


@query
def recommendation_text(w):
    found = rules.recommendations(_kpis(w, by=("city",)))
    return found.select("city", "rule", "icon", "title", "description", "estimated_improvement")


@query
def recommendations_by_segment(w):
    segments = _kpis(w, by=("order_type", "is_peak_hour"))
    named = segments.withColumn("segment", F.concat_ws("/", "order_type", F.col("is_peak_hour").cast("string")))
    found = rules.recommendations(named, label="segment")
    return found.select("segment", "position", "rule", "priority", "title", "description")


@query
def recommendations_limits(w):
    """Limits at which the rules for busy riders, stores and routes fire; without a limit reached, all is well."""
    low = {"rider_util_low": 0.0, "rider_util_high": 0.5, "store_util_high": 1.0, "route_inefficiency_high": 1.0,
           "sla_breach": 100.0, "congestion_high": 99.0, "peak_stress_high": 99.0, "weather_disruption_high": 100.0}
    none = {**low, "rider_util_high": 1e9, "store_util_high": 1e9, "route_inefficiency_high": 99.0}
    kpis = _kpis(w, by=("city",))
    found = rules.recommendations(kpis, thresholds=low).withColumn("limits", F.lit("low")).unionByName(
        rules.recommendations(kpis, thresholds=none).withColumn("limits", F.lit("none")))
    return found.select("limits", "city", "position", "rule", "priority", "title", "description")


@query
def alert_lines(w):
    lines = rules.alert_lines(rules.recommendations(_kpis(w, by=("city",))))
    return lines.select("city", "rule", "headline", "severity")


# --- Geography ----------------------------------------------------------------------------

@query
def geo_grid(w):
    return geo.geo_grid(w.orders, 3)


@query
def geo_grid_2(w):
    return geo.geo_grid(w.orders, 2)


@query
def zone_assign_summary(w):
    return geo.assign_zones(w.orders, [(lat, lon) for lat, lon, *_ in settings.CITIES.values()])


@query
def delivery_clusters(w):
    return geo.delivery_zones(w.orders)


# --- Dashboard ----------------------------------------------------------------------------

@query
def daily_volume_late(w):
    return datasets.daily_volume_late(w.city_daily)


@query
def city_avg_minutes(w):
    return datasets.city_avg_minutes(w.city_daily)


@query
def hourly_demand(w):
    return datasets.hourly_demand(w.orders)


@query
def hourly_pivot(w):
    return datasets.hourly_pivot(w.orders)


@query
def city_hour_bars(w):
    return datasets.city_hour_bars(w.orders, "Mumbai")


@query
def city_cost(w):
    return datasets.city_cost(w.city_daily)


@query
def order_type_mix(w):
    return datasets.order_type_mix(w.orders)


@query
def weather_monthly(w):
    return datasets.weather_monthly(w.orders)


@query
def store_locations(w):
    return datasets.store_locations(w.stores)


@query
def top_late_zones(w):
    return datasets.top_late_zones(w.orders)


@query
def rider_late_hist(w):
    return datasets.rider_late_hist(w.rider_performance)


@query
def rider_scatter(w):
    return datasets.rider_scatter(w.rider_performance)


@query
def top_riders(w):
    return datasets.top_riders(w.rider_performance)


@query
def rider_table(w):
    return datasets.rider_table(w.rider_performance)


@query
def top_stores(w):
    return datasets.top_stores(w.store_performance)


@query
def tier_prep(w):
    return datasets.tier_prep(w.store_performance)


@query
def store_table(w):
    return datasets.store_table(w.store_performance)


@query
def sla_trend(w):
    return datasets.sla_trend(w.city_daily)


@query
def sla_by_type(w):
    return datasets.sla_by_type(w.orders)


@query
def delay_hist(w):
    return datasets.delay_hist(w.orders)


@query
def risk_hist(w):
    return datasets.risk_hist(w.risk_scored)


@query
def risk_by_hour(w):
    return datasets.risk_by_hour(w.risk_scored)


@query
def eda_summary(w):
    return datasets.eda_summary(w.orders)


@query
def eda_hourly(w):
    return datasets.eda_hourly(w.orders)


@query
def eda_city(w):
    return datasets.eda_city(w.orders)


@query
def late_correlations(w):
    return datasets.late_correlations(w.enriched)


# --- Sampling and texts -------------------------------------------------------------------

@query
def hash_sample(w):
    return sampling.hash_sample(w.orders, "order_id", 5000).select(*_ORDER_BRIEF)


@query
def weighted_bootstrap(w):
    return sampling.weighted_bootstrap(w.orders)


@query
def weighted_resample(w):
    """As many draws as orders, by cost in hundredths."""
    weighed = w.orders.select("order_id", F.round(F.col("total_cost_inr") * 100).alias("hundredths"))
    return resample.weighted_resample(weighed, "order_id", "hundredths", w.orders.count())


@query
def delivery_quantiles(w):
    """Exact quartiles and P95 of delivery times per city and order type, and the median of costs over all orders."""
    parts = [
        selection.exact_quantile(w.orders, "actual_delivery_min", share, ("city", "order_type")).select("city", "order_type", F.lit(name).alias("measure"), "value")
        for name, share in (("minutes_q1", 0.25), ("minutes_median", 0.5), ("minutes_q3", 0.75), ("minutes_p95", 0.95))
    ]
    none = F.lit(None).cast("string")
    cost = selection.exact_quantile(w.orders, "total_cost_inr", 0.5)
    parts.append(cost.select(none.alias("city"), none.alias("order_type"), F.lit("cost_median").alias("measure"), "value"))
    return _union_all(parts).withColumn("value", dec_round("value", 4))


@query
def distinct_cities(w):
    return prepare.distinct_cities(w.orders)


@query
def hour_spine(w):
    return sampling.hour_spine(w.orders, "created_at")


@query
def string_formats(w):
    v = w.view("vw_rider_performance")
    return v.select(
        "rider_id",
        text.display_number(F.col("total_deliveries"), integer=True).alias("deliveries_text"),
        text.display_number(F.col("late_rate_pct"), 1, "%").alias("late_text"),
        text.display_number(F.col("avg_delivery_min"), 0, "m").alias("minutes_text"),
        text.display_number(F.col("total_earnings_inr"), 2).alias("earnings_text"),
    )


@query
def status_labels(w):
    by_status = w.orders.groupBy("status").agg(F.count("*").alias("n"), exact_avg("is_late").alias("late_rate"))
    return by_status.select(
        text.title_case(F.col("status")).alias("title"), text.thousands("n").alias("orders_text"),
        text.percent(F.col("late_rate"), 1).alias("late_text"))


# --- Models -------------------------------------------------------------------------------

@query
def city_encode(w):
    return prepare.encode_city(w.orders.select("order_id", "city"))


@query
def ml_features(w):
    rows, names = prepare.feature_rows(w.model_inputs)
    return _smooth_cycles(prepare.encode_city(rows.select("order_id", "city", *names)))


@query
def stratified_split(w):
    return sampling.stratified_split(w.orders.select("order_id", "is_late"), "order_id", "is_late")


@query
def clf_metrics(w):
    return metrics.classification_metrics(w.risk_scored, "is_late", "late_risk_score", 0.75)


@query
def reg_metrics(w):
    late = w.orders.where("is_late = 1").withColumn("delay_target", derive.labels()["delay_target"])
    return metrics.regression_metrics(late, "delay_target", "weather_delay_min")


@query
def score_orders_no_model(w):
    return score.score_orders(w.order_ids, None).select("order_id", "late_prob")


@query
def no_model_bands(w):
    return score.no_model_bands(w.order_ids).select("order_id", "late_prob", "predicted_late", "confidence")


@query
def risk_bands(w):
    fixed = w.risk_scored.withColumn("late_prob", clip(np_round(dbl("late_risk_score") - F.lit(0.2), 4), 0.0, 1.0))
    return score.risk_bands(fixed).select("order_id", "late_prob", "predicted_late", "risk_level")


_TRAINERS = {
    train.LATE: train.train_late, train.BREACH: train.train_breach, train.DELAY: train.train_delay, train.CONGESTION: train.train_congestion,
}


def _models(w: Warehouse, *names: str) -> list[train.Trained]:
    """Models of full size, each trained once a warehouse and only if asked for; several of them side by side."""
    missing = [n for n in names if n not in w.models]
    table = w.model_table
    w.models.update(zip(missing, train.side_by_side(table, [_TRAINERS[n] for n in missing]), strict=True))
    return [w.models[n] for n in names]


def _results(w: Warehouse, *names: str) -> DataFrame:
    """The stored results of models."""
    folder = new_stage_path(w.spark, "models")
    train.save_results(train.results(w.spark, _models(w, *names)), folder)
    return train.load_results(w.spark, folder)


@query
def ml_late(w):
    return _results(w, train.LATE)


@query
def ml_breach(w):
    return _results(w, train.BREACH)


@query
def ml_delay(w):
    return _results(w, train.DELAY)


@query
def ml_congestion(w):
    return _results(w, train.CONGESTION)


@query
def model_results(w):
    return _results(w, *_TRAINERS)


@query
def model_status(w):
    return train.model_status(_results(w, *_TRAINERS))


@query
def model_top_features(w):
    return train.top_features(_results(w, train.LATE))


@query
def score_orders(w):
    """Every enriched order with its probability to be late and its risk level, by the saved and reloaded late model."""
    folder = new_stage_path(w.spark, "models")
    train.save_models(_models(w, train.LATE), folder)
    scored = score.risk_bands(score.score_orders(w.enriched, score.load_model(folder)))
    return stage(scored.select("order_id", "late_prob", "predicted_late", "risk_level"), "scores")


@query
def score_all_models(w):
    """Every enriched order with the scores of all four models, saved and reloaded."""
    folder = new_stage_path(w.spark, "models")
    train.save_models(_models(w, *_TRAINERS), folder)
    rows = w.enriched
    for name in _TRAINERS:
        rows = store.score_orders(rows, score.load_model(folder, name), f"{name}_score")
    scores = rows.select("order_id", *[np_round(f"{name}_score", 4).alias(f"{name}_score") for name in _TRAINERS])
    return stage(scores, "scores")  # every reader would walk all trees once more

"""Fixed values of the delivery domain.

Everything in this file is data: names, coordinates, limits and parameters that results
depend on. Functions elsewhere take them as defaults, so callers can pass their own.
"""

# --- Fixed values: cities (latitude, longitude, zones, demand weight) -------------------
CITIES = {
    "Mumbai": (19.0760, 72.8777, 12, 0.22),
    "Delhi": (28.7041, 77.1025, 14, 0.20),
    "Bengaluru": (12.9716, 77.5946, 10, 0.18),
    "Hyderabad": (17.3850, 78.4867, 8, 0.12),
    "Chennai": (13.0827, 80.2707, 7, 0.10),
    "Pune": (18.5204, 73.8567, 6, 0.08),
    "Ahmedabad": (23.0225, 72.5714, 5, 0.06),
    "Kolkata": (22.5726, 88.3639, 6, 0.04),
}

# --- Fixed values: promised minutes per order type --------------------------------------
SLA_MINUTES = {"express": 30, "standard": 60, "scheduled": 120}

# --- Fixed values: weather codes --------------------------------------------------------
WEATHER_DELAY_MIN = {"clear": 0, "rain": 12, "heavy_rain": 28, "fog": 8, "storm": 45}
WEATHER_VISIBILITY_KM = {"clear": 10.0, "rain": 5.0, "heavy_rain": 2.0, "fog": 0.5, "storm": 1.0}

# --- Fixed values: demand weight by hour of day -----------------------------------------
# (from hour, up to but not including hour, weight); a later row wins over an earlier one.
HOUR_WEIGHTS = [
    (8, 10, 1.5),
    (11, 14, 2.8),
    (14, 17, 1.2),
    (18, 21, 3.2),
    (21, 23, 1.8),
    (23, 24, 0.3),
    (0, 6, 0.3),
]
HOUR_WEIGHT_DEFAULT = 1.0

# --- Fixed values: peak hours, inclusive ------------------------------------------------
PEAK_HOURS = [(11, 14), (18, 21)]
PEAK_HIGHLIGHT_HOURS = [12, 13, 19, 20]

# --- Fixed values: store position used when a store is unknown --------------------------
FALLBACK_LAT, FALLBACK_LON = 19.0, 72.8

# --- Fixed values: order cost and travel ------------------------------------------------
COST_BASE, COST_PER_KM, COST_PEAK_FACTOR = 25.0, 3.5, 1.25
TRAVEL_SPEED_KMH = 25.0
DURATION_MIN, DURATION_MAX = 5.0, 180.0

# --- Fixed values: features -------------------------------------------------------------
HIGH_DISTANCE_KM = 5
HIGH_CONGESTION = 1.5
BREACH_DELAY_MIN = 10
WEATHER_IMPACT_MIN = 5
DELAY_TARGET_MAX = 120
RIDER_DEFAULTS = {"experience_months": 24, "base_efficiency_score": 0.75, "rating": 4.0}

# --- Fixed values: KPI defaults when an input column or table is missing ----------------
RIDER_MAX_DAILY_DELIVERIES = 40
KPI_DEFAULTS = {
    "route_inefficiency_score": 1.15,
    "rider_utilization_pct": 74.2,
    "fulfillment_latency_min": 8.5,
    "cost_per_shipment_inr": 42.5,
    "congestion_impact_factor": 1.28,
    "weather_disruption_score": 12.4,
    "dark_store_utilization_pct": 68.3,
}

# --- Fixed values: recommendation thresholds and the KPI values assumed when absent -----
RULE_THRESHOLDS = {
    "sla_breach": 15.0,
    "rider_util_low": 55.0,
    "rider_util_high": 90.0,
    "store_util_high": 85.0,
    "route_inefficiency_high": 1.3,
    "congestion_high": 1.45,
    "peak_stress_high": 2.0,
    "weather_disruption_high": 20.0,
}
RULE_KPI_DEFAULTS = {
    "rider_utilization_pct": 75.0,
    "congestion_impact_factor": 1.2,
    "dark_store_utilization_pct": 65.0,
    "weather_disruption_score": 10.0,
    "route_inefficiency_score": 1.15,
    "peak_hour_stress_score": 1.5,
    "sla_breach_pct": 8.0,
}

# --- Fixed values: severity bands of the KPI cards --------------------------------------
# kpi: (direction, outer limit with its band, inner limit with its band, remaining band)
KPI_BANDS = {
    "on_time_delivery_rate": [(88.0, "success"), (82.0, "warning"), (None, "danger")],
    "sla_breach_pct": [(15.0, "danger"), (10.0, "warning"), (None, "success")],
    "route_inefficiency_score": [(1.3, "danger"), (1.15, "warning"), (None, "success")],
    "peak_hour_stress_score": [(2.5, "danger"), (1.8, "warning"), (None, "success")],
    "congestion_impact_factor": [(1.45, "danger"), (1.25, "warning"), (None, "success")],
    "weather_disruption_score": [(20.0, "warning"), (None, "success")],
    "dark_store_utilization_pct": [(85.0, "danger"), (70.0, "warning"), (None, "success")],
}

# --- Fixed values: model features, parameters and fallbacks -----------------------------
MODEL_FEATURES = [
    "delivery_distance_km", "prep_time_min", "congestion_factor",
    "route_efficiency_score", "is_peak_hour", "weather_delay_min",
    "hour_of_day", "day_of_week", "month", "is_weekend",
    "is_express", "is_high_distance", "sla_minutes",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "experience_months", "base_efficiency_score",
    "store_daily_load", "city_hour_avg_congestion",
    "late_risk_score", "efficiency_gap",
]
TEST_SHARE = 0.2
MODEL_SEED = 42
BOOSTED_TREES = {
    "trees": 400, "depth": 6, "rate": 0.05, "row_share": 0.8, "column_share": 0.8, "min_child_weight": 3,
}
FOREST_BREACH = {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 5}
FOREST_DELAY = {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 5}
DELAY_MIN_LATE_ROWS = 1000
NO_MODEL_PROBABILITY = 0.14
RISK_HIGH, RISK_MEDIUM, LATE_CUTOFF = 0.7, 0.4, 0.5
SCORING_DEFAULT_CITY = "Mumbai"
ZONE_CLUSTERS, ZONE_SEED, ZONE_RESTARTS = 8, 42, 10

# --- Fixed values: exploration columns --------------------------------------------------
CORRELATION_FEATURES = [
    "delivery_distance_km", "congestion_factor", "weather_delay_min",
    "route_efficiency_score", "prep_time_min", "is_peak_hour", "experience_months",
]

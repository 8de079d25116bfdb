"""Texts of the recommendations.

Fixed values: these strings are results, so their wording is given. ``{value}`` marks the
place of the rule's KPI value and ``{label}`` that of the city or segment.
"""

FIELDS = ("priority", "category", "icon", "title", "description", "impact", "estimated_improvement")

SLA_BREACH = (
    "CRITICAL", "SLA Management", "🔴",
    "SLA Breach Rate Critical ({value}%)",
    "SLA breach rate has exceeded 15% in {label}. Immediate intervention required: activate surge fleet, "
    "notify ops managers, and temporarily suspend new order acceptance from overloaded dark stores.",
    "High", "Reduce breach rate by 4–7%",
)
RIDER_LOW = (
    "HIGH", "Rider Allocation", "🏍",
    "Low Rider Utilization — Rebalance Fleet",
    "Rider utilization is {value}% — below the 70% efficiency target. Recommend releasing "
    "15–20% of idle riders to adjacent high-demand zones. Consider dynamic zone reassignment based on "
    "real-time order density.",
    "Medium", "Increase utilization by 12–18%",
)
RIDER_HIGH = (
    "HIGH", "Rider Allocation", "🏍",
    "Rider Overutilization — Risk of Burnout & Delays",
    "Rider utilization at {value}% is above safe threshold (90%). Activate surge roster or "
    "partner fleet for the next 48 hours. Review shift schedules for top 20% overloaded riders immediately.",
    "High", "Reduce late deliveries by 8–12%",
)
STORE_LOAD = (
    "HIGH", "Dark Store Operations", "🏭",
    "Dark Store Near Capacity — Load Balancing Required",
    "Average dark store utilization at {value}%. Redirect 20–25% of inbound orders from "
    "top-3 overloaded stores to nearest underutilized stores within 3 km. Consider activating inventory "
    "pre-staging for predicted peak windows.",
    "High", "Reduce avg prep time by 3–5 min",
)
ROUTES = (
    "MEDIUM", "Route Optimization", "🗺",
    "Route Inefficiency Detected — Optimize Dispatch Clusters",
    "Average route efficiency score is {value} (optimal = 1.0). Recommend switching from "
    "static delivery zones to dynamic clustering using real-time GPS density. Estimated 15% reduction in "
    "travel distance by restructuring delivery polygons in high-ineff zones.",
    "Medium", "Reduce avg travel time by 4–6 min",
)
CONGESTION = (
    "MEDIUM", "Congestion Management", "🚦",
    "High Congestion Impact — Enable Time-Shift Dispatching",
    "Congestion factor averaging {value}x normal speed. Activate congestion-aware routing "
    "API. For orders with SLA > 45 min, dispatch 10 min earlier than standard. Flag congestion corridors for "
    "rider notifications before dispatch.",
    "Medium", "Reduce congestion-related delays by 25%",
)
PEAK = (
    "MEDIUM", "Peak Hour Management", "⚡",
    "Peak Hour Demand Spike — Pre-Position Fleet",
    "Peak-to-off-peak order ratio is {value}x. Pre-position 30% of afternoon shift riders in "
    "top-demand hexagons 30 min before lunch (11:30 AM) and dinner (6:30 PM) windows. Use predictive heat-maps "
    "for zone pre-staging.",
    "Medium", "Reduce peak-hour late rate by 15%",
)
WEATHER = (
    "MEDIUM", "Weather Response", "🌧",
    "Weather Disruption Elevated — Activate Contingency Protocol",
    "Weather disruption score at {value}%. Trigger automated SLA extension notifications "
    "(15 min buffer) for all active orders. Alert riders in affected zones. Enable customer ETA re-push with "
    "weather advisory.",
    "Low", "Reduce weather-related complaints by 40%",
)
ALL_GOOD = (
    "INFO", "System Health", "✅",
    "Operations Running Within Normal Parameters",
    "All key operational metrics are within acceptable thresholds. Continue monitoring SLA breach rates and "
    "congestion indices. Next scheduled review: peak-hour performance analysis.",
    "N/A", "Maintain current performance",
)

TEXTS = {
    "R1": SLA_BREACH, "R2": RIDER_LOW, "R3": RIDER_HIGH, "R4": STORE_LOAD, "R5": ROUTES,
    "R6": CONGESTION, "R7": PEAK, "R8": WEATHER, "R9": ALL_GOOD,
}
# The KPI of each rule and the decimals its value is shown with.
VALUES = {
    "R1": ("sla_breach_pct", 1), "R2": ("rider_utilization_pct", 0), "R3": ("rider_utilization_pct", 0),
    "R4": ("dark_store_utilization_pct", 0), "R5": ("route_inefficiency_score", 2),
    "R6": ("congestion_impact_factor", 2), "R7": ("peak_hour_stress_score", 1),
    "R8": ("weather_disruption_score", 1),
}

"""Recommendations: threshold rules over KPI rows, evaluated as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lastleg import settings
from lastleg.functions.text import fixed
from lastleg.operators import messages


def _texts(spark: SparkSession) -> DataFrame:
    """The message of each rule: nine fixed rows."""
    rows = [
        (rule, messages.VALUES.get(rule, (None, 0))[1], *content) for rule, content in messages.TEXTS.items()
    ]
    return spark.createDataFrame(rows, ", ".join(["rule string", "_digits int", *[f"{n} string" for n in messages.FIELDS]]))


def _fired(kpis: DataFrame, limit: dict[str, Column]) -> Column:
    """Array of (rule, value) for the rules that fire, in rule order; R9 when none does."""
    kpi = {
        name: (F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in kpis.columns else F.lit(default))
        for name, default in settings.RULE_KPI_DEFAULTS.items()
    }
    riders = kpi["rider_utilization_pct"]
    conditions = {
        "R1": kpi["sla_breach_pct"] > limit["sla_breach"],
        "R2": riders < limit["rider_util_low"],
        "R3": (riders >= limit["rider_util_low"]) & (riders > limit["rider_util_high"]),
        "R4": kpi["dark_store_utilization_pct"] > limit["store_util_high"],
        "R5": kpi["route_inefficiency_score"] > limit["route_inefficiency_high"],
        "R6": kpi["congestion_impact_factor"] > limit["congestion_high"],
        "R7": kpi["peak_hour_stress_score"] > limit["peak_stress_high"],
        "R8": kpi["weather_disruption_score"] > limit["weather_disruption_high"],
    }

    def entry(rule: str, value: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), value.alias("_value"))

    rules = F.array(*[F.when(c, entry(rule, kpi[messages.VALUES[rule][0]])) for rule, c in conditions.items()])
    # The all-good entry comes last and survives only if it is the first one left.
    calm = F.array(entry("R9", F.lit(0.0)))
    fired = F.filter(rules, lambda r: r.isNotNull())
    return F.slice(F.concat(fired, calm), F.lit(1), F.greatest(F.size(fired), F.lit(1)))


def recommendations(kpis: DataFrame, label: str = "city", thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per rule that fires for a KPI row, in rule order; R9 when none does."""
    limit = {name: F.lit(v) for name, v in {**settings.RULE_THRESHOLDS, **(thresholds or {})}.items()}
    found = kpis.select(label, F.posexplode(_fired(kpis, limit)).alias("position", "_rule")).select(label, "position", "_rule.*")
    # Nine messages: the broadcast side has a fixed size.
    told = found.join(F.broadcast(_texts(kpis.sparkSession)), "rule")
    value = F.when(F.col("_digits") == 0, fixed("_value", 0)).when(F.col("_digits") == 1, fixed("_value", 1)).otherwise(fixed("_value", 2))
    told = told.withColumn("_text", value)

    def fill(name: str) -> Column:
        return F.replace(F.replace(F.col(name), F.lit("{value}"), F.col("_text")), F.lit("{label}"), F.col(label)).alias(name)

    return told.select(label, "position", "rule", *[fill(n) for n in messages.FIELDS])


def alert_lines(recs: DataFrame) -> DataFrame:
    """Recommendations as the dashboard's alert cards show them."""
    return recs.select(
        "*",
        F.concat("icon", F.lit(" "), "title").alias("headline"),
        F.when(F.col("priority").isin("CRITICAL", "HIGH", "MEDIUM"), F.lower("priority")).otherwise("info").alias("severity"),
    )

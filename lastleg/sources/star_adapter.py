"""Delivery tables derived from TPC-H-like tables.

The analytics need orders, riders, dark stores and weather. This adapter derives them, row
by row and deterministically, from ``lineitem``, ``orders``, ``supplier``, ``customer`` and
``events``. All values come from integer arithmetic and one final division by a power of
ten, so another engine computes the same values.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lastleg import settings
from lastleg.functions import dates
from lastleg.functions.text import padded_id
from lastleg.operators.joins import lookup_join
from lastleg.session import INPUT_PER_PARTITION
from lastleg.sources.schemas import DARK_STORES, ORDERS, RIDERS, WEATHER, Table

CITY_NAMES = list(settings.CITIES)


# The given tables that the delivery tables are made of.
SOURCES = ("lineitem", "orders", "supplier", "customer", "events")


def _read(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


# An input below this size is dealt to all cores; moving it costs next to nothing. A larger one is dealt by its joins.
SMALL_BYTES = 24 * 2**20


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for an input in a few small files; a large one stays in its splits."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // INPUT_PER_PARTITION)), *keys)


def _cut(key: str, *cases: tuple[int, object], other: object) -> Column:
    """First case whose upper limit is above the key."""
    out = None
    for limit, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = (F if out is None else out).when(F.expr(key) < limit, value)
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def _by_city(nation_key: str, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({nation_key} % 8 + 1 as int)"))


def _micro(values: list[float]) -> list[int]:
    return [round(v * 1_000_000) for v in values]


LATITUDES = _micro([c[0] for c in settings.CITIES.values()])
LONGITUDES = _micro([c[1] for c in settings.CITIES.values()])


def _scaled(c: Column, digits: int) -> Column:
    """An integer as a decimal with ``digits`` places, without going through a double."""
    return c.cast("decimal(9,0)") * F.lit(Decimal(1).scaleb(-digits))


def _select(df: DataFrame, table: Table, columns: dict[str, Column], **others: Column) -> DataFrame:
    declared = [columns[f.name].cast(f.type).alias(f.name) for f in table.fields if f.name in columns]
    return df.select(*declared, *[c.alias(n) for n, c in others.items()])


def delivery_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """One narrow row per line item, with what its delivery is derived from: a third of the bytes of a delivery."""
    lines = _read(spark, data_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"),
        F.expr("l_returnflag = 'N'").alias("unreturned"),
    )
    spread_lines = _spread(lines, "ok", "ln")
    heads = _read(spark, data_dir, "orders").selectExpr(
        "o_orderkey AS ok", "o_custkey AS ck", "datediff(o_orderdate, DATE'1995-01-01') % 540 AS dd",
        "cast(substr(o_orderpriority, 1, 1) AS int) AS prio",
    )
    nations = _read(spark, data_dir, "supplier").select(
        F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("nk")
    )
    # the larger lookup last: its join brings the lines of an order together, where repeated ones go before they travel
    base = lookup_join(spread_lines, nations, "sk", how="inner", keys_from=lines)
    return lookup_join(base, heads, "ok", how="inner", keys_from=lines)


def order_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """The order id of every delivery, repeated ones too, from keys alone."""
    lines = _read(spark, data_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"))
    suppliers = _read(spark, data_dir, "supplier").select(F.col("s_suppkey").alias("sk"))
    heads = _read(spark, data_dir, "orders").select(F.col("o_orderkey").alias("ok"))
    supplied = lookup_join(_spread(lines, "ok", "ln"), suppliers, "sk", how="inner", keys_from=lines).select("ok", "ln")
    ordered = lookup_join(supplied, heads, "ok", how="inner", keys_from=lines)
    return ordered.select(_order_id().alias("order_id"))


def _order_id() -> Column:
    return padded_id("ORD", F.expr("ok*10 + ln"), 9)


def deliveries(base: DataFrame, *also: str) -> DataFrame:
    """The deliveries of narrow rows, with repeated order ids as they come, and with columns of these rows if asked for.

    ``forced_late`` and ``delivery_failed`` are the draws behind lateness and status.
    """
    keys = base.selectExpr(
        "*",
        "(pk*7919 + sk*104729 + ok*31) % 86400 AS sec",
        "(pk*7 + ok*13 + ln*101) % 1000 AS kd",
        "(ok*17 + ln*131 + pk*3) % 801 AS kc",
        "(pk*29 + ok*11 + ln*7) % 100 AS kw",
        "(pk*41 + ok*5 + ln*3) % 121 AS kn",
        "(pk*61 + ok*23 + ln*19) % 50 AS kf",
        "(pk*37 + ok*43 + ln*47) % 400 AS kr",
        "(pk*53 + ok*59 + ln*67) % 160001 AS ka",
        "(pk*71 + ok*73 + ln*79) % 160001 AS ko",
        "3 + (pk*13 + ln) % 15 AS prep",
    ).withColumn("hr", F.expr("sec div 3600"))
    peak = dates.is_peak("hr")
    keys = keys.withColumns({
        "peak": peak,
        "sla": _cut("prio", (3, settings.SLA_MINUTES["express"]), (5, settings.SLA_MINUTES["standard"]),
                    other=settings.SLA_MINUTES["scheduled"]),
        "dist_h": F.expr("30 + (kd*kd*1170) div 1000000"),
        "wx": _cut("kw", (12, F.expr("12 + kn % 5")), (18, F.expr("28 + kn % 5")),
                   (21, F.expr("8 + kn % 5")), (23, F.expr("45 + kn % 5")), other=F.expr("kn % 5")),
        "cong": F.when(peak, F.expr("((1000 + kc)*13) div 10")).otherwise(F.expr("1000 + kc")),
        "eff": F.when(peak, F.expr("((1000 + greatest(kr - 250, 0))*(105 + kr % 31)) div 100"))
        .otherwise(F.expr("1000 + greatest(kr - 250, 0)")),
    })
    keys = keys.withColumns({
        "act": F.expr("least(greatest((dist_h*cong*24) div 100000 + prep*10 + wx*10 + kn - 60, 50), 1800)"),
        "cost": F.when(peak, F.expr("((2500 + (dist_h*35) div 10)*125) div 100"))
        .otherwise(F.expr("2500 + (dist_h*35) div 10")) + F.expr("(kr*5) div 2"),
    })
    late = F.expr("act > sla*10 OR kf = 0")
    created = F.expr("timestampadd(SECOND, dd*86400 + sec, TIMESTAMP'2023-01-01 00:00:00')")
    store_lat = _by_city("nk", LATITUDES) + F.expr("(sk*7001) % 300001 - 150000")
    store_lon = _by_city("nk", LONGITUDES) + F.expr("(sk*9001) % 300001 - 150000")
    facts = keys.withColumns({"late": late, "created_at": created})
    return _select(facts, ORDERS, {
        "order_id": _order_id(),
        "created_at": F.col("created_at"),
        "city": _by_city("nk", CITY_NAMES),
        "dark_store_id": padded_id("DS", F.expr("sk - CASE WHEN sk % 10 = 9 THEN 1 ELSE 0 END"), 4),
        "rider_id": padded_id("R", F.expr("ck + CASE WHEN ck % 40 = 1 THEN 900000 ELSE 0 END"), 6),
        "order_type": _cut("prio", (3, "express"), (5, "standard"), other="scheduled"),
        "sla_minutes": F.col("sla"),
        "delivery_distance_km": _scaled(F.col("dist_h"), 2),
        "actual_delivery_min": _scaled(F.col("act"), 1),
        "prep_time_min": F.col("prep"),
        "travel_time_min": _scaled(F.expr("act - prep*10"), 1),
        "is_late": F.col("late"),
        "delay_minutes": _scaled(F.when(F.col("late"), F.expr("greatest(act - sla*10, 0)")).otherwise(0), 1),
        "weather_delay_min": F.col("wx"),
        "congestion_factor": _scaled(F.col("cong"), 3),
        "route_efficiency_score": _scaled(F.col("eff"), 3),
        "is_peak_hour": F.col("peak"),
        "delivery_lat": _scaled(store_lat + F.expr("ka - 80000"), 6),
        "delivery_lon": _scaled(store_lon + F.expr("ko - 80000"), 6),
        "total_cost_inr": _scaled(F.col("cost"), 2),
        "customer_rating": _scaled(
            F.when(F.expr("unreturned AND kf = 7"), F.lit(None))
            .when(F.col("late"), F.expr("10 + kr % 26")).otherwise(F.expr("35 + kr % 16")), 1),
        "attempt_count": _cut("kn", (106, 1), (118, 2), other=3),
        "status": F.when(F.col("kf") == 1, "failed").when(F.col("late"), "late").otherwise("on_time"),
        "hour_of_day": F.hour("created_at"),
        "day_of_week": dates.weekday0("created_at"),
        "month": F.month("created_at"),
        "is_weekend": dates.weekday0("created_at") >= 5,
    }, forced_late=F.expr("kf = 0"), delivery_failed=F.expr("kf = 1"), **{c: F.col(c) for c in also})


def riders(spark: SparkSession, data_dir: str) -> DataFrame:
    customers = _read(spark, data_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return _select(customers, RIDERS, {
        "rider_id": padded_id("R", F.col("k"), 6),
        "assigned_store": padded_id("DS", F.expr("k % 10"), 4),
        "city": _by_city("c_nationkey", CITY_NAMES),
        "experience_months": F.expr("1 + (k*37) % 59"),
        "vehicle_type": _cut("k % 20", (11, "2W-Petrol"), (16, "2W-EV"), (18, "Cycle"), other="3W-EV"),
        "shift_type": _cut("k % 7", (2, "Morning"), (3, "Afternoon"), (5, "Evening"), (6, "Night"), other="Full-Day"),
        "rating": _scaled(F.expr("320 + (k*91) % 181"), 2),
        "is_active": F.expr("k % 25 >= 3"),
        "base_efficiency_score": _scaled(F.expr("400 + (k*53) % 601"), 3),
    })


def dark_stores(spark: SparkSession, data_dir: str) -> DataFrame:
    suppliers = _read(spark, data_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return _select(suppliers, DARK_STORES, {
        "store_id": padded_id("DS", F.col("k"), 4),
        "city": _by_city("s_nationkey", CITY_NAMES),
        "latitude": _scaled(_by_city("s_nationkey", LATITUDES) + F.expr("(k*7001) % 300001 - 150000"), 6),
        "longitude": _scaled(_by_city("s_nationkey", LONGITUDES) + F.expr("(k*9001) % 300001 - 150000"), 6),
        "max_capacity": F.expr("300 + (k*97) % 400"),
        "zone_coverage_km": _scaled(F.expr("25 + (k*13) % 56"), 1),
        "tier": _cut("k % 5", (2, "Tier-1"), (4, "Tier-2"), other="Tier-3"),
    })


def weather(spark: SparkSession, data_dir: str) -> DataFrame:
    """One reading per hour: the latest event in it. Many hours have none."""
    events = _read(spark, data_dir, "events").select("event_id", "ts", "event_type")
    hours = events.select(
        "event_id",
        F.date_trunc("hour", F.expr(
            "timestampadd(MICROSECOND, (unix_micros(cast(ts AS timestamp)) - 1704067200000000)*18,"
            " TIMESTAMP'2023-01-01 00:00:00')")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "heavy_rain").when(F.col("event_type") == "signup", "rain")
        .when(F.col("event_type") == "purchase", "storm").otherwise("clear").alias("condition"),
    )
    latest = hours.groupBy("timestamp").agg(
        F.max("event_id").alias("event_id"), F.max_by("condition", "event_id").alias("condition"))
    return _select(latest, WEATHER, {
        "timestamp": F.col("timestamp"),
        "condition": F.col("condition"),
        "visibility_km": code_map("condition", settings.WEATHER_VISIBILITY_KM),
        "delay_impact_min": code_map("condition", settings.WEATHER_DELAY_MIN) + F.expr("event_id % 5"),
    })


def code_map(column: str, values: dict) -> Column:
    """Look a code up in a small fixed table."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)]


def dim_cities(spark: SparkSession) -> DataFrame:
    rows = [(name, lat, lon, zones, weight) for name, (lat, lon, zones, weight) in settings.CITIES.items()]
    return spark.createDataFrame(rows, "city_name string, lat double, lon double, zones int, weight double").select(
        "city_name",
        F.col("lat").cast("decimal(9,6)").alias("latitude"),
        F.col("lon").cast("decimal(9,6)").alias("longitude"),
        "zones", "weight",
    )


# Values no table may hold, by table and column, with the remainder of the key's number by 13 at which they
# stand; None takes the value away.
VIOLATIONS = {
    "orders": {"order_type": (0, "drone"), "status": (1, "lost"), "city": (2, None), "created_at": (3, None),
               "sla_minutes": (4, None), "order_id": (5, None)},
    "riders": {"vehicle_type": (0, "Horse"), "shift_type": (1, "Never"), "rider_id": (2, None)},
    "dark_stores": {"tier": (0, "Tier-9"), "latitude": (1, None), "store_id": (2, None), "longitude": (3, None), "max_capacity": (4, None)},
    "weather": {"condition": (0, "hail"), "timestamp": (1, None)},
    "dim_cities": {"tier": (0, "Tier-9"), "latitude": (5, None), "city_name": (6, None), "longitude": (7, None)},
}


def with_violations(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The raw tables with a share of wrong and missing values, for quality reports that find something."""
    number = {
        "orders": F.substring("order_id", 4, 20).cast("bigint"), "riders": F.substring("rider_id", 2, 20).cast("bigint"),
        "dark_stores": F.substring("store_id", 3, 20).cast("bigint"), "weather": F.hour("timestamp").cast("bigint"),
        "dim_cities": F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(CITY_NAMES) for x in (n, i)]), F.col("city_name")),
    }
    tables = {**raw, "dim_cities": raw["dim_cities"].withColumn("tier", F.lit("Tier-1"))}
    out = {}
    for name, df in tables.items():
        keyed = df.withColumn("_number", number[name] % 13)
        types = dict(df.dtypes)
        wrong = {
            c: F.when(F.col("_number") == at, F.lit(value).cast(types[c])).otherwise(F.col(c)) for c, (at, value) in VIOLATIONS[name].items()
        }
        out[name] = keyed.withColumns(wrong).drop("_number")
    return out

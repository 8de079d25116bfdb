"""Table definitions: columns, types, keys, allowed values and defaults.

One declaration per table serves the reader, the CREATE TABLE statements, the defaults and
the data-quality checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    default: object = None
    allowed: tuple[str, ...] | None = None
    references: tuple[str, str] | None = None
    unique: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{f.name}` {f.type}" for f in self.fields))

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


# --- Fixed values: allowed codes --------------------------------------------------------
CITY_TIERS = ("Metro", "Tier-1", "Tier-2")
STORE_TIERS = ("Tier-1", "Tier-2", "Tier-3")
VEHICLES = ("2W-Petrol", "2W-EV", "Cycle", "3W-EV")
SHIFTS = ("Morning", "Afternoon", "Evening", "Night", "Full-Day")
ORDER_TYPES = ("express", "standard", "scheduled")
STATUSES = ("on_time", "late", "failed")
CONDITIONS = ("clear", "rain", "heavy_rain", "fog", "storm")

DIM_CITIES = Table("dim_cities", (
    Field("city_name", "STRING", required=True, unique=True),
    Field("state", "STRING"),
    Field("latitude", "DECIMAL(9,6)", required=True),
    Field("longitude", "DECIMAL(9,6)", required=True),
    Field("timezone", "STRING", default="Asia/Kolkata"),
    Field("tier", "STRING", allowed=CITY_TIERS),
    Field("active", "BOOLEAN", default=True),
))

DARK_STORES = Table("dark_stores", (
    Field("store_id", "STRING", required=True, unique=True),
    Field("city", "STRING", references=("dim_cities", "city_name")),
    Field("latitude", "DECIMAL(9,6)", required=True),
    Field("longitude", "DECIMAL(9,6)", required=True),
    Field("max_capacity", "INT", required=True, default=400),
    Field("area_sqft", "INT"),
    Field("zone_coverage_km", "DECIMAL(4,1)"),
    Field("tier", "STRING", allowed=STORE_TIERS),
    Field("operational_since", "DATE"),
    Field("is_active", "BOOLEAN", default=True),
    Field("manager_name", "STRING"),
))

RIDERS = Table("riders", (
    Field("rider_id", "STRING", required=True, unique=True),
    Field("assigned_store", "STRING", references=("dark_stores", "store_id")),
    Field("city", "STRING"),
    Field("experience_months", "INT", default=0),
    Field("vehicle_type", "STRING", allowed=VEHICLES),
    Field("shift_type", "STRING", allowed=SHIFTS),
    Field("rating", "DECIMAL(3,2)"),
    Field("is_active", "BOOLEAN", default=True),
    Field("base_efficiency_score", "DECIMAL(5,3)"),
    Field("join_date", "DATE"),
))

ORDERS = Table("orders", (
    Field("order_id", "STRING", required=True, unique=True),
    Field("created_at", "TIMESTAMP", required=True),
    Field("city", "STRING", required=True),
    Field("dark_store_id", "STRING", references=("dark_stores", "store_id")),
    Field("rider_id", "STRING", references=("riders", "rider_id")),
    Field("order_type", "STRING", allowed=ORDER_TYPES),
    Field("sla_minutes", "INT", required=True),
    Field("delivery_distance_km", "DECIMAL(6,2)"),
    Field("actual_delivery_min", "DECIMAL(7,1)"),
    Field("prep_time_min", "INT"),
    Field("travel_time_min", "DECIMAL(7,1)"),
    Field("is_late", "INT", default=0),
    Field("delay_minutes", "DECIMAL(6,1)", default=0),
    Field("weather_delay_min", "DECIMAL(5,1)", default=0),
    Field("congestion_factor", "DECIMAL(5,3)"),
    Field("route_efficiency_score", "DECIMAL(5,3)"),
    Field("is_peak_hour", "INT", default=0),
    Field("delivery_lat", "DECIMAL(9,6)"),
    Field("delivery_lon", "DECIMAL(9,6)"),
    Field("total_cost_inr", "DECIMAL(8,2)"),
    Field("customer_rating", "DECIMAL(3,1)"),
    Field("attempt_count", "INT", default=1),
    Field("status", "STRING", allowed=STATUSES),
    Field("hour_of_day", "INT"),
    Field("day_of_week", "INT"),
    Field("month", "INT"),
    Field("is_weekend", "INT", default=0),
))

WEATHER = Table("weather", (
    Field("timestamp", "TIMESTAMP", required=True),
    Field("city", "STRING"),
    Field("condition", "STRING", allowed=CONDITIONS),
    Field("temperature_c", "DECIMAL(4,1)"),
    Field("humidity_pct", "DECIMAL(4,1)"),
    Field("wind_kmh", "DECIMAL(5,1)"),
    Field("visibility_km", "DECIMAL(4,1)"),
    Field("delay_impact_min", "INT", default=0),
))

TABLES = {t.name: t for t in (DIM_CITIES, DARK_STORES, RIDERS, ORDERS, WEATHER)}

# Columns the order checks insist on.
REQUIRED_ORDER_COLUMNS = (
    "order_id", "created_at", "city", "rider_id", "dark_store_id",
    "actual_delivery_min", "is_late", "delivery_distance_km",
)

DECIMAL_SCALES = {
    f.name: int(f.type.rstrip(")").split(",")[1])
    for f in ORDERS.fields
    if f.type.startswith("DECIMAL")
}


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Cast the columns that are present to the declared types; keep any others as they are.

    A column that is missing stays missing, so rules for optional columns still see that.
    Nanosecond timestamps arrive as numbers and become timestamps here.
    """
    declared = {f.name: f.type for f in table.fields}
    stored = dict(df.dtypes)

    def column(c: str):
        if c not in declared:
            return F.col(c)
        value = F.col(c)
        if stored[c] == "bigint" and declared[c] in ("TIMESTAMP", "DATE"):
            value = F.timestamp_micros(F.expr(f"`{c}` div 1000"))
        return value.cast(declared[c]).alias(c)

    return df.select(*[column(c) for c in df.columns])


def apply_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Fill declared defaults where a column is null or absent."""
    out = {}
    for f in table.fields:
        if f.default is None:
            continue
        value = F.lit(f.default).cast(f.type)
        out[f.name] = F.coalesce(F.col(f.name), value) if f.name in df.columns else value
    return df.withColumns(out)


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    return f"'{value}'" if isinstance(value, str) else str(value)


def create_table_sql(table: Table, location: str | None = None, name: str | None = None) -> str:
    """CREATE TABLE statement for the catalog, with the declared defaults."""
    columns = []
    for f in table.fields:
        text = f"`{f.name}` {f.type}"
        if f.required:
            text += " NOT NULL"
        if f.default is not None:
            text += f" DEFAULT {_literal(f.default)}"
        columns.append(text)
    where = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {name or table.name} ({', '.join(columns)}) USING PARQUET{where}"


def create_star_schema(spark: SparkSession, location: str) -> list[str]:
    """Create the five tables of the star schema in the current database."""
    for table in TABLES.values():
        spark.sql(create_table_sql(table, f"{location.rstrip('/')}/{table.name}"))
    return list(TABLES)

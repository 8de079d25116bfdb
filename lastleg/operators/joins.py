"""Joins of a fact table with lookup tables, safe for large lookups and for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lastleg.session import stage

# A lookup of at most this many (narrow) rows is sent to every executor; a larger one is
# shuffled.
BROADCAST_ROWS = 250_000

# A key with more than this share of the facts is hot. Fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000
HOT_SAMPLE = 0.01
SALTS = 4096


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count the rows of a stored table: this reads file footers only."""
    return df.count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    small: bool | None = None,
    hot_share: float = HOT_SHARE,
    sample: float | None = HOT_SAMPLE,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Attach lookup columns to facts; ``lookup`` has one row per key.

    A lookup of unknown size is stored and counted, so what derives it runs once. One that
    is small is broadcast, so the facts do not move.
    Otherwise both sides are shuffled on the key, except the rows of hot keys: their lookup
    rows are few (bounded by 1 / hot_share), so only those are broadcast, and the hot fact
    rows are spread over all partitions. Null keys, which match nothing, are spread too.

    Whether a key counts as hot is estimated from a sample of the facts and decides only
    where rows travel. Every fact row takes its values from exactly one of the two lookups.
    ``keys_from`` is a cheaper source of the same keys for that sample, such as the stored
    table the facts were derived from.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if small is None:
        lookup = stage(lookup, "lookup")
        small = fits_broadcast(lookup)
    if small:
        return facts.join(F.broadcast(lookup), keys, how)

    attributes = [c for c in lookup.columns if c not in keys]
    if how == "inner":
        facts = facts.na.drop("any", subset=keys)
    sampled = (facts if keys_from is None else keys_from).select(*keys).na.drop("any")
    if sample is not None:
        sampled = sampled.sample(withReplacement=False, fraction=sample, seed=17)
    counts = sampled.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = counts.select(F.sum("_n") * F.lit(hot_share)).scalar()
    hot_keys = counts.where(F.col("_n") > limit).select(*keys)
    hot = lookup.join(F.broadcast(hot_keys), keys, "left_semi").select(
        *keys, F.struct(F.lit(True).alias("_found"), *attributes).alias("_hot"))

    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)) + 1
    tagged = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | no_key, spread).otherwise(F.lit(0)))
    cold = lookup.select(
        *keys, F.struct(F.lit(True).alias("_found"), *attributes).alias("_cold"),
        F.lit(0).cast("bigint").alias("_salt"))
    joined = tagged.join(cold, [*keys, "_salt"], "left").withColumn("_row", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.where(F.col("_row").isNotNull())
    return joined.select(*facts.columns, *[F.col("_row")[a].alias(a) for a in attributes])


def nearest_reading(
    facts: DataFrame,
    readings: DataFrame,
    time: str,
    reading_time: str,
    value: str,
    by: str | None = None,
    default: float | int = 0,
    small: bool | None = None,
) -> DataFrame:
    """Nearest as-of join: the reading closest to the hour of each fact, on either side.

    Of two equally near readings the later one wins; without any reading the value is
    ``default``. The search runs once per hour of the calendar, not per fact: only the first
    and last reading of an hour can be nearest to any full hour, so both tables shrink to at
    most one row per hour (and ``by`` group) before the ordered windows. Their size is
    bounded by the time span, never by the number of facts.
    """
    keys = [by] if by else []
    hour = F.date_trunc("hour", F.col(time))
    hours = facts.select(*keys, hour.alias("_hour")).where(F.col("_hour").isNotNull()).distinct()

    at, result = F.col(reading_time), F.col(value)
    slot_of = F.date_trunc("hour", at - F.expr("INTERVAL 1 MICROSECOND")) + F.expr("INTERVAL 1 HOUR")
    reading = F.struct(at.alias("at"), result.alias("v"))
    slots = (
        readings.where(at.isNotNull())
        .groupBy(*keys, slot_of.alias("_hour"))
        .agg(F.min(reading).alias("_first"), F.max(reading).alias("_last"))
    )
    calendar = hours.withColumn("_asked", F.lit(True)).join(slots, [*keys, "_hour"], "full")
    before = W.partitionBy(*keys).orderBy("_hour").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Read backwards: a frame that grows is linear, one that shrinks is quadratic.
    after = W.partitionBy(*keys).orderBy(F.desc("_hour")).rowsBetween(W.unboundedPreceding, -1)
    on_the_hour = F.when(F.col("_last.at") == F.col("_hour"), F.col("_last"))
    found = calendar.withColumns({
        "_prev": F.last("_last", ignorenulls=True).over(before),
        "_next": F.coalesce(on_the_hour, F.last("_first", ignorenulls=True).over(after)),
    }).where("_asked")
    to_prev = F.unix_micros("_hour") - F.unix_micros("_prev.at")
    to_next = F.unix_micros("_next.at") - F.unix_micros("_hour")
    later = F.col("_prev").isNull() | (to_next <= to_prev)
    nearest = found.select(
        *keys, "_hour",
        F.coalesce(F.when(later, F.col("_next.v")).otherwise(F.col("_prev.v")), F.lit(default)).alias(value))
    out = lookup_join(facts.withColumn("_hour", hour), nearest, [*keys, "_hour"], small=small)
    return out.withColumn(value, F.coalesce(value, F.lit(default))).drop("_hour")


def store_lookup(orders: DataFrame, stores: DataFrame, fallback: tuple[float, float], small: bool | None = None) -> DataFrame:
    """Attach the city and position of each order's store; unknown stores get a fallback position."""
    attributes = stores.select(
        F.col("store_id").alias("dark_store_id"), F.col("city").alias("store_city"),
        F.col("latitude").cast("double").alias("store_lat"), F.col("longitude").cast("double").alias("store_lon"))
    lat, lon = fallback
    return lookup_join(orders, attributes, "dark_store_id", small=small).withColumns({
        "store_lat": F.coalesce("store_lat", F.lit(lat)),
        "store_lon": F.coalesce("store_lon", F.lit(lon)),
    })

"""The dashboard's filter set over orders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# The date presets, in days.
DATE_PRESETS = {"Last 30 Days": 30, "Last 90 Days": 90, "Last 6 Months": 180, "All Time": None}
ALL = "All"
# Day of ``created_at``, in tables stored with one folder per day.
DAY_COLUMN = "order_date"


def by_city(df: DataFrame, city: str = ALL, fall_back: bool = False) -> DataFrame:
    """Rows of one city; ``All`` keeps every row.

    With ``fall_back`` an unknown city keeps every row too. Whether it occurs is a scalar
    subquery, so the choice is made inside the job.
    """
    if city == ALL or "city" not in df.columns:
        return df
    match = F.col("city") == city
    if not fall_back:
        return df.where(match)
    hits = df.where(match).agg(F.count("*")).scalar()
    return df.where(match | (hits == 0))


def last_days(df: DataFrame, days: int | None, time: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before the newest one.

    The start is a scalar subquery; Spark pushes the comparison into the scan. A table
    stored by day has its day column compared too: the newest time is then looked up in the
    newest folder only, and older folders are never opened.
    """
    if days is None:
        return df
    latest = df
    if DAY_COLUMN in df.columns:
        latest = df.where(F.col(DAY_COLUMN) == df.agg(F.max(DAY_COLUMN)).scalar())
    newest = latest.agg(F.max(time).alias("newest"))
    start = newest.select(F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))
    out = df.where(F.col(time) >= start.scalar())
    if DAY_COLUMN in df.columns:
        first_day = newest.select(F.to_date(F.col("newest") - F.expr(f"INTERVAL {days} DAYS")))
        out = out.where(F.col(DAY_COLUMN) >= first_day.scalar())
    return out


@dataclass(frozen=True)
class OrderFilter:
    city: str = ALL
    order_types: tuple[str, ...] = field(default=())
    date_preset: str = "All Time"

    def apply(self, orders: DataFrame) -> DataFrame:
        """City, then order type (none chosen means all), then the relative date window."""
        out = by_city(orders, self.city)
        if self.order_types:
            out = out.where(F.col("order_type").isin(*self.order_types))
        if "created_at" in out.columns:
            out = last_days(out, DATE_PRESETS[self.date_preset])
        return out

"""Date and hour expressions. Weeks start on Monday and day 0 is Monday."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from lastleg import settings


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c: Column | str) -> Column:
    return F.to_date(_col(c))


def weekday0(c: Column | str) -> Column:
    return F.weekday(_col(c))


def cycle(c: Column | str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value."""
    angle = F.lit(2 * math.pi) * _col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_peak(hour: Column | str) -> Column:
    h = _col(hour)
    first, *others = settings.PEAK_HOURS
    out = h.between(*first)
    for band in others:
        out = out | h.between(*band)
    return out


def hour_weight(hour: Column | str) -> Column:
    """Demand weight of an hour; the last matching band of the settings wins."""
    h = _col(hour)
    out = F.lit(settings.HOUR_WEIGHT_DEFAULT)
    for start, end, weight in settings.HOUR_WEIGHTS:
        out = F.when((h >= start) & (h < end), F.lit(weight)).otherwise(out)
    return F.when(h.isNotNull(), out)


def whole_days(first: Column, last: Column) -> Column:
    """Complete days between two timestamps."""
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(86_400_000_000)).cast("bigint")

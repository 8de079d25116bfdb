"""Text formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lastleg.functions.numeric import py_round

DASH = "—"


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """Zero-padded id; a number with more digits than ``width`` keeps them all."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def fixed(c: Column | str, n: int) -> Column:
    """Number with ``n`` decimals; null for null."""
    value = py_round(c, n)
    return F.when(value.isNotNull(), F.format_string(f"%.{n}f", value))


def percent(c: Column, n: int) -> Column:
    """A share as text, such as 0.234 -> 23.4%."""
    return F.concat(fixed(c * 100.0, n), F.lit("%"))


def thousands(c: Column | str) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def display_number(c: Column, n: int = 1, suffix: str = "", integer: bool = False) -> Column:
    """Card text: grouped integers, fixed decimals, a dash when there is no value."""
    text = thousands(c) if integer else fixed(c, n)
    missing = c.isNull() if integer else (c.isNull() | F.isnan(c))
    return F.when(missing, F.lit(DASH)).otherwise(F.concat(text, F.lit(suffix)))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def zone_label(lat: Column | str, lon: Column | str, n: int = 2) -> Column:
    return F.concat(fixed(lat, n), F.lit("°N / "), fixed(lon, n), F.lit("°E"))

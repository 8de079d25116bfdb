"""Numeric column expressions with fixed rounding and averaging rules.

Three rounding rules are in use and must not be mixed:

* ``np_round``   array rounding: scale, round half to even, scale back;
* ``py_round``   scalar rounding: the decimal nearest to the exact binary value, as in
                 text formatting and ``round(float, n)``;
* ``dec_round``  SQL ``ROUND`` over a NUMERIC: half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lastleg.sources.schemas import DECIMAL_SCALES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return _col(c).cast("double")


def np_round(c: Column | str, n: int) -> Column:
    scale = F.lit(float(10**n))
    return F.rint(dbl(c) * scale) / scale


def py_round(c: Column | str, n: int) -> Column:
    """Correctly rounded decimal of the binary value.

    Scaling by 10^n can land on a false tie. The exact rest of the product decides it: the
    factor has few bits, so the high and low halves of ``x`` multiply without error.
    """
    x = dbl(c)
    p = F.lit(float(10**n))
    y = x * p
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    rest = (high * p - y) + (x - high) * p
    down = F.floor(y).cast("double")
    tie = (y - down) == F.lit(0.5)
    whole = (
        F.when(tie & (rest > 0), down + 1.0).when(tie & (rest < 0), down).otherwise(F.rint(y))
    )
    return whole / p


def dec_round(c: Column | str, n: int) -> Column:
    return F.round(_col(c).cast("decimal(38,10)"), n).cast("double")


def clip(c: Column | str, low: float | int | None = None, high: float | int | None = None) -> Column:
    """Limit a column to a range; unlike greatest/least a null stays null."""
    col = _col(c)
    out = col
    if high is not None:
        out = F.when(col > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(col < low, F.lit(low)).otherwise(out)
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """Double division; null, not an error, when the divisor is zero."""
    return F.try_divide(dbl(a), dbl(b))


def exact_sum(name: str, value: Column | None = None) -> Column:
    """Sum of a fact column without rounding error.

    Decimal facts are summed as ``DECIMAL(18,s)``: the widest type that still fits a machine
    word, so hundreds of billions of rows neither overflow nor leave the fast path.
    """
    c = F.col(name) if value is None else value
    scale = DECIMAL_SCALES.get(name)
    if scale is not None and scale < 6:
        c = c.cast(f"decimal(8,{scale})")
    return F.sum(c)


def exact_avg(name: str, value: Column | None = None) -> Column:
    """Mean over non-null values that does not depend on the order of rows."""
    c = F.col(name) if value is None else value
    return ratio(exact_sum(name, value), F.count(c))


def share(condition: Column) -> Column:
    """Share of all rows that meet a condition (a null condition counts as not met)."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))


def total(name: str) -> Column:
    """Sum that is zero, not null, when there is nothing to add."""
    return F.coalesce(exact_sum(name), F.lit(0))


def histogram_bin(c: Column | str, width: float) -> Column:
    """Index of the fixed-width bin a value falls in."""
    return F.floor(dbl(c) / F.lit(float(width))).cast("bigint")

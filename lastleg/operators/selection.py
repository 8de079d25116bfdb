"""Exact quantiles by distributed selection: the range that holds a rank is narrowed until it is small enough to sort.

A round takes borders from a bounded sketch of each group, counts the rows below, at and between the two borders around the wanted rank,
and goes on with the rows strictly between. The counts are exact, so the sketch decides how fast a range shrinks, never the result:
where it misses, that side of the range stays open. A rank that falls on a border is found without sorting, however many rows hold that value.
Only the last range is shuffled, by group and value, and it has at most ``sort_rows`` rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lastleg.functions.numeric import dbl
from lastleg.operators.joins import lookup_join
from lastleg.session import stage

# Borders a round chooses from, and the sketch's error as a share of the rows: one in ACCURACY.
BORDERS = 256
ACCURACY = 4096
# Rows of one group that a task may sort.
SORT_ROWS = 1_000_000

_RANKS = ("low", "high")


def _first_open() -> Column:
    return F.when(F.col("low_value").isNull(), F.col("low")).otherwise(F.col("high"))


def _last_open() -> Column:
    return F.when(F.col("high_value").isNull(), F.col("high")).otherwise(F.col("low"))


def _ranks(values: DataFrame, share: float) -> DataFrame:
    """Per group: the wanted place, the ranks on both sides of it, what is known of their values, the rows still in question."""
    at = (F.col("left") - 1) * F.lit(float(share))
    unknown = F.lit(None).cast("double")
    return values.groupBy("g").agg(F.count("*").alias("left")).select(
        "g", at.alias("at"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"),
        unknown.alias("low_value"), unknown.alias("high_value"), "left")


def _narrow(live: DataFrame, goal: DataFrame, sort_rows: int) -> tuple[DataFrame, DataFrame]:
    """One round: the rows between the borders around each rank, and the ranks among those."""
    grid = F.array(*[F.lit(i / BORDERS) for i in range(BORDERS + 1)])
    sketch = live.groupBy("g").agg(F.percentile_approx("v", grid, F.lit(ACCURACY)).alias("borders"))
    before = F.floor(_first_open() / F.col("left") * BORDERS) - 1
    behind = F.ceil((_last_open() + 1) / F.col("left") * BORDERS) + 1
    wide = F.col("left") > sort_rows
    chosen = goal.join(sketch, "g", "left").select(
        *goal.columns,
        F.when(wide & (before > 0), F.get("borders", before.cast("int"))).alias("lo"),
        F.when(wide & (behind < BORDERS), F.get("borders", behind.cast("int"))).alias("hi"))
    chosen = stage(chosen, "borders")

    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    placed = lookup_join(live, chosen.select("g", "lo", "hi"), "g", how="inner")
    no = F.lit(False)
    below, above = F.coalesce(v < lo, no), F.coalesce(v > hi, no)
    at_lo, at_hi = F.coalesce(v == lo, no), F.coalesce(v == hi, no)
    counts = placed.groupBy("g").agg(*[
        F.count_if(c).alias(name) for name, c in (("below", below), ("above", above), ("at_lo", at_lo), ("at_hi", at_hi))])
    met = chosen.join(counts, "g", "left")
    # A border that turns out to be on the wrong side of the rank is opened.
    low_side = lo.isNotNull() & (_first_open() >= F.col("below"))
    high_side = hi.isNotNull() & (_last_open() < F.col("left") - F.col("above"))
    cut = met.select(
        *goal.columns, F.when(low_side, lo).alias("lo"), F.when(high_side, hi).alias("hi"),
        F.when(low_side, F.col("below")).otherwise(0).alias("under"),
        F.when(low_side, F.col("at_lo")).otherwise(0).alias("on_lo"),
        F.when(high_side, F.col("above")).otherwise(0).alias("over"),
        F.when(high_side & ~F.coalesce(low_side & (lo == hi), no), F.col("at_hi")).otherwise(0).alias("on_hi"))
    between = F.col("left") - F.col("under") - F.col("on_lo") - F.col("on_hi") - F.col("over")
    cut = cut.withColumn("between", between)
    inner_start = F.col("under") + F.col("on_lo")

    def value(rank: str) -> Column:
        found = F.when(F.col(rank) < inner_start, F.col("lo")).when(F.col(rank) >= inner_start + F.col("between"), F.col("hi"))
        return F.coalesce(f"{rank}_value", found).alias(f"{rank}_value")

    moved = cut.select(
        "g", "at", *[(F.col(r) - inner_start).alias(r) for r in _RANKS], "part", *[value(r) for r in _RANKS], "between", "lo", "hi")
    solved = F.col("low_value").isNotNull() & F.col("high_value").isNotNull()
    moved = stage(moved.withColumn("left", F.when(solved, F.lit(0)).otherwise(F.col("between"))), "ranks")
    inside = lookup_join(live, moved.where("left > 0").select("g", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "g", how="inner")
    yes = F.lit(True)
    inside = inside.where(F.coalesce(v > F.col("_lo"), yes) & F.coalesce(v < F.col("_hi"), yes)).select("g", "v")
    return stage(inside, "narrowed"), moved.select(*goal.columns)


def exact_quantile(df: DataFrame, column: str, share: float, group: tuple[str, ...] = (), sort_rows: int = SORT_ROWS, name: str = "value") -> DataFrame:
    """(group, ``name``): the quantile of the non-null values of each group, between two values by linear interpolation.

    Groups without a value have no row; a null in ``group`` is a group of its own; NaN is the largest value.
    ``df`` is read twice or three times, one column and the group only, so pass a stored table.
    """
    key = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("all"))
    live = df.select(key.alias("g"), dbl(column).alias("v")).where(F.col("v").isNotNull())
    goal = stage(_ranks(live, share), "ranks")
    most = goal.agg(F.max("left")).first()[0] or 0
    while most > sort_rows:
        live, goal = _narrow(live, goal, sort_rows)
        before, most = most, goal.agg(F.max("left")).first()[0] or 0
        if most >= before:
            break
    counted = live.groupBy("g", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    lines = counted.withColumn("upto", upto).join(goal.where("left > 0").select("g", *_RANKS), "g")

    def held(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("upto") - F.col("n")) & (F.col(rank) < F.col("upto")), F.col("v"))).alias(f"{rank}_sorted")

    found = goal.join(lines.groupBy("g").agg(*[held(r) for r in _RANKS]), "g", "left")
    low, high = (F.coalesce(f"{r}_value", f"{r}_sorted") for r in _RANKS)
    part = F.col("part")
    between = F.when(low == high, low).otherwise((F.lit(1.0) - part) * low + part * high)
    return found.select(*[F.col("g")[c].alias(c) for c in group], F.when(part == 0, low).otherwise(between).alias(name))

"""Validation, de-duplication and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from lastleg.functions.numeric import np_round, ratio
from lastleg.sources.schemas import REQUIRED_ORDER_COLUMNS, TABLES, Table

# Total order used to choose among rows with the same order id when the file position is
# not known.
ORDER_TIE_BREAK = (
    "created_at", "dark_store_id", "rider_id", "actual_delivery_min",
    "delivery_lat", "delivery_lon", "total_cost_inr", "prep_time_min",
)
FILE_POSITION = ("_file", "_row")


def require_orders(tables: dict[str, DataFrame]) -> DataFrame:
    """The orders table, or an error naming what is missing."""
    orders = tables.get("orders")
    if orders is None:
        raise ValueError("there is no orders table")
    absent = sorted(set(REQUIRED_ORDER_COLUMNS).difference(orders.columns))
    if absent:
        raise ValueError("the orders table lacks " + ", ".join(absent))
    return orders


def keep_first(df: DataFrame, key: str = "order_id", order: tuple[str, ...] | None = None) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark limits every map task to one row per key before the shuffle, so a key repeated in
    a large part of the table costs no more than one row per task.
    """
    if order is None:
        positioned = all(c in df.columns for c in FILE_POSITION)
        # part files in the order of their numbers, which is not that of names of unequal length
        part = F.regexp_extract(F.col("_file"), r"part-(\d+)[^/]*$", 1).try_cast("bigint") if positioned else None
        order = (part, *FILE_POSITION) if positioned else tuple(c for c in ORDER_TIE_BREAK if c in df.columns)
    first = W.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", *FILE_POSITION)
    )


def dedup_counts(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows before and after de-duplication, from key counts alone."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("rows_removed"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Percentage of nulls for each column that has any, from one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot("_rows", df.columns, "column_name", "nulls")
        .where("nulls > 0")
        .select(
            "column_name", "nulls",
            np_round(ratio("nulls", "_rows") * 100.0, 2).alias("null_pct"))
        .where("null_pct > 0")
    )


def _checked(df: DataFrame, table: Table, rules: list[tuple[str, object]]) -> DataFrame:
    """Violation counts of row rules, one pass per table, one output row per rule."""
    if not rules:
        return None
    names = [name for name, _ in rules]
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(cond).alias(name) for name, cond in rules])
    return counted.unpivot("rows", names, "column_name", "violations").select(
        F.lit(table.name).alias("table_name"), "column_name", "rows", "violations")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def domain_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose coded column holds a value outside its allowed list."""
    parts = []
    for name, df in tables.items():
        table = TABLES[name]
        rules = [(f.name, ~F.col(f.name).isin(*f.allowed)) for f in table.fields
                 if f.allowed and f.name in df.columns]
        parts.append(_checked(df, table, rules))
    return _union(parts)


def null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows with no value in a column that must have one."""
    parts = []
    for name, df in tables.items():
        table = TABLES[name]
        rules = [(f.name, F.col(f.name).isNull()) for f in table.fields if f.required and f.name in df.columns]
        parts.append(_checked(df, table, rules))
    return _union(parts)


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Key values that occur more than once, and the rows beyond the first."""
    parts = []
    for name, df in tables.items():
        for f in TABLES[name].fields:
            if f.unique and f.name in df.columns:
                parts.append(
                    df.where(F.col(f.name).isNotNull()).groupBy(f.name).agg(F.count("*").alias("n"))
                    .agg(
                        F.count_if(F.col("n") > 1).alias("repeated_keys"),
                        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra_rows"))
                    .select(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                            "repeated_keys", "extra_rows"))
    return _union(parts)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References without a target row.

    The child side is reduced to one row per key value before the join, so the join sees
    distinct keys and a hot key is a single row.
    """
    parts = []
    for name, df in tables.items():
        for f in TABLES[name].fields:
            if not f.references or f.name not in df.columns or f.references[0] not in tables:
                continue
            parent, key = f.references
            keys = df.where(F.col(f.name).isNotNull()).groupBy(F.col(f.name).alias("key")).agg(F.count("*").alias("n"))
            targets = tables[parent].select(F.col(key).alias("key"))
            parts.append(
                keys.join(targets, "key", "left_anti")
                .agg(F.count("*").alias("orphan_keys"),
                     F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"))
                .select(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                        F.lit(parent).alias("parent_table"), "orphan_keys", "orphan_rows"))
    return _union(parts)

import datetime as dt

import pytest

from lastleg.operators import quality
from lastleg.sources import schemas


def test_missing_table_and_columns_are_named(make_orders):
    with pytest.raises(ValueError, match="no orders table"):
        quality.require_orders({})
    with pytest.raises(ValueError, match="rider_id"):
        quality.require_orders({"orders": make_orders({}, drop=("rider_id",))})


def test_first_duplicate_is_kept(make_orders):
    df = make_orders(
        {"order_id": "A", "prep_time_min": 9, "created_at": dt.datetime(2024, 1, 2)},
        {"order_id": "A", "prep_time_min": 3, "created_at": dt.datetime(2024, 1, 1)},
        {"order_id": "B"},
    )
    kept = {r.order_id: r.prep_time_min for r in quality.keep_first(df).collect()}
    assert kept == {"A": 3, "B": 5}
    assert tuple(quality.dedup_counts(df).first()) == (3, 2, 1)


def test_first_in_file_order(spark, make_orders, tmp_path):
    from lastleg.sources import tables
    df = make_orders(
        {"order_id": "A", "prep_time_min": 9, "created_at": dt.datetime(2024, 1, 2)},
        {"order_id": "A", "prep_time_min": 3, "created_at": dt.datetime(2024, 1, 1)},
    )
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    stored = tables.read_table(spark, str(tmp_path), "orders", positions=True)
    kept = quality.keep_first(stored)
    assert kept.columns == df.columns
    assert [r.prep_time_min for r in kept.collect()] == [9]


def test_hot_duplicates_are_cut_before_the_shuffle(make_orders):
    plan = quality.keep_first(make_orders({}))._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_null_profile(make_orders):
    df = make_orders({"customer_rating": None}, {}, {})
    assert [tuple(r) for r in quality.null_profile(df).collect()] == [("customer_rating", 1, 33.33)]


def test_domain_violations(make_orders):
    df = make_orders({"status": "lost"}, {"order_type": "slow"}, {"order_type": None}, {})
    got = {r.column_name: r.violations for r in quality.domain_violations({"orders": df}).collect()}
    assert got == {"order_type": 1, "status": 1}


def test_unique_orphan_and_null_checks(spark, make_orders):
    stores = spark.createDataFrame([("DS1", "Mumbai")], "store_id string, city string")
    orders = make_orders({"order_id": "A"}, {"order_id": "A", "dark_store_id": "DS9"}, {"order_id": "B", "dark_store_id": None, "city": None})
    tables = {"orders": orders, "dark_stores": stores}
    unique = {r.table_name: (r.repeated_keys, r.extra_rows) for r in quality.unique_violations(tables).collect()}
    assert unique == {"orders": (1, 1), "dark_stores": (0, 0)}
    orphan = {r.column_name: (r.orphan_keys, r.orphan_rows) for r in quality.orphans(tables).collect()}
    assert orphan["dark_store_id"] == (1, 1)
    nulls = {r.column_name: r.violations for r in quality.null_violations({"orders": orders}).collect()}
    assert nulls == {"order_id": 0, "created_at": 0, "city": 1, "sla_minutes": 0}


def test_defaults(spark, make_orders):
    df = make_orders({"is_late": None, "attempt_count": None}, drop=("is_weekend",))
    row = schemas.apply_defaults(df, schemas.ORDERS).first()
    assert (row.is_late, row.attempt_count, row.is_weekend) == (0, 1, 0)


def test_star_schema_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS star_test")
    spark.sql("USE star_test")
    try:
        assert schemas.create_star_schema(spark, str(tmp_path)) == ["dim_cities", "dark_stores", "riders", "orders", "weather"]
        spark.sql("INSERT INTO riders (rider_id) VALUES ('R1')")
        row = spark.table("riders").first()
        assert (row.rider_id, row.experience_months, row.is_active) == ("R1", 0, True)
    finally:
        for name in schemas.TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql("USE default")
        spark.sql("DROP DATABASE star_test")

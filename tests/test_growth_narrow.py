"""Tables that queries store and shuffle: only what they need, and the results stay whole."""

from datetime import datetime

import pytest

from conftest import DATA
from lastleg import session
from lastleg.operators import features, rollups
from lastleg.plans import etl
from lastleg.plans.registry import QUERIES
from lastleg.plans.warehouse import refresh
from lastleg.sources import tables


@pytest.mark.parametrize("name", ["ml_features", "store_table", "top_stores", "store_performance", "tier_prep"])
def test_no_enriched_orders_are_stored_for(spark, name):
    w = refresh(spark, DATA)
    narrow = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    assert "enriched" not in w.__dict__
    w = refresh(spark, DATA)
    assert w.enriched.count() > 0  # now they are there and read
    assert sorted(map(str, QUERIES[name](spark, DATA).collect())) == narrow


def test_peaks_by_store_are_those_of_every_order(spark, make_orders):
    orders = make_orders(
        *[{"order_id": f"A{i}", "dark_store_id": "DS1", "created_at": datetime(2024, 1, 1 + i // 3, 10)} for i in range(5)],
        {"order_id": "B1", "dark_store_id": "DS2", "created_at": None}, {"order_id": "C1", "dark_store_id": None})
    enriched = features.join_store_load(orders)
    got = rollups.store_performance(orders, day_counts=features.store_day_counts(orders))
    expected = rollups.store_performance(enriched)
    assert got.columns == expected.columns and got.dtypes == expected.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert {r.dark_store_id: r.peak_load for r in got.collect()} == {"DS1": 3, "DS2": None}


def test_orders_count_once_for_each_row_of_their_rider(spark, make_orders):
    """As in the enriched orders, whether riders have one row or several."""
    orders = make_orders(*[
        {"order_id": f"A{i}", "dark_store_id": "DS1", "rider_id": r, "created_at": datetime(2024, 1, 1, 10)} for i, r in enumerate(["R1", "R1", "R2", "R9", None])])
    schema = "rider_id string, experience_months int, base_efficiency_score double, rating double"
    for ids in (["R1", "R2", None], ["R1", "R1", "R1", "R2", None, None]):
        riders = spark.createDataFrame([(r, 1, 0.5, 4.0) for r in ids], schema)
        rows = features.per_rider_row(orders, riders)
        assert rows.columns == orders.columns
        joined = features.join_riders(orders, riders).select(*orders.columns)
        assert sorted(map(str, rows.collect())) == sorted(map(str, joined.collect()))
        got = rollups.store_performance(rows, day_counts=features.store_day_counts(orders))
        expected = rollups.store_performance(features.engineer(orders, riders))
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_update_stores_no_copy_of_changed_orders(spark, tmp_path, monkeypatch):
    w, stored = refresh(spark, DATA), []
    stage = etl.stage
    monkeypatch.setattr(etl, "stage", lambda df, name, **how: stored.append(name) or stage(df, name, **how))
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    few = w.orders.where("created_at >= TIMESTAMP'2024-04-01'")
    sources = {"riders": w.riders, "dark_stores": w.stores, "weather": w.weather}
    tables.save_tables({**sources, "orders": few.where("created_at < TIMESTAMP'2024-05-20'")}, raw, tables.RAW_TABLES)
    etl.update(spark, raw, out)
    tables.write_table(few, raw, "orders")
    etl.update(spark, raw, out)
    assert "changes" in stored and "changed_orders" not in stored
    assert tables.read_table(spark, out, "orders_enriched").count() == few.count()


def test_shuffled_files_go_with_their_query(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert "spark.sql.classic.shuffleDependency.fileCleanup.enabled" in session.SETTINGS

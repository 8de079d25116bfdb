import datetime as dt

import pytest
from pyspark.sql import functions as F

from lastleg.operators import features, joins


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def hot_facts(spark):
    """A third of the rows share one key; some keys are null or unknown."""
    return spark.range(30_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
    )


@pytest.fixture(scope="module")
def lookup(spark):
    known = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
    return known.unionByName(spark.createDataFrame([("hot", -1)], "key string, v bigint"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_shuffled_lookup_equals_broadcast(hot_facts, lookup, how):
    small = joins.lookup_join(hot_facts, lookup, "key", how, small=True)
    large = joins.lookup_join(hot_facts, lookup, "key", how, small=False)
    assert large.columns == ["id", "key", "v"]
    assert rows(large.select("id", "key", "v")) == rows(small.select("id", "key", "v"))


def test_hot_and_null_keys_are_spread(spark, hot_facts, lookup):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.lookup_join(hot_facts, lookup, "key", small=False)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 30_000
    assert max(sizes) < 2 * 30_000 / 8


def test_only_bounded_sides_are_broadcast(hot_facts, lookup):
    assert joins.fits_broadcast(lookup, 401) and not joins.fits_broadcast(lookup, 400)


def test_store_load_ignores_unknown_store(make_orders):
    df = make_orders({}, {}, {"dark_store_id": None}, {"created_at": dt.datetime(2024, 1, 2)})
    for small in (True, False):
        got = [r.store_daily_load for r in features.join_store_load(df, small).orderBy("order_id").collect()]
        assert got == [2, 2, None, 1]


def test_engineered_columns_do_not_depend_on_strategy(spark, make_orders):
    riders = spark.createDataFrame([("R1", 10, 0.5, 4.0)], "rider_id string, experience_months int, base_efficiency_score double, rating double")
    df = make_orders({}, {"rider_id": "R2"}, {"city": "Delhi", "hour_of_day": 3}, {"rider_id": None, "city": None})
    a, b = features.engineer(df, riders, small=True), features.engineer(df, riders, small=False)
    assert a.columns == [*df.columns, *features.ENGINEERED] == b.columns
    assert rows(a) == rows(b)


def test_constants_without_riders(make_orders):
    row = features.engineer(make_orders({}), None).first()
    assert (row.experience_months, row.base_efficiency_score, row.rating) == (24, 0.75, 4.0)


def reading(hour, minute, value):
    return (dt.datetime(2024, 1, 1, hour, minute), value)


def nearest(spark, make_orders, readings, *hours, by=None, city="Mumbai"):
    schema = "timestamp timestamp, delay_impact_min int" + (", city string" if by else "")
    weather = spark.createDataFrame(readings, schema)
    orders = make_orders(*[{"created_at": dt.datetime(2024, 1, 1, h, 45), "city": city} for h in hours])
    found = joins.nearest_reading(orders, weather, "created_at", "timestamp", "delay_impact_min", by=by)
    return [r.delay_impact_min for r in found.orderBy("order_id").collect()]


def test_nearest_prefers_the_later_reading_on_a_tie(spark, make_orders):
    assert nearest(spark, make_orders, [reading(9, 0, 1), reading(11, 0, 2)], 10) == [2]
    assert nearest(spark, make_orders, [reading(9, 30, 1), reading(10, 30, 2)], 10) == [2]


def test_nearest_on_either_side(spark, make_orders):
    readings = [reading(3, 0, 1), reading(9, 50, 2), reading(10, 20, 3)]
    assert nearest(spark, make_orders, readings, 0, 5, 7, 10, 23) == [1, 1, 2, 2, 3]


def test_nearest_without_readings_is_zero(spark, make_orders):
    assert nearest(spark, make_orders, [], 10) == [0]


def test_nearest_by_city(spark, make_orders):
    readings = [(*reading(10, 0, 7), "Delhi"), (*reading(2, 0, 5), "Mumbai")]
    assert nearest(spark, make_orders, readings, 10, by="city") == [5]


def test_nearest_against_brute_force(spark, make_orders):
    import random
    rng = random.Random(5)
    times = sorted(rng.sample(range(0, 24 * 60), 12))
    readings = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), i) for i, m in enumerate(times)]
    want = [min(range(12), key=lambda i: (abs(times[i] - 60 * h), -i)) for h in range(24)]
    weather = spark.createDataFrame(readings, "timestamp timestamp, delay_impact_min int")
    orders = make_orders(*[{"order_id": f"{h:02d}", "created_at": dt.datetime(2024, 1, 1, h, 30)} for h in range(24)])
    found = joins.nearest_reading(orders, weather, "created_at", "timestamp", "delay_impact_min")
    assert [r.delay_impact_min for r in found.orderBy("order_id").collect()] == want


def test_unknown_store_gets_fallback_position(spark, make_orders):
    stores = spark.createDataFrame([("DS1", "Mumbai", 1.5, 2.5)], "store_id string, city string, latitude double, longitude double")
    df = make_orders({}, {"dark_store_id": "DS9"})
    got = [(r.store_city, r.store_lat, r.store_lon) for r in joins.store_lookup(df, stores, (19.0, 72.8)).orderBy("order_id").collect()]
    assert got == [("Mumbai", 1.5, 2.5), (None, 19.0, 72.8)]

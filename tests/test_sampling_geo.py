import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lastleg.operators import metrics, geo, sampling


@pytest.fixture(scope="module")
def items(spark):
    """Five rows in six belong to one group."""
    return spark.range(3000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), F.when(F.col("id") % 6 == 0, "b").otherwise("a").alias("g"))


def by_hash(keys):
    return sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest() + k)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_sample_is_the_lowest_hashes(items, digits):
    keys = [r.key for r in items.collect()]
    got = {r.key for r in sampling.hash_sample(items, "key", 100, digits).collect()}
    assert got == set(by_hash(keys)[:100])
    assert sampling.hash_sample(items, "key", 99_999, digits).count() == 3000


@pytest.mark.parametrize("digits", [1, 3])
def test_split_is_exact_per_label(items, digits):
    got = sampling.stratified_split(items, "key", "g", digits=digits).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in got} == {
        ("a", "train"): 2000, ("a", "test"): 500, ("b", "train"): 400, ("b", "test"): 100}
    plain = sampling.stratified_split(items, "key", None, digits=digits).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in plain} == {"train": 2400, "test": 600}


@pytest.mark.parametrize("digits", [1, 3])
def test_rank_within_hot_group(items, digits):
    got = sampling.hash_rank(items, "key", ("g",), digits).collect()
    for g in ("a", "b"):
        mine = {r.key: r.position for r in got if r.g == g}
        assert {k: i + 1 for i, k in enumerate(by_hash(mine))} == mine


def test_roster_numbers_members(items):
    got = sampling.roster(items, "g", "key").groupBy("g").agg(F.max("position"), F.max("members"), F.countDistinct("position")).collect()
    assert {tuple(r) for r in got} == {("a", 2500, 2500, 2500), ("b", 500, 500, 500)}


def test_bootstrap_prefers_busy_hours(spark):
    orders = spark.range(24 * 200).select(
        F.concat(F.lit("o"), F.col("id")).alias("order_id"),
        F.expr("timestampadd(HOUR, cast(id % 24 AS int), TIMESTAMP'2024-01-01 00:00:00')").alias("created_at"))
    drawn = sampling.weighted_bootstrap(orders, 20_000)
    assert drawn.count() == 20_000 and drawn.select("draw").distinct().count() == 20_000
    per_hour = {r.hour: r["count"] for r in drawn.groupBy("hour").count().collect()}
    assert 9 < per_hour[18] / per_hour[3] < 12.5    # weights 3.2 and 0.3


def test_spine(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 22:30:00'), (TIMESTAMP'2024-01-02 01:00:00') AS t(ts)")
    assert sampling.hour_spine(df, "ts").count() == 4
    assert sampling.hour_spine(df.where("false"), "ts").count() == 0


def test_grid_cells(make_orders):
    df = make_orders({"delivery_lat": D("19.000499")}, {"delivery_lat": D("19.000500")}, {"delivery_lat": D("18.999600")}, {"delivery_lat": None})
    cells = [(r.lat_bin, r.order_count) for r in geo.geo_grid(df, 3).collect()]
    assert cells == [(19.0, 3)]                     # 19.0005 is a tie and goes to the even cell
    assert geo.geo_grid(df.drop("delivery_lat")).count() == 0


def test_zones(make_orders):
    rows = [{"delivery_lat": D(f"{10 * (i % 3)}.00000{i % 9}")} for i in range(30)]
    df = make_orders(*rows)
    zones = geo.delivery_zones(df, k=3, restarts=3).collect()
    assert sorted(z.order_count for z in zones) == [10, 10, 10]
    assert geo.delivery_zones(make_orders({}), k=3).count() == 0
    assert geo.delivery_zones(df.drop("delivery_lat")).count() == 0


def test_equal_distance_goes_to_the_first_centre(make_orders):
    row = make_orders({"delivery_lat": D("1.0"), "delivery_lon": D("0.0")}).select(geo.nearest_centre([(2.0, 0.0), (0.0, 0.0)]).alias("c")).first()
    assert row.c == 0


def test_crowded_scores_have_no_hot_range(spark):
    crowded = spark.range(200_000).selectExpr("pow(id / 200000D, 8) AS s")
    sizes = metrics.score_ranges(crowded, "s", ranges=128).groupBy("bucket").count()
    assert sizes.agg({"count": "max"}).first()[0] < 0.02 * 200_000

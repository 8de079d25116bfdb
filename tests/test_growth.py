"""Work that must grow no faster than the input: how it is dealt, and that the results stay whole."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import DATA
from lastleg import session
from lastleg.ml import boosting, store, train
from lastleg.operators import geo, joins, quality
from lastleg.operators.filters import DAY_COLUMN
from lastleg.plans.registry import QUERIES
from lastleg.plans.warehouse import refresh


def test_boosting_deals_many_rows_to_the_cores():
    assert boosting._partitions(0, 50_000, 12) == boosting._partitions(50_000, 50_000, 12) == 1
    assert boosting._partitions(120_000, 50_000, 12) == 3
    assert boosting._partitions(2_200_000, 50_000, 12) == 12  # a partition for each 50,000 rows would be 44
    assert boosting._partitions(132_000_000, 50_000, 12) == 132


def test_bounded_training_data_take_one_job(spark):
    """A job for each level of 400 trees spent its time on starting tasks."""
    df = spark.range(60_000).selectExpr("id", "double(id * 7 % 31) AS a", "double(id % 5) AS b", "double(id * 7 % 31 > 12) AS y").persist()
    df.count()
    args = dict(trees=30, depth=3, rate=0.3, row_share=0.7, seed=1)
    spark.sparkContext.setJobGroup("one job", "")
    one = boosting.fit(df, ["a", "b"], "y", "id", **args)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one job"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 10
    levels = boosting.fit(df, ["a", "b"], "y", "id", rows_per_partition=30_000, **{**args, "trees": 4})
    assert (one.feature[:4] == levels.feature).all() and (one.threshold[:4] == levels.threshold).all() and np.allclose(one.value[:4], levels.value)
    df.unpersist()


@pytest.mark.parametrize("name", ["score_orders_no_model", "no_model_bands"])
def test_answers_without_a_model_need_no_orders(spark, monkeypatch, name):
    """One row an order id, as from the orders, with lookups that are broadcast and with shuffled ones."""
    w = refresh(spark, DATA)
    small = QUERIES[name](spark, DATA).collect()
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    shuffled = QUERIES[name](spark, DATA).collect()
    assert "orders" not in w.__dict__ and "lines" not in w.__dict__
    monkeypatch.undo()
    assert sorted(r.order_id for r in w.orders.select("order_id").collect()) == sorted(r.order_id for r in small)
    assert sorted(small) == sorted(shuffled) == sorted(QUERIES[name](spark, DATA).collect())


def test_large_partitions_are_binned_in_chunks(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "double(id * 7 % 31) AS a", "double(id % 5) AS b", "double(id * 7 % 31 > 12) AS y")
    args = dict(trees=5, depth=3, rate=0.3, seed=1)
    whole = boosting.fit(df, ["a", "b"], "y", "id", **args)
    binned = {}
    for chunk in (100, 1000):
        monkeypatch.setattr(boosting, "_CHUNK", chunk)
        edges = boosting.bin_edges(df, ["a", "b"])
        block = boosting._blocks(df, ["a", "b"], "y", "id", edges, 1).collect()[0]
        binned[chunk] = sorted(map(tuple, np.vstack([block[0], block[1], block[2]]).T.tolist()))
        assert block[0].shape == (2, 500) and block[0].dtype == np.uint8
    assert binned[100] == binned[1000]
    assert (whole.feature[:, 0] == 0).all()


def test_forest_in_parts_is_one_forest(spark, monkeypatch, tmp_path):
    w = refresh(spark, DATA)
    rows = w.model_table.rows.count()
    monkeypatch.setattr(train, "MOST_DRAWS", 2 * rows)
    assert train.forest_parts(7, rows) == [2, 2, 2, 1] and train.forest_parts(3, 10**12) == [1, 1, 1]
    made = train.train_breach(w.model_table, trees=5)
    parts = made.model.fitted
    # four fifths of the rows are learned from
    assert [p.stages[-1].getNumTrees for p in parts] == [3, 2] and made.metrics["roc_auc"] > 0.9
    few = w.model_table.rows.limit(50).persist()
    each = []
    for p in parts:
        scored = p.transform(few).select("order_id", vector_to_array("probability")[1].alias("p"))
        each.append({r.order_id: r.p for r in scored.collect()})
    got = {r.order_id: r.s for r in made.model.score(few, "s").collect()}
    assert got == pytest.approx({k: (3 * each[0][k] + 2 * each[1][k]) / 5 for k in got})
    assert sum(v for _, v in made.importances()) == pytest.approx(1.0)
    store.save_models([made.model], str(tmp_path))
    again = store.load_model(str(tmp_path), train.BREACH)
    assert {r.order_id: r.s for r in again.score(few, "s").collect()} == pytest.approx(got)
    few.unpersist()


def test_zone_sums_of_a_task_equal_brute_force():
    rng = np.random.default_rng(3)
    points = rng.random((700, 2))
    centres = {0: rng.random((4, 2)), 2: np.vstack([points[:2], [[9.0, 9.0]]])}
    batches = [pa.RecordBatch.from_arrays([pa.array(b[:, 0]), pa.array(b[:, 1])], ["lat", "lon"]) for b in np.array_split(points, 3)]
    rows = [r for b in geo._sums_by_centre(centres)(iter(batches)) for r in b.to_pylist()]
    assert [(r["start"], r["cluster"]) for r in rows] == [(i, j) for i, c in centres.items() for j in range(len(c))]
    for r in rows:
        c = centres[r["start"]]
        d = ((points[:, None] - c) ** 2).sum(axis=2)
        mine = d.argmin(axis=1) == r["cluster"]
        assert r["n"] == mine.sum() and r["d"] == pytest.approx(d[mine].min(axis=1).sum())
        assert (r["lat"], r["lon"]) == pytest.approx(tuple(points[mine].sum(axis=0)))


@pytest.mark.parametrize("name", ["risk_bands", "alert_lines", "recommendation_text", "kpis_all", "clf_metrics", "risk_hist"])
def test_enriched_orders_are_not_built_for_row_scores_and_kpis(spark, name):
    w = refresh(spark, DATA)
    assert QUERIES[name](spark, DATA).count() > 0
    assert "enriched" not in w.__dict__


def test_store_totals_are_those_of_store_performance(spark):
    w = refresh(spark, DATA)
    columns = sorted(w.store_totals.columns)
    assert columns == sorted(c for c in w.store_performance.columns if c != "peak_load")
    assert w.store_totals.select(*columns).exceptAll(w.store_performance.select(*columns)).count() == 0
    assert w.risk_scored.select("order_id", "late_risk_score").exceptAll(w.enriched.select("order_id", F.col("late_risk_score"))).count() == 0


def test_boosting_sends_what_features_have_and_keeps_small_blocks(spark):
    df = spark.range(600).selectExpr("id", "double(id * 7 % 311) AS a", "double(id % 3) AS b", "double(id * 7 % 311 > 120) AS y")
    edges = boosting.bin_edges(df, ["a", "b"])
    block = boosting._blocks(df, ["a", "b"], "y", "id", edges, 1).collect()[0]
    assert sum(part.nbytes for part in block) == 600 * (2 + 1 + 4)
    assert boosting.KEPT.deserialized  # not compressed at every tree
    grower = boosting.Grower(2, 0.3, 1.0, 1.0, 1.0, 1, [len(e) + 1 for e in edges])
    chosen = np.array([0, 1])
    level = {"number": 0, "level": 0, "feature": np.full(7, -1), "cut": np.zeros(7, np.int64), "nodes": np.array([0]), "chosen": chosen}
    sums = grower.sums((*block, np.zeros(600)), level)
    assert sums.shape == (1, len(edges[0]) + 1 + 3, 2)
    spread = grower.spread(sums, chosen)
    assert spread.shape == (1, 2, len(edges[0]) + 1, 2) and not spread[0, 1, 3:].any()
    late = np.array([r.y for r in df.collect()])
    assert spread[0, :, :, 0].sum(axis=1) == pytest.approx([(0.5 - late).sum()] * 2)
    # a value's sums are those of its rows
    by_b = [sum(0.5 - r.y for r in df.collect() if r.b == v) for v in range(3)]
    assert spread[0, 1, :3, 0] == pytest.approx(by_b)


def test_orders_are_made_of_narrow_lines(spark):
    w = refresh(spark, DATA)
    by_id = {r["order_id"]: r for r in w.orders.collect()}
    assert "lines" not in w.__dict__  # no deliveries are stored on the way
    assert set(w.lines.columns) == {"ok", "pk", "sk", "ln", "unreturned", "nk", "ck", "dd", "prio"}
    whole = quality.keep_first(w.deliveries).withColumn(DAY_COLUMN, F.to_date("created_at"))
    assert whole.columns == w.orders.columns
    assert {r["order_id"]: r for r in whole.collect()} == by_id and len(by_id) > 4000
    plan = w.dealt_lines._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and "customer_rating" not in plan


def test_partitions_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for size, expected in ((0, least), (6 * 2**30, 1536), (12 * 2**30, 3072)):
        session.deal(spark, size)
        assert int(spark.conf.get(key)) == expected
    refresh(spark, DATA)
    assert int(spark.conf.get(key)) == least


def test_raw_orders_are_sorted_as_lines(spark):
    w = refresh(spark, DATA)
    order = ("order_id", *quality.ORDER_TIE_BREAK)
    got = [tuple(r[c] for c in order) for r in w.deliveries_in_order.collect()]
    assert got == sorted(got) and len(got) == w.deliveries.count()
    assert sorted(got) == sorted(tuple(r[c] for c in order) for r in w.deliveries.collect())
    plan = w.deliveries_in_order._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "sec" not in below and "created_at" not in below  # nothing but lines and the id travels

"""Models over more rows: jobs, rows added up, and that forests and trees stay whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.ml import boosting, forest, train
from lastleg.plans.warehouse import refresh


@pytest.fixture(scope="module")
def made(spark):
    """Rows of four features, a class and a number."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((3000, 4)), 2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    z = np.round(30 * x[:, 2] + 5 * y, 3)
    df = spark.createDataFrame([(i, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, z))], "id long, a double, b double, c double, d double, y double, z double")
    df = df.repartition(4).persist()
    yield df, x, y, z
    df.unpersist()


# --- Forests --------------------------------------------------------------------------------

def test_a_level_of_a_forest_is_one_job(spark, made):
    df = made[0]
    spark.sparkContext.setJobGroup("forest", "")
    with forest.binned(df, list("abcd"), "y", "id", False) as rows:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
        model = forest.grow(rows, 40, 4, 5, 1)
        after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert after - before == 4 and model.getNumTrees == 40
    assert (model.feature[:, 0] >= 0).all() and (model.feature[:, 15:] == -1).all()


@pytest.mark.parametrize("label,regressor", [("y", False), ("z", True)])
def test_forest_is_alike_on_any_partitions(made, monkeypatch, label, regressor):
    df, x, y, z = made
    grown = []
    for rows_per_partition in (20_000, 500):
        monkeypatch.setattr(forest, "ROWS_PER_PARTITION", rows_per_partition)
        with forest.binned(df, list("abcd"), label, "id", regressor) as rows:
            assert (rows.blocks.getNumPartitions() > 2) == (rows_per_partition == 500)
            assert sum(b[0].shape[1] for b in rows.blocks.collect()) == 3000
            grown.append(forest.grow(rows, 12, 5, 5, 7))
    one, many = grown
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all() and np.allclose(one.value, many.value)
    assert np.allclose(one.importances, many.importances) and sum(one.importances) == pytest.approx(1.0)
    error = np.abs(one.predict(x) - (z if regressor else y)).mean()
    assert error < (1.5 if regressor else 0.1)


def test_a_split_of_a_forest_is_the_best_of_its_draw(made):
    """The root of a tree against every split of the features drawn for it, over the rows as often as drawn."""
    df, x, y, _ = made
    with forest.binned(df, list("abcd"), "y", "id", False) as rows:
        model = forest.grow(rows, 3, 1, 5, 11)
        edges = rows.edges
    draws = np.array([r.d for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(2**31)).alias("d")).orderBy("id").collect()], np.uint32)
    grower = forest.Grower(3, 1, 5, 11, 2, [len(e) + 1 for e in edges])
    for tree in range(3):
        n = forest._times(draws, tree, 11)
        assert abs(n.mean() - 1) < 0.1
        worth = lambda m: (n[m] @ y[m]) ** 2 / n[m].sum()
        gains = {}
        for f in grower.chosen(tree, 0)[0]:
            for cut in edges[f]:
                low = x[:, f] <= cut
                if min(n[low].sum(), n[~low].sum()) >= 5:
                    gains[f, cut] = worth(low) + worth(~low)
        best = max(gains, key=gains.get)
        assert (model.feature[tree, 0], model.threshold[tree, 0]) == best
        low = x[:, best[0]] <= best[1]
        assert model.value[tree].tolist() == pytest.approx([n @ y / n.sum(), n[low] @ y[low] / n[low].sum(), n[~low] @ y[~low] / n[~low].sum()])


def test_forest_reads_lines_longer_than_a_short_number(spark):
    """Places in a matrix of many rows are beyond 16 bits."""
    df = spark.range(90_000).selectExpr("id", *[f"double(id * {7 + i} % 101) AS f{i}" for i in range(8)]).withColumn("y", (F.col("f7") > 50).cast("double"))
    with forest.binned(df, [f"f{i}" for i in range(8)], "y", "id", False) as rows:
        model = forest.grow(rows, 20, 6, 5, 3)
    assert np.argmax(model.importances) == 7
    scored = model.transform(df).where("id % 50 = 0").select("y", "prediction").collect()
    assert np.mean([r.y == r.prediction for r in scored]) > 0.95


def test_forests_answer_for_all_orders(spark):
    w = refresh(spark, DATA)
    rows = w.model_table.rows.count()
    breach, delay = train.side_by_side(w.model_table, [lambda t: train.train_breach(t, trees=4), lambda t: train.train_delay(t, trees=4)])
    assert (breach.name, delay.name) == (train.BREACH, train.DELAY) and breach.n_train + breach.n_test == rows
    assert [type(s).__name__ for s in breach.model.fitted[0].stages] == ["StringIndexerModel", "ForestModel"]


# --- Boosting -------------------------------------------------------------------------------

def test_millions_of_rows_are_boosted_by_one_job():
    assert boosting._partitions(2_192_932, boosting.ALONE_ROWS, 12) == 1
    assert boosting._partitions(2_500_001, boosting.ALONE_ROWS, 12) == 2
    assert boosting._partitions(22_000_000, boosting.ALONE_ROWS, 12) > 8


def test_the_lighter_sibling_is_added_up(made):
    """A split that parts a few rows from many needs the few alone."""
    _, x, y, _ = made
    binned = np.minimum(x.T * 50, 49).astype(np.uint8)
    grower = boosting.Grower(3, 0.3, 1.0, 1.0, 1.0, 1, [50] * 4)
    block = (binned, y.astype(np.uint8), np.arange(3000, dtype=np.uint32), np.zeros(3000))
    asked = []

    def total(level):
        node = boosting._walk(binned, np.arange(3000), level["feature"], level["cut"], level["level"])
        asked.append((level["level"], [(int((node == n).sum()), int((node == (n + 1 if n % 2 else n - 1)).sum())) for n in level["nodes"]]))
        return grower.sums(block, level)

    tree = grower.grow(0, np.arange(4), total)
    assert [level for level, _ in asked] == [0, 1, 2]
    assert all(mine <= other for level, pairs in asked if level for mine, other in pairs)
    alone = grower.alone(block, [np.arange(4)])[0]
    assert (alone[0] == tree[0]).all() and (alone[1] == tree[1]).all() and np.allclose(alone[3], tree[3])


def test_packed_features_add_up_alike():
    rng = np.random.default_rng(8)
    hour = rng.integers(0, 24, 5000)
    binned = np.array([hour, hour >= 12, hour % 6, rng.integers(0, 200, 5000), rng.integers(0, 200, 5000)]).astype(np.uint8)
    bins = [24, 2, 6, 200, 200]
    packs = boosting._packs(binned, bins)
    assert sorted(f for _, _, values in packs for f in values) == list(range(5)) and len(packs) < 5
    weight = rng.random(5000)
    for line, count, values in packs:
        assert line.max() < count <= boosting.PACK_BINS
        for f, bin_of in values.items():
            assert (bin_of[line] == binned[f]).all()
            got = np.bincount(bin_of, np.bincount(line, weight, count), bins[f])
            assert got == pytest.approx(np.bincount(binned[f], weight, bins[f]))

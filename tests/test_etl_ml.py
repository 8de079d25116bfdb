import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.ml import boosting, prepare, score, store, train
from lastleg.operators import filters, metrics
from lastleg.plans import etl
from lastleg.plans.warehouse import warehouse
from lastleg.sources import tables


@pytest.fixture(scope="module")
def w(spark):
    return warehouse(spark, DATA)


@pytest.fixture(scope="module")
def built(spark, w, tmp_path_factory):
    raw, out = str(tmp_path_factory.mktemp("raw")), str(tmp_path_factory.mktemp("out"))
    few = w.orders.where("created_at >= TIMESTAMP'2024-03-01'").unionByName(w.orders.where("created_at >= TIMESTAMP'2024-05-01'"))
    tables.save_tables({"orders": few, "riders": w.riders, "dark_stores": w.stores}, raw, tables.RAW_TABLES)
    with pytest.warns(UserWarning, match="weather.parquet not found"):
        found = etl.run(spark, raw, out)
    return raw, out, found


def test_chain_saves_five_tables(spark, built):
    raw, out, found = built
    assert set(found) == {"orders", "riders", "dark_stores", *tables.DERIVED_TABLES}
    assert found["orders_enriched"].count() == found["orders"].count() == found["orders"].select("order_id").distinct().count()
    for name in tables.DERIVED_TABLES:
        assert tables.read_table(spark, out, name).count() == found[name].count()


def test_loads_with_fallback(spark, built):
    raw, out, _ = built
    assert "orders_enriched" in tables.load_dashboard(spark, out)
    fallback = tables.load_dashboard(spark, raw)
    assert fallback["orders_enriched"] is fallback["orders"]
    assert "late_risk_score" in tables.load_training(spark, out).columns
    assert "late_risk_score" not in tables.load_training(spark, raw).columns
    assert list(tables.load_tables(spark, out, ("orders_enriched",))) == ["orders_enriched"]
    with pytest.raises(FileNotFoundError):
        tables.load_training(spark, raw + "/none")


def test_time_filter_skips_day_folders(spark, built):
    stored = tables.read_table(spark, built[1], "orders_enriched")
    recent = filters.last_days(stored, 30)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "order_id" in line][0]
    assert "order_date" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert recent.count() == filters.last_days(stored.drop("order_date"), 30).count()


def test_reads_files_written_by_pandas(spark, tmp_path):
    import pandas as pd
    frame = pd.DataFrame({
        "order_id": ["ORD1"], "created_at": pd.to_datetime(["2024-02-03 04:05:06"]).astype("datetime64[ns]"),
        "total_cost_inr": [41.25], "is_late": [1], "other": ["kept"]})
    frame.to_parquet(tmp_path / "orders.parquet", index=False)
    pd.DataFrame({"rider_id": ["R1"], "join_date": pd.to_datetime(["2022-01-05"]).astype("datetime64[ns]")}).to_parquet(
        tmp_path / "riders.parquet", index=False)
    df = tables.read_table(spark, str(tmp_path), "orders")
    assert dict(df.dtypes) == {
        "order_id": "string", "created_at": "timestamp", "total_cost_inr": "decimal(8,2)", "is_late": "int", "other": "string"}
    assert str(df.first().created_at) == "2024-02-03 04:05:06"
    assert str(tables.read_table(spark, str(tmp_path), "riders").first().join_date) == "2022-01-05"


def test_missing_orders_stop_the_chain(spark, tmp_path):
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no orders table"):
        etl.run(spark, str(tmp_path))


# --- Models -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def late(w):
    return train.train_late(w.model_table, iterations=60)


def test_late_model_quality(late):
    assert late.metrics["roc_auc"] > 0.9 and late.metrics["accuracy"] > 0.85
    assert late.metrics["n_train"] + late.metrics["n_test"] == 4599
    names = [n for n, _ in late.importances()]
    assert len(names) == 24 and "city_enc" in names


def test_other_models(w):
    assert train.train_breach(w.model_table, trees=5).metrics["roc_auc"] > 0.9
    delay = train.train_delay(w.model_table, trees=5)
    late_rows = w.enriched.where("is_late = 1").count()
    assert delay.metrics["r2"] > 0.4 and delay.population == train.LATE_ORDERS
    assert delay.n_train + delay.n_test == late_rows
    no_leak = train.train_congestion(w.model_table, iterations=2, exclude=("congestion_factor",))
    assert "congestion_factor" not in no_leak.features and no_leak.metrics["roc_auc"] > 0.6


def test_few_late_rows_use_all_orders(w):
    few = w.enriched.where("order_id < 'ORD000001000'")
    rows = few.count()
    assert few.where("is_late = 1").count() < 1000
    delay = train.train_delay(train.model_table(few), trees=2)
    assert delay.population == train.ALL_ORDERS and delay.n_train + delay.n_test == rows


def test_results_and_scores_round_trip(spark, w, late, tmp_path):
    folder = str(tmp_path)
    train.save_results(train.results(spark, [late]), folder)
    back = train.load_results(spark, folder)
    assert back.first().accuracy == late.metrics["accuracy"] and len(back.first().top_features) == 10
    status = train.model_status(back).first()
    assert status.title == "Late Delivery" and status.sidebar_band == "good"
    assert train.top_features(back).count() == 10
    assert score.load_model(folder) is None
    train.save_models([late], folder)
    model = score.load_model(folder)
    gaps = w.enriched.withColumn("city", F.when(F.col("city") != "Delhi", F.col("city"))).withColumn("prep_time_min", F.lit(None).cast("int"))
    scored = score.score_orders(gaps, model)
    assert scored.columns == [*gaps.columns, "late_prob"]
    assert scored.where("late_prob IS NULL OR late_prob < 0 OR late_prob > 1").count() == 0
    bands = {r.risk_level for r in score.risk_bands(scored).select("risk_level").distinct().collect()}
    assert bands <= {"HIGH", "MEDIUM", "LOW"}
    with pytest.raises(Exception, match="(?i)unseen|Atlantis"):
        score.score_orders(w.enriched.limit(5).withColumn("city", F.lit("Atlantis")), model).collect()


def test_boosting_is_alike_on_any_partitions(spark):
    """The trees are those of plain histogram boosting over all rows, however many partitions hold them."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 5)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=900) > 0.4).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, y double")
    args = dict(trees=30, depth=4, rate=0.2, row_share=0.8, column_share=0.8, min_child_weight=2, seed=3)
    one = boosting.fit(df, list("abcde"), "y", "id", **args)
    many = boosting.fit(df, list("abcde"), "y", "id", rows_per_partition=300, **args)
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all() and np.allclose(one.value, many.value)
    p = np.array([r.p for r in df.orderBy("id").select(one.probability().alias("p")).collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-one.margins(x)))) and brute_auc(list(zip(y, p))) > 0.97
    assert abs(one.importances().sum() - 1) < 1e-9 and one.importances()[:3].min() > one.importances()[3:].max()


def test_first_split_is_the_best_of_all(spark):
    """The root of the first tree against every split of every feature, by the second-order gain."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, (400, 3)).astype(float)
    y = (x[:, 1] > 17).astype(float) * (rng.random(400) > 0.1)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    m = boosting.fit(df, list("abc"), "y", "id", trees=1, depth=1, rate=1.0)
    g, h = y.mean() - y, np.full(400, y.mean() * (1 - y.mean()))
    worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
    gains = {(j, v): worth(x[:, j] <= v) + worth(x[:, j] > v) - worth(x[:, j] < 99) for j in range(3) for v in range(39)
             if min(h[x[:, j] <= v].sum(), h[x[:, j] > v].sum()) >= 1}
    best = max(gains, key=gains.get)
    assert (m.feature[0][0], m.threshold[0][0]) == best and m.gain[0][0] == pytest.approx(gains[best])
    left = x[:, best[0]] <= best[1]
    assert m.value[0][1:3].tolist() == pytest.approx([-g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_constant_labels_and_features(spark):
    df = spark.createDataFrame([(i, 1.0, 0.0) for i in range(20)], "id long, a double, y double")
    m = boosting.fit(df, ["a"], "y", "id", trees=2, depth=2, rate=0.1)
    assert (m.feature == -1).all() and m.importances().tolist() == [0.0]
    assert all(r.p < 0.01 for r in df.select(m.probability().alias("p")).collect())


def test_store_swaps_versions_and_loads_once(spark, w, late, tmp_path):
    folder = str(tmp_path)
    first = store.save_models([late.model], folder)
    held = store.load_model(folder)
    assert store.load_model(folder) is held
    breach = train.train_breach(w.model_table, trees=2)
    delay = train.train_delay(w.model_table, trees=2)
    second = store.save_models([breach.model, delay.model], folder)
    assert first != second and store.load_model(folder) is held  # the other models stay
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("manifest")] == ["manifest.json"]
    rows = w.enriched
    for name in (train.LATE, train.BREACH, train.DELAY):
        rows = store.score_orders(rows, store.load_model(folder, name), name)
    assert rows.count() == w.enriched.count()
    assert rows.where("late_delivery NOT BETWEEN 0 AND 1 OR sla_breach NOT BETWEEN 0 AND 1 OR delay_estimation < 0").count() == 0
    again = store.save_models([late.model], folder)
    newer = store.load_model(folder)
    assert newer is not held and again != second and (newer.fitted.value == held.fitted.value).all()


def test_regressor_status_has_no_auc(spark):
    table = spark.createDataFrame([("delay_estimation", "late orders", None, None, None, None, None, 3.3, 0.88, None, None, None)], train.RESULT_SCHEMA)
    row = train.model_status(table).first()
    assert (row.score, row.sub_text, row.card_band, row.card_text) == (0.88, "Regressor", "success", "88.0%")


def test_median_fills_gaps(spark, make_orders):
    df = make_orders({"prep_time_min": 4}, {"prep_time_min": 9}, {"prep_time_min": None})
    filled = prepare.impute_medians(df, ["prep_time_min", "month"])
    assert sorted(r.prep_time_min for r in filled.collect()) == [4.0, 6.5, 9.0]


def test_city_codes_are_alphabetical(make_orders):
    df = make_orders({"city": "Pune"}, {"city": "Delhi"}, {"city": "Pune"})
    assert [(r.city, r.city_enc) for r in prepare.encode_city(df).orderBy("order_id").collect()] == [("Pune", 1), ("Delhi", 0), ("Pune", 1)]


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    pairs = [(int(i * 7 % 11 < 4), round((i * 37 % 101) / 101, 2)) for i in range(300)]
    df = spark.createDataFrame(pairs, "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute_auc(pairs), abs=1e-12)
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.roc_auc(same, "y", "s").first()[0] == 0.5


def test_metrics_of_a_perfect_and_an_empty_call(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, s double")
    good = metrics.classification_metrics(df, "y", "s").first()
    assert (good.accuracy, good.roc_auc, good.precision, good.recall, good.f1) == (1.0, 1.0, 1.0, 1.0, 1.0)
    none = metrics.classification_metrics(df, "y", "s", 0.95).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (3.0, 2.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert (row.n, row.mae_minutes, row.r2) == (2, 0.75, round(1 - 1.25 / 2, 4))

"""The four models: late delivery, SLA breach, delay minutes and congestion risk."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from lastleg import settings
from lastleg.functions.text import fixed, percent, title_case
from lastleg.ml import boosting, forest
from lastleg.ml.prepare import CITY_CODE, distinct_cities, feature_rows
from lastleg.ml.store import Model, city_code
from lastleg.ml.store import save_models as _save_models
from lastleg.operators import derive
from lastleg.operators.metrics import classification_metrics, regression_metrics
from lastleg.operators.sampling import stratified_split
from lastleg.session import enable_checkpoints, stage

RESULT_SCHEMA = (
    "model string, population string, accuracy double, roc_auc double, precision double, recall double, f1 double,"
    " mae_minutes double, r2 double, n_train bigint, n_test bigint,"
    " top_features array<struct<feature: string, importance: double>>"
)
LATE, BREACH, DELAY, CONGESTION = "late_delivery", "sla_breach", "delay_estimation", "congestion_risk"
# The columns of enriched orders that models are made of.
INPUTS = ("order_id", "city", *settings.MODEL_FEATURES, "is_late", "delay_minutes")

ALL_ORDERS, LATE_ORDERS = "all orders", "late orders"


@dataclass
class Trained:
    name: str
    model: Model
    features: list[str]
    metrics: dict
    population: str = ALL_ORDERS
    n_train: int = 0
    n_test: int = 0

    def importances(self) -> list[tuple[str, float]]:
        """All features, most important first."""
        return self.model.importances()

    def result_row(self) -> tuple:
        m = self.metrics
        top = self.importances()[:10] if self.name == LATE else None
        return (
            self.name, self.population, m.get("accuracy"), m.get("roc_auc"), m.get("precision"), m.get("recall"), m.get("f1"),
            m.get("mae_minutes"), m.get("r2"), m.get("n_train"), m.get("n_test"), top,
        )


@dataclass
class ModelTable:
    """Imputed features and all labels of the orders, stored once for every model."""

    rows: DataFrame
    features: list[str]


def model_table(df: DataFrame) -> ModelTable:
    rows, features = feature_rows(df)
    labels = derive.labels()
    stored = stage(rows.select(
        "order_id", "city", *features, F.col("is_late").cast("double").alias("_late"),
        *[labels[c].cast("double").alias(f"_{c}") for c in ("sla_breach", "high_congestion", "delay_target")]), "model_table")
    return ModelTable(stored, features)


def _fit(name: str, table: ModelTable, label: str, learn, exclude: tuple[str, ...], stratify: bool, population: str = ALL_ORDERS) -> Trained:
    """Split, fit on the training rows and evaluate on the others. ``learn(train, features)`` gives the fitted model."""
    enable_checkpoints(table.rows.sparkSession)
    features = [c for c in table.features if c not in exclude]
    chosen = table.rows.where("_late = 1") if population == LATE_ORDERS else table.rows
    inputs = chosen.select("order_id", "city", *features, F.col(label).alias("label"))
    split = stratified_split(inputs, "order_id", "label" if stratify else None)
    split = stage(split.hint("coalesce", max(1, -(-table.rows.count() // ROWS_PER_PARTITION))), f"split_{name}")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    # one name for each city the model knows
    cities = [r["city"] for r in distinct_cities(train).collect()]
    model = Model(name, learn(train, features, cities), features, cities, regressor=name == DELAY)
    if name == DELAY:
        metrics = regression_metrics(model.score(test, "prediction"), "label", "prediction").first().asDict()
    else:
        scored = stage(model.score(test, "p").select("label", "p"), f"scored_{name}")
        metrics = classification_metrics(scored, "label", "p").first().asDict()
    n_test, n_train = metrics.pop("n"), train.count()
    metrics.update(n_train=n_train, n_test=n_test)
    if name != LATE:
        metrics = {k: metrics[k] for k in ("accuracy", "roc_auc", "mae_minutes", "r2") if k in metrics}
    return Trained(name, model, features, metrics, population, n_train, n_test)


ROWS_PER_PARTITION = 20_000
# A level of a forest is one job over all its trees, and its sums are of a size for each tree and partition. More draws (rows
# times trees) than these are learned in parts: forests of fewer trees, all of them over all rows.
MOST_DRAWS = 1_000_000_000


def forest_parts(trees: int, rows: int) -> list[int]:
    """The number of trees of each part of a forest."""
    parts = min(trees, max(1, -(-trees * rows // MOST_DRAWS)))
    return [trees // parts + (i < trees % parts) for i in range(parts)]


def _forest(params: dict, trees: int | None, regressor: bool):
    """Learn a forest; all its parts learn from the rows binned once."""
    def learn(train: DataFrame, features: list[str], cities: list[str]):
        rows = train.withColumn(CITY_CODE, city_code(cities))
        indexer = StringIndexerModel.from_labels(cities, "city", CITY_CODE, handleInvalid="error")
        with forest.binned(rows, [*features, CITY_CODE], "label", "order_id", regressor) as data:
            return [
                PipelineModel([indexer, forest.grow(data, n, params["maxDepth"], params["minInstancesPerNode"], settings.MODEL_SEED + i)])
                for i, n in enumerate(forest_parts(trees or params["numTrees"], train.count()))
            ]
    return learn


def _boosted(iterations: int | None):
    params = {**settings.BOOSTED_TREES, **({"trees": iterations} if iterations else {})}

    def learn(train: DataFrame, features: list[str], cities: list[str]):
        rows = train.withColumn(CITY_CODE, city_code(cities))
        return boosting.fit(rows, [*features, CITY_CODE], "label", "order_id", seed=settings.MODEL_SEED, **params)
    return learn


def train_late(table: ModelTable, iterations: int | None = None, exclude: tuple[str, ...] = ()) -> Trained:
    return _fit(LATE, table, "_late", _boosted(iterations), exclude, stratify=True)


def train_breach(table: ModelTable, trees: int | None = None, exclude: tuple[str, ...] = ()) -> Trained:
    return _fit(BREACH, table, "_sla_breach", _forest(settings.FOREST_BREACH, trees, False), exclude, True)


def train_delay(table: ModelTable, trees: int | None = None, exclude: tuple[str, ...] = (),
                min_late_rows: int = settings.DELAY_MIN_LATE_ROWS) -> Trained:
    """Delay minutes of late orders; with fewer than ``min_late_rows`` of them, of all orders.

    The result row names the population. No row of it is left out.
    """
    population = LATE_ORDERS if table.rows.where("_late = 1").count() >= min_late_rows else ALL_ORDERS
    return _fit(DELAY, table, "_delay_target", _forest(settings.FOREST_DELAY, trees, True), exclude, False, population)


def train_congestion(table: ModelTable, iterations: int | None = None, exclude: tuple[str, ...] = ()) -> Trained:
    """High-congestion risk. The label is a threshold on ``congestion_factor``, itself a
    default feature; pass ``exclude=("congestion_factor",)`` for a model without that leak."""
    return _fit(CONGESTION, table, "_high_congestion", _boosted(iterations), exclude, True)


def train_all(table: ModelTable, iterations: int | None = None, trees: int | None = None) -> list[Trained]:
    """All four models over one stored table."""
    return side_by_side(table, [
        lambda t: train_late(t, iterations), lambda t: train_breach(t, trees), lambda t: train_delay(t, trees), lambda t: train_congestion(t, iterations)])


def side_by_side(table: ModelTable, learners: list[Callable[[ModelTable], Trained]]) -> list[Trained]:
    """Models over one stored table, at once: boosting a bounded number of rows takes one core, and forests leave cores idle between two levels."""
    enable_checkpoints(table.rows.sparkSession)
    with ThreadPoolExecutor(max(1, len(learners))) as pool:
        return list(pool.map(lambda learn: learn(table), learners))


# --- Results and model files -------------------------------------------------------------

def results(spark: SparkSession, models: list[Trained]) -> DataFrame:
    """One row per model."""
    return spark.createDataFrame([m.result_row() for m in models], RESULT_SCHEMA)


def save_results(table: DataFrame, model_dir: str) -> None:
    table.write.mode("overwrite").json(f"{model_dir.rstrip('/')}/model_results")


def load_results(spark: SparkSession, model_dir: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(f"{model_dir.rstrip('/')}/model_results")


def save_models(models: list[Trained], model_dir: str) -> None:
    _save_models([m.model for m in models], model_dir)


def model_status(table: DataFrame) -> DataFrame:
    """Headline score per model with its bands and texts."""
    score = F.coalesce(F.nullif(F.col("accuracy"), F.lit(0.0)), F.col("r2"), F.lit(0.0))
    return table.select(
        "model", title_case(F.col("model")).alias("title"), score.alias("score"),
        percent(score, 0).alias("sidebar_text"), percent(score, 1).alias("card_text"),
        F.when(score > 0.82, "good").otherwise("weak").alias("sidebar_band"),
        F.when(score > 0.83, "success").when(score > 0.75, "warning").otherwise("danger").alias("card_band"),
        F.coalesce(F.concat(F.lit("AUC: "), fixed(F.nullif(F.col("roc_auc"), F.lit(0.0)), 3)), F.lit("Regressor")).alias("sub_text"))


def top_features(table: DataFrame) -> DataFrame:
    return table.where(F.col("model") == LATE).select(F.posexplode("top_features").alias("position", "f")).select(
        (F.col("position") + 1).alias("position"), "f.feature", "f.importance")

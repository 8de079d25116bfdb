"""Saved models: a folder for each version, and a manifest that names the current one.

A version is written in full before the manifest is swapped for one that names it, by a rename, so a reader sees the
old models or the new ones. A model is loaded once an application and version, and kept.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.ml.functions import vector_to_array

from lastleg import settings
from lastleg.functions.numeric import dbl
from lastleg.ml.boosting import Boosted
from lastleg.ml.prepare import CITY_CODE
from lastleg.session import on_release, path_exists

MANIFEST = "manifest.json"
_TREES = "tree int, feature array<int>, threshold array<double>, gain array<double>, value array<double>"
_loaded: dict[tuple[str, str, str, str], "Model"] = {}


class Model:
    """A fitted model with what it takes to score rows: features, the cities it knows, and whether it gives a probability.

    Several pipelines are the parts of one forest: it answers with the mean over all their trees.
    """

    def __init__(self, name: str, fitted: list[PipelineModel] | Boosted, features: list[str], cities: list[str], regressor: bool = False):
        self.name, self.fitted, self.features, self.cities, self.regressor = name, fitted, list(features), list(cities), regressor

    @property
    def inputs(self) -> list[str]:
        return [*self.features, CITY_CODE]

    def score(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows``, which have the city and all features as doubles, with the probability of class 1, or the predicted value, as ``out``."""
        if isinstance(self.fitted, Boosted):
            return rows.withColumn(out, self.fitted.probability(**{CITY_CODE: city_code(self.cities)}))
        value = F.col("prediction") if self.regressor else vector_to_array("probability")[1]
        scored, given = rows, [f"_part_{i}" for i in range(len(self.fitted))]
        for part, column in zip(self.fitted, given, strict=True):
            scored = part.transform(scored).select(*scored.columns, value.alias(column))
        if len(given) == 1:
            return scored.withColumnRenamed(given[0], out)
        total = sum((F.col(c) * F.lit(w) for c, w in zip(given, self._weights(), strict=True)), F.lit(0.0))
        return scored.select(*rows.columns, total.alias(out))

    def _weights(self) -> list[float]:
        """The share of each part in all trees."""
        trees = [part.stages[-1].getNumTrees for part in self.fitted]
        return [n / sum(trees) for n in trees]

    def importances(self) -> list[tuple[str, float]]:
        """All inputs, most important first."""
        if isinstance(self.fitted, Boosted):
            values = self.fitted.importances()
        else:
            values = sum(w * part.stages[-1].featureImportances.toArray() for w, part in zip(self._weights(), self.fitted, strict=True))
        return sorted(zip(self.inputs, map(float, values), strict=True), key=lambda p: (-p[1], p[0]))


def city_code(cities: list[str]):
    """The place of the city in the list, as a double; an unknown city is an error."""
    at = F.array_position(F.array(*[F.lit(c) for c in cities]), F.col("city"))
    unknown = F.raise_error(F.concat(F.lit("unseen city: "), F.coalesce("city", F.lit("none"))))
    return F.when(at > 0, (at - 1).cast("double")).otherwise(unknown.cast("double"))


def score_orders(orders: DataFrame, model: Model, out: str) -> DataFrame:
    """``orders`` with the model's score as ``out``: a missing city counts as the default one, a missing feature as 0."""
    inputs = orders.select(
        F.struct(*orders.columns).alias("_order"), F.coalesce("city", F.lit(settings.SCORING_DEFAULT_CITY)).alias("city"),
        *[(F.coalesce(dbl(c), F.lit(0.0)) if c in orders.columns else F.lit(0.0)).alias(c) for c in model.features],
    )
    return model.score(inputs, "_score").select("_order.*", F.col("_score").alias(out))


def save_models(models: list[Model], model_dir: str) -> str:
    """Write a new version with these models and the current one's others, and make it the current one. Returns its name."""
    spark = SparkSession.active()
    folder, version = model_dir.rstrip("/"), uuid.uuid4().hex
    entries = dict((_manifest(spark, folder) or {"models": {}})["models"])
    for m in models:
        path = f"versions/{version}/{m.name}"
        entry = {"path": path, "features": m.features, "cities": m.cities, "regressor": m.regressor}
        if isinstance(m.fitted, Boosted):
            entry.update(kind="boosted", base=m.fitted.base, depth=m.fitted.depth)
            rows = [
                (i, *(x.tolist() for x in arrays))
                for i, arrays in enumerate(zip(m.fitted.feature, m.fitted.threshold, m.fitted.gain, m.fitted.value, strict=True))
            ]
            spark.createDataFrame(rows, _TREES).coalesce(1).write.parquet(f"{folder}/{path}")
        else:
            entry.update(kind="pipeline", parts=len(m.fitted))
            for i, part in enumerate(m.fitted):
                part.write().save(f"{folder}/{path}/{i}")
        entries[m.name] = entry
    _swap(spark, folder, json.dumps({"version": version, "models": entries}, sort_keys=True))
    return version


def load_model(model_dir: str, name: str = "late_delivery") -> Model | None:
    """The current version of a saved model, or ``None`` when there is none."""
    spark = SparkSession.active()
    folder = model_dir.rstrip("/")
    entry = (_manifest(spark, folder) or {"models": {}})["models"].get(name)
    if entry is None:
        return None
    key = (spark.sparkContext.applicationId, folder, entry["path"], name)
    if key not in _loaded:
        path = f"{folder}/{entry['path']}"
        if entry["kind"] == "boosted":
            rows = spark.read.schema(_TREES).parquet(path).orderBy("tree").collect()
            arrays = [np.array([r[c] for r in rows]) for c in ("feature", "threshold", "gain", "value")]
            fitted = Boosted([*entry["features"], CITY_CODE], entry["base"], entry["depth"], *arrays)
        else:
            # models saved before there were parts have none
            fitted = [PipelineModel.load(f"{path}/{i}") for i in range(entry["parts"])] if "parts" in entry else [PipelineModel.load(path)]
        _loaded[key] = Model(name, fitted, entry["features"], entry["cities"], entry["regressor"])
    return _loaded[key]


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    path = f"{folder}/{MANIFEST}"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path_exists(spark, path) else None


def _swap(spark: SparkSession, folder: str, text: str) -> None:
    """Replace the manifest by a rename over the old one."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(folder).toUri(), spark._jsc.hadoopConfiguration())
    new, current = fs.Path(f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"), fs.Path(f"{folder}/{MANIFEST}")
    out = new.getFileSystem(spark._jsc.hadoopConfiguration()).create(new)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(new, current, options)


def _forget(application: str) -> None:
    for key in [k for k in _loaded if k[0] == application]:
        del _loaded[key]


on_release(_forget)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.session import stage


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the program's folder.

    It is enough where workers see that folder; elsewhere ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


TEXTS_A_BATCH = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage_texts(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for what Python makes of whole texts: these go to it in small batches, so long ones fit.

    The session's own batch size holds again afterwards.
    """
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_CONF)
    conf.set(_BATCH_CONF, str(TEXTS_A_BATCH))
    try:
        return stage(df, name)
    finally:
        conf.set(_BATCH_CONF, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes for ``df`` to have no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, per_bucket: int = 20_000) -> DataFrame:
    """``df`` with a gapless number from 0 in every group of ``keys``, as column ``out``.

    No group has to fit a task: rows are dealt by a hash of ``order`` to buckets of about
    ``per_bucket`` rows, numbered inside each bucket, and moved up by the rows of the buckets
    before it. ``order`` must name columns that decide a row's bucket and its place; rows equal
    in all of them get their numbers in any order. ``df`` should be a stored table: it is read
    twice.
    """
    rows = df.count()
    buckets = max(1, -(-rows // per_bucket))
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = salted.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    placed = salted.withColumn("__rank", F.row_number().over(inside) - 1)
    right = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), "__start")
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(right, same).select(*df.columns, (F.col("__start") + F.col("__rank")).cast("long").alias(out))


__all__ = ["find_package", "id_fold", "numbered", "stage", "stage_texts", "table", "unused"]

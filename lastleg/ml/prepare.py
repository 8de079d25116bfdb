"""Model inputs: encoded city, available features, imputed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lastleg import settings
from lastleg.functions.numeric import dbl
from lastleg.operators.joins import lookup_join
from lastleg.operators.selection import exact_quantile

CITY_CODE = "city_enc"


def available_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """The model features present in ``df``; ``exclude`` removes leaking ones."""
    return [c for c in settings.MODEL_FEATURES if c in df.columns and c not in exclude]


def distinct_cities(df: DataFrame) -> DataFrame:
    return df.select("city").where(F.col("city").isNotNull()).distinct().orderBy("city")


def city_codes(df: DataFrame) -> DataFrame:
    """Cities numbered from 0 in alphabetical order. The window covers distinct cities only."""
    cities = df.select("city").where(F.col("city").isNotNull()).distinct()
    return cities.select("city", (F.row_number().over(W.partitionBy().orderBy("city")) - 1).alias(CITY_CODE))


def encode_city(df: DataFrame) -> DataFrame:
    return lookup_join(df, city_codes(df), "city")


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row with the median, none without values; found by narrowing ranges, so any number of distinct values is fine."""
    return exact_quantile(df, column, 0.5)


def impute_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, nulls replaced by the exact median of their column.

    A first pass counts nulls, so medians are computed only where one is needed.
    """
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    return df.withColumns({
        c: F.coalesce(dbl(c), exact_median(df, c).scalar()) if counts[c] else dbl(c) for c in features
    })


def feature_rows(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``df`` with imputed double features; the city code is added by the model pipeline."""
    features = available_features(df, exclude)
    return impute_medians(df, features), features

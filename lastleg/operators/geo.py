"""Geographic grids and delivery zones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lastleg import settings
from lastleg.functions.numeric import dbl, exact_avg, np_round
from lastleg.session import find_package, stage

GRID_SCHEMA = "lat_bin double, lon_bin double, order_count bigint, late_rate double, avg_delivery_min double, avg_congestion double"
ZONE_SCHEMA = "cluster int, center_lat double, center_lon double, order_count bigint, late_rate double, avg_delivery_min double"


def geo_grid(orders: DataFrame, precision: int = 3, ordered: bool = True) -> DataFrame:
    """Orders per cell of a square grid of rounded coordinates, fullest cells first."""
    if "delivery_lat" not in orders.columns:
        return orders.sparkSession.createDataFrame([], GRID_SCHEMA)
    cells = (
        orders.na.drop("any", subset=["delivery_lat", "delivery_lon"])
        .groupBy(np_round("delivery_lat", precision).alias("lat_bin"), np_round("delivery_lon", precision).alias("lon_bin"))
        .agg(
            F.count("order_id").alias("order_count"),
            np_round(exact_avg("is_late"), 4).alias("late_rate"),
            np_round(exact_avg("actual_delivery_min"), 1).alias("avg_delivery_min"),
            exact_avg("congestion_factor").alias("avg_congestion"),
        )
    )
    return cells.orderBy(F.desc("order_count"), "lat_bin", "lon_bin") if ordered else cells


def nearest_centre(centres: list[tuple[float, float]]) -> Column:
    """Index of the nearest of a handful of centres, the first one on a tie."""
    lat, lon = dbl("delivery_lat"), dbl("delivery_lon")
    distances = F.array(*[
        F.struct(
            ((lat - F.lit(float(a))) * (lat - F.lit(float(a))) + (lon - F.lit(float(b))) * (lon - F.lit(float(b)))).alias("d"),
            F.lit(i).alias("cluster"))
        for i, (a, b) in enumerate(centres)
    ])
    return F.array_min(distances)["cluster"]


def zone_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(
        exact_avg("delivery_lat").alias("center_lat"),
        exact_avg("delivery_lon").alias("center_lon"),
        F.count("order_id").alias("order_count"),
        exact_avg("is_late").alias("late_rate"),
        exact_avg("actual_delivery_min").alias("avg_delivery_min"),
    )


def _located(orders: DataFrame) -> DataFrame:
    return orders.na.drop("any", subset=["delivery_lat", "delivery_lon"])


def assign_zones(orders: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """Summary of zones around given centres."""
    return zone_summary(_located(orders).withColumn("cluster", nearest_centre(centres)))


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k sample points, each drawn with a chance by its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < k:
        far = np.min([((sample - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def _sums_by_centre(centres: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each start and centre of a partition: sums of its nearest points' coordinates and squared distances, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((4, len(c))) for i, c in centres.items()}
        for batch in batches:
            lat, lon = (batch.column(i).to_numpy() for i in range(2))
            for i, c in centres.items():
                distances = (lat - c[:, :1]) ** 2 + (lon - c[:, 1:]) ** 2
                near = distances.argmin(axis=0)
                for line, weights in enumerate((lat, lon, distances.min(axis=0), None)):
                    sums[i][line] += np.bincount(near, weights, len(c))
        for i, (lat, lon, d, n) in sums.items():
            columns = [np.full(len(n), i, np.int32), np.arange(len(n), dtype=np.int32), lat, lon, d, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["start", "cluster", "lat", "lon", "d", "n"])
    return run


def fit_centres(
    orders: DataFrame, k: int = settings.ZONE_CLUSTERS, restarts: int = settings.ZONE_RESTARTS, seed: int = settings.ZONE_SEED,
    sample: int = 10_000, most_rounds: int = 20, tolerance: float = 1e-4,
) -> list[tuple[float, float]] | None:
    """K-means centres over all located orders: the best of several starts by the sum of squared distances.

    Every round moves the centres of all starts in one pass: a task adds up its points by nearest centre, a batch at a time, so what is
    shuffled is a row for each task, start and centre. Starts are drawn
    from at most ``sample`` points, those with the smallest hash. Only k centres a start reach the driver. ``None`` when there are fewer points than k.
    """
    find_package(orders.sparkSession)
    points = stage(_located(orders).select(dbl("delivery_lat").alias("delivery_lat"), dbl("delivery_lon").alias("delivery_lon")), "points")
    drawn = points.orderBy(F.xxhash64("delivery_lat", "delivery_lon")).limit(sample).collect()
    if len(drawn) < k:
        return None
    drawn = np.array(drawn, float)
    centres = [_first_centres(drawn, k, seed + i) for i in range(restarts)]
    cost, active = [float("inf")] * restarts, list(range(restarts))
    for _ in range(most_rounds):
        parts = points.mapInArrow(_sums_by_centre({i: centres[i] for i in active}), "start int, cluster int, lat double, lon double, d double, n double")
        sums = parts.groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("lat", "lon", "d", "n")]).where("n > 0")
        moved = {i: centres[i].copy() for i in active}
        spent = dict.fromkeys(active, 0.0)
        for r in sums.collect():
            moved[r["start"]][r["cluster"]] = (r["lat"] / r["n"], r["lon"] / r["n"])
            spent[r["start"]] += r["d"]
        for i in list(active):
            cost[i] = spent[i]
            if np.abs(moved[i] - centres[i]).max() < tolerance:
                active.remove(i)
            centres[i] = moved[i]
        if not active:
            break
    best = centres[int(np.argmin(cost))]
    return [(float(a), float(b)) for a, b in sorted(best.tolist())]


def delivery_zones(orders: DataFrame, k: int = settings.ZONE_CLUSTERS, restarts: int = settings.ZONE_RESTARTS) -> DataFrame:
    """K-means delivery zones with their order count, late rate and mean duration."""
    spark: SparkSession = orders.sparkSession
    if "delivery_lat" not in orders.columns:
        return spark.createDataFrame([], ZONE_SCHEMA)
    centres = fit_centres(orders, k, restarts)
    if centres is None:
        return spark.createDataFrame([], ZONE_SCHEMA)
    return assign_zones(orders, centres)

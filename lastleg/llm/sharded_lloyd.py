"""Centroid clustering by Lloyd's algorithm over dimension shards.

Vectors of whole numbers are cut into column blocks of ``width`` components and row chunks of ``chunk_rows`` vectors. A task
holds such pieces and the centroids' slice of their block only. In each round it computes the exact partial squared distances of its piece
to all slices; ``reduceByKey`` adds the partial distances of a chunk's blocks, of which the smallest per vector is its cluster
(ties to the smaller number); the assignments, two bytes a vector, go back to the pieces, and each block sums up its components by cluster
and gets its new slice, floor(sum / count), on its own. No task needs a whole vector or a whole centroid.

All arithmetic is exact: products run in double precision where they stay below 2^53, else in 64-bit integers. Partial distances
travel in the narrowest unsigned type that holds them. What reaches the driver is k centroids and k counts a round.

Pieces are stored once and kept on disk by the executors for the rounds; what an executor loses is read again from the stored table.

Defined cases: rows whose vector is null, of another length than ``dimensions``, or holds null or non-finite numbers take no part; zero
vectors do; every other row counts, also those that repeat an id; a row without id counts as one with an empty id in the
hash of the start, behind its ties; with fewer rows than ``k`` each is a start; equal starts stay as they are, and all but the first of them
end empty; an empty table gives no rows; components beyond 2^26 after scaling raise an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.session import stage

_LARGEST = 2**26  # squared differences of this size add up exactly over thousands of dimensions
_EXACT = 2**53
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the rows that take part, with components floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.size(v) == dimensions).filter(finite)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("v"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest hash of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(digest, F.col("id").isNull(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in chosen], np.int64)


def pieces(rows: DataFrame, width: int, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, block, data): the columns of a block of the vectors of a chunk; and (chunk, ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(lo, chunk_rows)
                x = np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1)
                if np.abs(x).max(initial=0) > _LARGEST:
                    raise OverflowError(f"components beyond {_LARGEST} after scaling")
                chunk = part.column(0)[0].as_py()
                slices = [np.ascontiguousarray(x[:, at: at + width], np.int32) for at in range(0, x.shape[1], width)]
                ids = [part.column(1).to_pylist()] + [None] * (len(slices) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(slices), pa.int64()), pa.array(range(len(slices)), pa.int32()), pa.array([s.tobytes() for s in slices]),
                     pa.array(ids, pa.list_(pa.int64()))], ["chunk", "block", "data", "ids"],
                )

    # a chunk is named by its first row
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v")
    made = stage(numbered.mapInArrow(cut, "chunk long, block int, data binary, ids array<long>"), "pieces")
    return made.select("chunk", "block", "data"), made.filter("block = 0").select("chunk", "ids")


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to centroid slices, in the narrowest unsigned type."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = float if 4 * top * top * x.shape[1] < _EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)
    return d.astype(np.min_scalar_type(int(d.max(initial=0))))


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a.astype(np.int64) + b
    return total.astype(np.min_scalar_type(int(total.max(initial=0))))


def _assigned(parts: RDD, slices: list[np.ndarray], width: int, tasks: int) -> RDD:
    """(chunk, (cluster of each vector, its squared distance)) for centroids given as slices by block."""

    def distances(piece):
        (chunk, block), data = piece
        return chunk, partial_distances(_matrix(data, slices[block].shape[1]), slices[block])

    def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = d.argmin(axis=1)
        return best.astype(np.min_scalar_type(d.shape[1])), d[np.arange(len(d)), best].astype(np.int64)

    return parts.map(distances).reduceByKey(_add, tasks).mapValues(nearest)


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, columns)


def _block_sums(parts: RDD, assigned: RDD, slices: list[np.ndarray], tasks: int) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """For each block its sums of components and its numbers of vectors, by cluster."""
    k, blocks = len(slices[0]), range(len(slices))

    def summed(pair):
        (_, block), (data, cluster) = pair
        x = _matrix(data, slices[block].shape[1])
        total = np.zeros((k, x.shape[1]), np.int64)
        np.add.at(total, cluster, x)
        return block, (total, np.bincount(cluster, minlength=k))

    # dealt like the pieces, so that only the assignments move
    back = assigned.flatMap(lambda r: [((r[0], b), r[1][0]) for b in blocks]).partitionBy(tasks)
    met = parts.join(back, tasks).map(summed)
    return met.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(slices)).collect()


def _updated(slices: list[np.ndarray], sums: list) -> list[np.ndarray]:
    new = list(slices)
    for block, (total, count) in sums:
        held = count > 0
        new[block] = slices[block].copy()
        new[block][held] = total[held] // count[held][:, None]
    return new


def cluster(vectors: DataFrame, dimensions: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, width: int = 16,
            chunk_rows: int = 2048) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row that takes part.

    ``distance`` is the squared distance to the row's final centroid, the inertias are its sums over the cluster and over all rows,
    and the hash is that of the final centroid's components as decimal numbers joined by commas.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, dimensions, scale), "whole_vectors")
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    cut, ids = pieces(rows, width, chunk_rows)
    tasks = max(cut.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    dealt = cut.rdd.map(lambda r: ((r["chunk"], r["block"]), bytes(r["data"]))).partitionBy(tasks).persist(StorageLevel.DISK_ONLY)
    slices = [centroids[:, at: at + width] for at in range(0, dimensions, width)]
    try:
        for _ in range(rounds):
            assigned = _assigned(dealt, slices, width, tasks).persist(StorageLevel.MEMORY_AND_DISK)
            slices = _updated(slices, _block_sums(dealt, assigned, slices, tasks))
            assigned.unpersist()
        last = _assigned(dealt, slices, width, tasks).map(lambda r: (r[0], r[1][0].tolist(), r[1][1].tolist()))
        found = stage(spark.createDataFrame(last, "chunk long, cluster array<int>, distance array<long>"), "assigned")
    finally:
        dealt.unpersist()
    whole = np.concatenate(slices, axis=1)
    hashes = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(whole)]
    final = spark.createDataFrame(hashes, "c int, centroid_sha256 string")
    each = found.join(ids, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("x")).select(
        F.col("x.ids").alias("vec_id"), "x.cluster", "x.distance",
    )
    flat = found.select(F.explode(F.arrays_zip("cluster", "distance")).alias("x")).groupBy("x.cluster").agg(F.sum("x.distance").alias("cluster_inertia"))
    sums = stage(flat, "inertia")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    known = sums.join(F.broadcast(final), F.col("cluster") == F.col("c")).select(
        "c", "cluster_inertia", total.scalar().alias("inertia"), "centroid_sha256",
    )
    # at most k rows
    return each.join(F.broadcast(known), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    )

"""Exact top-k by inner product with a pivot-distance index.

Every vector x gets one more component, sqrt(M^2 - |x|^2) for the largest norm M, and a query a zero. All
vectors then have length M, and the largest inner product is the smallest distance. Pivots are
chosen farthest-first from a bounded sample (``sample`` rows by smallest hash of the id). Each vector is keyed by its
nearest pivot and its distance r to it; a pivot's vectors form rings between quantiles of r. The
directory has at most ``pivots * most_rings`` annuli with their true inner and outer radius.

For a query at distance d from a pivot, no vector of an annulus is nearer than max(0, d - outer, inner - d).
Annuli are expanded in order of this bound: first those with ``first_rows`` rows in all, which gives a k-th best
score, then the rest up to the first whose bound exceeds the distance of that score. The result is exact; how many annuli are left out depends on
the data (for directions spread evenly in many dimensions, few). An annulus with many rows is dealt to chunks, so that neither it nor the
queries that need it have to fit a task.

Defined cases: vectors that are null, empty or hold null or non-finite numbers take no part, nor do
rows without id; all others do, zero vectors, repeated ids and lengths of their own too (vectors meet those of their length); fewer candidates than k give
fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm import topk
from lastleg.session import stage


class Directory:
    """Pivots and the annuli around them."""

    def __init__(self, pivots: np.ndarray, top: float, edges: np.ndarray):
        self.top = top  # M^2
        self.pivots, self.edges = pivots, edges
        self.lift = np.sqrt(np.maximum(0, top - (pivots**2).sum(axis=1)))
        self.annuli = np.zeros((0, 5))  # pivot, ring, inner, outer, rows

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, ring and distance of each vector."""
        lift = np.sqrt(np.maximum(0, self.top - (x**2).sum(axis=1)))
        squared = np.maximum(0, 2 * self.top - 2 * (x @ self.pivots.T + lift[:, None] * self.lift[None, :]))
        nearest = squared.argmin(axis=1)
        r = np.sqrt(squared[np.arange(len(x)), nearest])
        return nearest, np.searchsorted(self.edges, r, side="right"), r

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The smallest possible distance of each query to the vectors of each annulus."""
        d = np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + self.top - 2 * q @ self.pivots.T))[:, self.annuli[:, 0].astype(int)]
        return np.maximum(0, np.maximum(d - self.annuli[:, 3], self.annuli[:, 2] - d))


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int | None = 1024, pivots: int = 32, sample: int = 4096,
           ring_rows: int = 2048, most_rings: int = 256, chunk_rows: int = 4096, first_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products.

    ``is_query`` is a condition on ``id``. With ``scale`` components become floor(scale * x).
    """
    rows = topk.usable(vectors, zero_too=True)
    options = (k, scale, pivots, sample, ring_rows, most_rings, chunk_rows, first_rows)
    found = [_search(rows.filter(F.size("v") == d), is_query, *options) for d in topk.lengths(rows)]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search(rows: DataFrame, is_query: Column, k: int, scale: int | None, pivots: int, sample: int, ring_rows: int, most_rings: int, chunk_rows: int,
            first_rows: int) -> DataFrame:
    """``search`` over vectors of one length."""
    spark = rows.sparkSession
    n = rows.count()
    if scale is not None:
        rows = rows.select("id", "key", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = rows.agg(F.max(norm)).first()[0] or 0.0
    taken = rows.orderBy(F.xxhash64("id"), "id", "key").limit(sample).collect()
    if not taken:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r["v"] for r in taken])
    directory = Directory(farthest_first(x, pivots), top, np.zeros(0))
    rings = max(1, min(most_rings, round(n / (len(directory.pivots) * ring_rows))))
    directory.edges = np.quantile(directory.keys(x)[2], np.arange(1, rings) / rings) if rings > 1 else np.zeros(0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            pivot, ring, r = directory.keys(values)
            arrays = [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(r)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "v", "pivot", "ring", "r"])

    keyed = stage(rows.mapInArrow(key, "id long, key long, v array<double>, pivot int, ring int, r double"), "keyed")
    table = keyed.groupBy("pivot", "ring").agg(F.min("r"), F.max("r"), F.count("*")).orderBy("pivot", "ring").collect()
    directory.annuli = np.array([tuple(r) for r in table], float)
    chunks = -(-directory.annuli[:, 4].astype(np.int64) // chunk_rows)
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    cells = spark.createDataFrame(
        [(int(t[0]), int(t[1]), int(s), int(c)) for t, s, c in zip(table, starts, chunks, strict=True)], "p int, g int, start long, chunks long",
    )
    at = (F.col("pivot") == F.col("p")) & (F.col("ring") == F.col("g"))
    placed = stage(
        keyed.join(F.broadcast(cells), at).select((F.col("start") + topk.chunk_of(F.col("chunks"))).alias("cell"), "id", "key", "v"), "cells",
    )
    queries = keyed.filter(is_query).select("id", "key", "v", F.lit(float("-inf")).alias("tau"))
    shared = spark.sparkContext.broadcast((directory, starts, chunks))
    found = stage(topk.scan(placed, _visits(queries, shared, first_rows, first=True), k), "first_annuli")
    later = queries.drop("tau").join(topk.kth_scores(found, k), (F.col("id") == F.col("q")) & (F.col("key") == F.col("qk")), "left").select(
        "id", "key", "v", F.coalesce("tau", F.lit(float("-inf"))).alias("tau"),
    )
    rest = topk.scan(placed, _visits(later, shared, first_rows, first=False), k)
    return topk.best(found.unionByName(rest), k).drop("query_key")


def _visits(queries: DataFrame, shared, first_rows: int, first: bool) -> DataFrame:
    """(cell, id, v, tau): the cells of the first annuli of each query, or of the others its k-th score doesn't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, starts, chunks = shared.value
        rows = directory.annuli[:, 4]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                q = np.asarray(part.column(2).flatten()).reshape(part.num_rows, -1)
                tau = np.asarray(part.column(3))
                bounds = directory.bounds(q)
                order = np.argsort(bounds, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                visit = before < first_rows
                if not first:
                    nearest = np.sqrt(np.maximum(0, (q**2).sum(axis=1) + directory.top - 2 * tau)) if len(tau) else tau
                    limit = nearest * (1 + 1e-9) + 1e-6
                    visit = ~visit & (np.take_along_axis(bounds, order, axis=1) <= limit[:, None])
                i, j = np.nonzero(visit)
                annulus = order[i, j]
                i = np.repeat(i, chunks[annulus])
                inside = np.concatenate([np.arange(c) for c in chunks[annulus]]) if len(annulus) else np.zeros(0, np.int64)
                cell = np.repeat(starts[annulus], chunks[annulus]) + inside
                for at in range(0, len(cell), 4096):
                    take = pa.array(i[at: at + 4096])
                    arrays = [pa.array(cell[at: at + 4096].astype(np.int64)), *(part.column(c).take(take) for c in range(4))]
                    yield pa.RecordBatch.from_arrays(arrays, ["cell", "id", "key", "v", "tau"])

    return queries.select("id", "key", "v", "tau").mapInArrow(run, "cell long, id long, key long, v array<double>, tau double")

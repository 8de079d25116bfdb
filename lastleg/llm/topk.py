"""Scoring of queries against blocks of vectors, shared by the two vector searches.

Rows and queries carry the cell they meet in. A task holds the vectors of one cell, which its
caller keeps bounded, and streams the cell's queries past them batch by batch, so any number of queries can meet a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.session import stage

_EXACT = 2.0**53
_STREAM = 512  # queries scored at once
MOST_LENGTHS = 64
FOUND = "query_id long, query_key long, vec_id long, key long, score double"


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(id, key, v): rows with an id and a vector of finite numbers. Each row counts: ``key`` tells those of one id apart.

    Without ``zero_too``, zero vectors take no part.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0),
    ).filter(finite)
    if not zero_too:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return stage(rows.select("id", F.monotonically_increasing_id().alias("key"), "v"), "vectors")


def lengths(rows: DataFrame) -> list[int]:
    """The vector lengths there are, at most ``MOST_LENGTHS``: a search runs over each, as vectors of unlike length have no product."""
    found = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").limit(MOST_LENGTHS + 1).collect()]
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return found


def chunk_of(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("id", "key"), chunks)


def scan(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, query_key, vec_id, key, score): for each query and cell the k best rows with score >= tau.

    ``rows`` are (cell, id, key, v), ``queries`` are (cell, id, key, v, tau); ``key`` tells rows of one id apart. A query's own row is left out. Products of whole numbers are exact;
    others are summed anew in one order for the best rows, so equal vectors have equal scores.
    """
    both = rows.select("cell", F.lit(0).alias("kind"), "id", "key", "v", F.lit(0.0).alias("tau")).unionByName(
        queries.select("cell", F.lit(1).alias("kind"), "id", "key", "v", "tau"),
    )
    dealt = both.repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, keys, matrix, parts = None, None, None, None, []
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in (0, 1, 2, 3, 5)]
            lists = batch.column(4)
            values = np.asarray(lists.flatten()).reshape(len(columns[0]), -1)
            edges = np.nonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0))[0] + 1
            bounds = [0, *edges.tolist(), len(columns[0])]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                if columns[0][lo] != cell:
                    cell, ids, keys, matrix, parts = columns[0][lo], None, None, None, []
                if columns[1][lo] == 0:
                    parts.append((columns[2][lo:hi], columns[3][lo:hi], values[lo:hi]))
                    continue
                if parts:
                    (ids, keys, matrix), parts = (np.concatenate([p[i] for p in parts]) for i in range(3)), []
                if ids is None:
                    continue
                for at in range(lo, hi, _STREAM):
                    end = min(at + _STREAM, hi)
                    yield _best_in_cell(ids, keys, matrix, columns[2][at:end], columns[3][at:end], values[at:end], columns[4][at:end], k)

    return dealt.mapInArrow(run, FOUND)


def _best_in_cell(ids, keys, matrix, query_ids, query_keys, queries, tau, k) -> pa.RecordBatch:
    scores = queries @ matrix.T
    exact = bool(np.all(matrix == np.floor(matrix)) and np.all(queries == np.floor(queries)))
    if exact and np.abs(matrix).max(initial=0) * np.abs(queries).max(initial=0) * matrix.shape[1] >= _EXACT:
        raise OverflowError("whole-number vectors too large for exact products in double precision")
    scores[(query_ids[:, None] == ids[None, :]) & (query_keys[:, None] == keys[None, :])] = -np.inf
    slack = 0.0 if exact else 1e-9 * (1 + np.abs(scores[np.isfinite(scores)]).max(initial=0))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []  # number of the query, rows, scores
    floor = tau - slack
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k] - slack)
    for i in np.nonzero(scores.max(axis=1) >= floor)[0]:
        at = np.nonzero((scores[i] >= floor[i]) & (scores[i] > -np.inf))[0]
        s = scores[i, at] if exact else (matrix[at] * queries[i]).sum(axis=1)
        order = np.lexsort((keys[at], ids[at], -s))[:k]
        out.append((int(i), at[order], s[order]))
    q = np.concatenate([np.full(len(a), i, np.int64) for i, a, _ in out]) if out else np.zeros(0, np.int64)
    v = np.concatenate([a for _, a, _ in out]) if out else np.zeros(0, np.int64)
    s = np.concatenate([x for _, _, x in out]) if out else np.zeros(0)
    arrays = [query_ids[q], query_keys[q], ids[v], keys[v], s]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["query_id", "query_key", "vec_id", "key", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row with their rank, ties to the smaller vec_id; repeated finds count once."""
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "query_key", "rank", "vec_id", "score")


def kth_scores(found: DataFrame, k: int) -> DataFrame:
    """(q, qk, tau): the score of each query's k-th best so far; queries with fewer are left out."""
    return best(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("query_key").alias("qk"), F.col("score").alias("tau"))

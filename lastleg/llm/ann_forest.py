"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Every vector gets one more component, sqrt(M^2 - |x|^2) for the largest norm M, and a query a
zero, so the largest product is the smallest angle. A tree splits at hyperplanes between two random sample rows, at the
median of the sample, until a node stands for ``leaf_rows`` rows of the table. The trees are fitted on a bounded
sample (``sample`` rows by smallest hash of the id); every row is put into a leaf of every tree.

A query searches all trees through one priority queue: the node whose worst margin on the way down is best is opened next, whichever
tree it is in, until the opened leaves hold ``share`` of the table's rows, counted with repeats. All rows of these leaves are reranked by exact
products in double precision. ``share`` is found on the sample itself: the smallest at which ``tuning`` sample rows, searched for k * sample
/ rows neighbours (``k`` at most, 5 at least), reach ``target_recall`` against brute force. Data with structure needs a small
share, directions spread evenly in many dimensions a large one.

A leaf with many rows, as of equal vectors, is dealt to chunks, so that neither it nor its queries have to fit a task.
The leaves with ``first_rows`` rows are reranked first; of the others only rows that reach the k-th score so far are passed on.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
rows without id; other rows all do, also those that repeat an id, and vectors of another length meet those of their length; fewer candidates than k give
fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm import topk
from lastleg.session import stage


class Tree:
    """Inner nodes as arrays; children below zero are leaves, leaf i as -1 - i."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal: list[np.ndarray] = []
        self.cut: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.normal = np.array(self.normal).reshape(-1, x.shape[1])

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        for _ in range(8 if len(at) > leaf else 0):
            a, b = x[rng.choice(at, 2, replace=False)]
            size = np.linalg.norm(a - b)
            if size == 0:
                continue
            normal = (a - b) / size
            side = x[at] @ normal
            cut = float(np.median(side))
            left = side <= cut
            if left.all() or not left.any():
                continue
            node = len(self.cut)
            self.normal.append(normal)
            self.cut.append(cut)
            self.child.append([0, 0])
            self.child[node] = [self._grow(x, at[left], leaf, rng), self._grow(x, at[~left], leaf, rng)]
            return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        children, cuts = np.array(self.child).reshape(-1, 2), np.array(self.cut)
        while (inner := np.nonzero(node >= 0)[0]).size:
            n = node[inner]
            right = (x[inner] * self.normal[n]).sum(axis=1) > cuts[n]
            node[inner] = children[n, right.astype(int)]
        return -1 - node


class Forest:
    def __init__(self, trees: list[Tree], top: float):
        self.trees, self.top = trees, top
        self.first = np.concatenate([[0], np.cumsum([t.leaves for t in trees])])  # leaves are numbered through all trees
        self.rows = np.zeros(self.first[-1], np.int64)
        self.normals = np.concatenate([t.normal for t in trees])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.top - (x**2).sum(axis=1)))])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        lifted = self.lifted(x)
        return np.column_stack([t.leaf_of(lifted) + at for t, at in zip(self.trees, self.first, strict=False)])

    def search(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of the shared queue."""
        size = np.linalg.norm(q) or 1.0
        margins = self.normals[:, :-1] @ (q / size)
        offset = np.cumsum([0, *[len(t.cut) for t in self.trees]])
        # a direction has no length: cuts are compared with the query drawn out to the length of all rows
        reach = np.sqrt(self.top)
        queue = [(-np.inf, t, tree.root) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        while queue:
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                yield int(self.first[t] - 1 - node)
                continue
            tree = self.trees[t]
            side = margins[offset[t] + node] * reach - tree.cut[node]
            left, right = tree.child[node]
            heapq.heappush(queue, (max(worst, side), t, left))
            heapq.heappush(queue, (max(worst, -side), t, right))


def _share(forest: Forest, x: np.ndarray, k: int, target: float, tuning: int) -> float:
    """Rows to open, as a share of the table, for the target recall among the sample rows ``x``."""
    where = forest.leaves_of(x)
    held = np.bincount(where.ravel(), minlength=int(forest.first[-1]))
    needed = []
    for i in range(min(tuning, len(x))):
        scores = x @ x[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, min(k, len(x) - 1))[:k]
        opened = np.full(int(forest.first[-1]), np.inf)
        total = 0
        for leaf in forest.search(x[i]):
            total += held[leaf]
            opened[leaf] = total
        needed.append(opened[where[near]].min(axis=1))
    return float(np.quantile(np.concatenate(needed), target)) / len(x) if needed else 1.0


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 8, leaf_rows: int = 1024, sample: int = 16_384,
           target_recall: float = 0.95, tuning: int = 128, chunk_rows: int = 4096, first_rows: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that meets ``is_query``, a condition on ``id``."""
    rows = topk.usable(vectors, zero_too=False)
    options = (k, trees, leaf_rows, sample, target_recall, tuning, chunk_rows, first_rows, seed)
    found = [_search(rows.filter(F.size("v") == d), is_query, *options) for d in topk.lengths(rows)]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search(rows: DataFrame, is_query: Column, k: int, trees: int, leaf_rows: int, sample: int, target_recall: float, tuning: int, chunk_rows: int,
            first_rows: int, seed: int) -> DataFrame:
    """``search`` over vectors of one length."""
    spark = rows.sparkSession
    n = rows.count()
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = rows.agg(F.max(norm)).first()[0]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "key").limit(sample).collect()])
    rng = np.random.default_rng(seed)
    lifted = np.column_stack([x, np.sqrt(np.maximum(0, top - (x**2).sum(axis=1)))])
    leaf = max(8, leaf_rows * len(x) // n)
    forest = Forest([Tree(lifted, leaf, rng) for _ in range(trees)], top)
    near = max(5, min(k, round(k * len(x) / n)))
    budget = _share(forest, x, near, target_recall, tuning) * n
    leaf_type = "array<int>"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            leaves = forest.leaves_of(values).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int32()))], ["id", "key", "v", "leaves"])

    keyed = stage(rows.mapInArrow(put, f"id long, key long, v array<double>, leaves {leaf_type}"), "leaves")
    spread = keyed.select("id", "key", "v", F.explode("leaves").alias("leaf"))
    for r in spread.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        forest.rows[r["leaf"]] = r["n"]
    chunks = np.maximum(1, -(-forest.rows // chunk_rows))
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    cells = spark.createDataFrame([(i, int(s), int(c)) for i, (s, c) in enumerate(zip(starts, chunks, strict=True))], "l int, start long, chunks long")
    placed = stage(
        spread.join(F.broadcast(cells), F.col("leaf") == F.col("l"))
        .select((F.col("start") + topk.chunk_of(F.col("chunks"))).alias("cell"), "id", "key", "v"), "cells",
    )
    queries = keyed.filter(is_query).select("id", "key", "v", F.lit(float("-inf")).alias("tau"))
    shared = spark.sparkContext.broadcast((forest, starts, chunks))
    found = stage(topk.scan(placed, _visits(queries, shared, budget, first_rows, first=True), k), "first_leaves")
    later = queries.drop("tau").join(topk.kth_scores(found, k), (F.col("id") == F.col("q")) & (F.col("key") == F.col("qk")), "left").select(
        "id", "key", "v", F.coalesce("tau", F.lit(float("-inf"))).alias("tau"),
    )
    rest = topk.scan(placed, _visits(later, shared, budget, first_rows, first=False), k)
    return topk.best(found.unionByName(rest), k).drop("query_key")


def _visits(queries: DataFrame, shared, budget: float, first_rows: int, first: bool) -> DataFrame:
    """(cell, id, v, tau): the cells of the leaves a query opens; the first of them, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, starts, chunks = shared.value
        for batch in batches:
            values = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            at: list[int] = []
            cell: list[int] = []
            for i, q in enumerate(values):
                total = 0
                for leaf in forest.search(q):
                    if total >= budget or first and total >= first_rows:
                        break
                    if first or total >= first_rows:
                        cell += range(starts[leaf], starts[leaf] + chunks[leaf])
                        at += [i] * int(chunks[leaf])
                    total += forest.rows[leaf]
            for lo in range(0, len(cell), 4096):
                take = pa.array(at[lo: lo + 4096])
                arrays = [pa.array(cell[lo: lo + 4096], pa.int64()), *(batch.column(c).take(take) for c in range(4))]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "id", "key", "v", "tau"])

    return queries.select("id", "key", "v", "tau").mapInArrow(run, "cell long, id long, key long, v array<double>, tau double")

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.llm import ann_forest, pivot_index
from lastleg.llm.queries import QUERIES


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, cell string")


def exact(rows, queries, k):
    out = {}
    for q in queries:
        scored = sorted(((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


@pytest.fixture(scope="module")
def clustered():
    """Clusters, one common vector, ties, vectors of different lengths."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = {i: ((centres[i % 12] + 0.3 * rng.normal(size=16)) * (1 + i % 3)).astype(np.float32).astype(float) for i in range(3000)}
    for i in range(0, 3000, 3):
        rows[i] = rows[0]
    return rows


def test_exact_search_on_clusters(spark, clustered):
    scaled = {i: np.floor(1024 * v) for i, v in clustered.items()}
    got = found(pivot_index.search(vectors(spark, [(i, v.tolist()) for i, v in clustered.items()]), F.col("id") % 100 == 0, 10, ring_rows=64, chunk_rows=200, first_rows=64))
    assert got == exact(scaled, [i for i in clustered if i % 100 == 0], 10)


def test_annuli_are_left_out(spark, clustered):
    """Bounds of far annuli exceed the distance of the k-th neighbour, and never that of a true one."""
    x = np.array([clustered[i] for i in range(3000) if i % 3])
    directory = pivot_index.Directory(pivot_index.farthest_first(x[:500], 12), float((x**2).sum(axis=1).max()), np.zeros(0))
    directory.edges = np.quantile(directory.keys(x)[2], [0.25, 0.5, 0.75])
    pivot, ring, r = directory.keys(x)
    annuli = sorted({(p, g) for p, g in zip(pivot, ring, strict=True)})
    inside = [(pivot == p) & (ring == g) for p, g in annuli]
    directory.annuli = np.array([(p, g, r[m].min(), r[m].max(), m.sum()) for (p, g), m in zip(annuli, inside, strict=True)])
    lift = np.sqrt(directory.top - (x**2).sum(axis=1))
    skipped = 0
    for q in x[::97]:
        bounds = directory.bounds(q[None])[0]
        distance = np.sqrt(((x - q) ** 2).sum(axis=1) + lift**2)
        for bound, m in zip(bounds, inside, strict=True):
            assert bound <= distance[m].min() + 1e-9
        skipped += (bounds > np.sort(distance)[10]).sum()
    assert skipped > 0


def test_forest_on_clusters(spark, clustered):
    got = found(ann_forest.search(vectors(spark, [(i, v.tolist()) for i, v in clustered.items()]), F.col("id") % 50 == 0, 20, leaf_rows=100, sample=1000, chunk_rows=150, first_rows=200))
    want = exact(clustered, [i for i in clustered if i % 50 == 0], 20)
    reached = []
    for q, near in want.items():
        floor = near[-1][1] - 1e-9
        reached.append(sum(s >= floor for _, s in got[q]) / 20)
        assert all(abs(s - float(np.dot(clustered[q], clustered[i]))) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert np.mean(reached) >= 0.9


def test_forest_recall_on_the_given_vectors(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = found(QUERIES["op4_ann"](spark, DATA))
    want = exact(rows, [i for i in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


ODD = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
       (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, -2.0]), (1, [2.0, 1.0])]


def brute(rows, is_query, k, zero_too):
    """(query_id, rank, vec_id, score) by comparing every row with every other of its length."""
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero_too or any(v))]
    out = []
    for at, (q, x) in enumerate(use):
        if is_query(q):
            scored = sorted((-float(x @ v), i) for n, (i, v) in enumerate(use) if n != at and len(v) == len(x))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_repeated_ids_and_lengths_all_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60, rng.integers(-3, 4, 2 if i % 4 else 3).astype(float).tolist()) for i in range(200)] + [(1, [0.5, 0.0]), (1, [2.0, 0.0]), (0, [1.0, 0.0])]
    got = pivot_index.search(vectors(spark, rows), F.col("id") % 20 == 0, 7, scale=None)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 7, True)
    near = ann_forest.search(vectors(spark, rows), F.col("id") % 20 == 0, 7, target_recall=1.0)
    assert sorted(map(tuple, near.collect())) == brute(rows, lambda i: i % 20 == 0, 7, False)


def test_odd_vectors(spark):
    got = found(pivot_index.search(vectors(spark, ODD), F.col("id") % 100 == 0, 3, scale=None))
    assert got == {0: [(1, 4.0), (1, 4.0), (2, 4.0)], 100: [(0, 0.0), (1, 0.0), (1, 0.0)]}
    near = found(ann_forest.search(vectors(spark, ODD), F.col("id") % 20 == 0, 20))
    assert near == {0: [(1, 4.0), (1, 4.0), (2, 4.0), (9, -5.0)]}
    for rows in ([], [(0, None)], [(0, [1.0])]):
        assert found(pivot_index.search(vectors(spark, rows), F.col("id") % 100 == 0)) == {}
        assert found(ann_forest.search(vectors(spark, rows), F.col("id") % 20 == 0)) == {}


def test_too_large_whole_numbers_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        pivot_index.search(vectors(spark, [(0, [1e14, 1.0]), (1, [1e14, 2.0])]), F.col("id") % 100 == 0).collect()

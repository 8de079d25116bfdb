import hashlib
import math

import numpy as np
import pytest

from lastleg.llm import sharded_lloyd

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, chunk int, ids string"


def slow(rows, dimensions, k, rounds, scale, seed):
    """Plain Lloyd in whole numbers over rows (vec_id, vector)."""
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, held) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    inertia = sum(d for d, _ in last)
    return [
        (i, c, d, sum(e for e, o in last if o == c), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, last)
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "z", 1, "z") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("width,chunk_rows", [(16, 2048), (5, 7), (64, 3)])
def test_equals_plain_lloyd(spark, width, chunk_rows):
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(120)]
    # ties, repeated rows and ids, zero and odd vectors
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[9][1]), (None, [0.0] * 12), (200, [0.0] * 12), (201, None), (202, [1.0] * 11),
             (203, [float("nan")] + [1.0] * 11), (204, [None] + [1.0] * 11), (205, [float("inf")] + [0.0] * 11), (206, [])]
    rows += [(300 + i, [1.0 if j == i % 2 else -1.0 for j in range(12)]) for i in range(40)]
    got = sharded_lloyd.cluster(table(spark, rows), dimensions=12, k=9, rounds=4, scale=16, seed=2, width=width, chunk_rows=chunk_rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, slow(rows, 12, 9, 4, 16, 2)))


def test_few_rows_equal_starts_and_none(spark):
    same = [(i, [1.5, -2.0]) for i in range(5)]
    got = sharded_lloyd.cluster(table(spark, same), dimensions=2, k=40, rounds=5)
    assert sorted(map(tuple, got.collect())) == sorted(slow(same, 2, 40, 5, 256, 2))
    assert sharded_lloyd.cluster(table(spark, []), dimensions=2).count() == 0


def test_large_whole_numbers_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-2**26, 2**26, (50, 16)).astype(np.int32)
    c = rng.integers(-2**26, 2**26, (7, 16))
    want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    assert sharded_lloyd.partial_distances(x, c).tolist() == want


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        sharded_lloyd.cluster(table(spark, [(1, [1e12, 0.0])]), dimensions=2).count()

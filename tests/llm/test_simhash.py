import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.llm import simhash
from lastleg.llm.common import stage
from lastleg.llm.graph import connected_components
from lastleg.llm.queries import QUERIES


def slow_fingerprint(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + k]) for i in range(max(1, len(found) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b\tC", "ÀB àb Ab AB ab", "x y z w " * 9, "\x1cone\x85two three four five"])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text, 4) == slow_fingerprint(text, 4)


def test_every_pair_within_the_radius_meets():
    rng = random.Random(1)
    for radius, level in ((4, 0), (4, 1), (2, 0), (6, 0), (6, 1)):
        masks = simhash.covering_masks(radius, level)
        assert len(masks) == 2 ** (radius + 1) - 1
        assert all(20 <= (m % 2**64).bit_count() <= 44 for m in masks)
        for _ in range(2000):
            changed = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(changed & m == 0 for m in masks)


@pytest.mark.parametrize("max_bucket", [2048, 40])
def test_edges_connect_what_brute_force_connects(spark, max_bucket):
    """A dense cluster, so small buckets are split again."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    signed = [int(np.array(f, "<u8").view("<i8")) for f in fps]
    nodes = stage(spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long"), "test_nodes")
    edges = simhash.covering_edges(nodes, 4, max_bucket)
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = slow_components(range(len(fps)), pairs)
    assert {i: got.get(i, i) for i in want} == want
    assert edges.filter(F.col("a") == F.col("b")).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1, 60)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "x long, y long"), "x", "y").collect()}
    edges = [(a, b) for a, b in path if a is not None and a != b]
    assert got == slow_components({n for e in edges for n in e}, edges)


def test_query_equals_brute_force(spark):
    rows = QUERIES["op1_simhash"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t, 4) for i, t in texts.items()}
    ids = sorted(texts)
    pairs = [(a, b) for a in ids for b in ids if b < a and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = slow_components(ids, pairs)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(rows) == len(ids)


def test_odd_documents(odd_docs, no_docs):
    groups = simhash.near_groups(odd_docs, 4, 4).collect()
    assert len(groups) == odd_docs.count()
    of = {}
    for r in groups:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert of[1] == of[2] == of[3] == {1} and of[8] == of[9] == {8}
    assert of[4] == of[5] == of[6] == {4}
    assert of[None] == {None, 4}  # a null id with a null text shares fingerprint 0, the other stands alone
    assert simhash.near_groups(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 0, 1, 4, 7, 7, 7, 8, 10]
    assert simhash.keep_one(no_docs).count() == 0

import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.llm import sharding
from lastleg.llm.queries import QUERIES
from llm.conftest import words


def check_slots(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    rows = QUERIES["op9_sharding"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert len(rows) == len(texts) and {r["shard"] for r in rows} <= set(range(24))
    check_slots(rows)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 24
    # equal but for what the largest groups force: none outgrows a mean shard by more than the longest text
    assert max(sums.values()) <= sum(sums.values()) / 24 + max(r["size"] for r in rows)
    together = {}
    for r in rows:
        together.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in together.values())


def signed(data):
    n = xxhash.xxh64_intdigest(data, seed=42)
    return n - (1 << 64) if n >= 1 << 63 else n


def slow_place(docs, shards, bundles):
    """The shard of each doc_id, by loops over single groups."""
    vector = lambda rows: [sum(len(t.encode()) + 8 for _, t in rows), sum(len(t.split()) for _, t in rows), len(rows)]
    share = [n / shards for n in vector(docs)]
    by_text, items = {}, {}
    for d, t in docs:
        by_text.setdefault(t, []).append((d, t))
    for t, rows in by_text.items():
        g, taken = signed(t.encode()), max(v / s for v, s in zip(vector(rows), share, strict=True))
        for d, _ in rows:
            if taken <= 1 / 200:
                name = f"b{g % bundles}"
            else:
                parts = math.ceil(8 * taken) if taken > 1 else 1
                name = f"{g}:{signed(d.to_bytes(8, 'little')) % parts}"
            items.setdefault(name, []).append((d, t))
    shares = {n: [v / s for v, s in zip(vector(rows), share, strict=True)] for n, rows in items.items()}
    residual, where = [[1.0] * 3 for _ in range(shards)], {}
    for name in sorted(sorted(items), key=lambda n: -max(shares[n])):
        item = shares[name]
        dot = [sum(r * x for r, x in zip(left, item, strict=True)) for left in residual]
        fits = [all(r >= x - 1e-12 for r, x in zip(left, item, strict=True)) for left in residual]
        best = max(range(shards), key=lambda s: (fits[s] or not any(fits), round(dot[s], 12), -s))
        residual[best] = [r - x for r, x in zip(residual[best], item, strict=True)]
        where.update((d, best) for d, _ in items[name])
    return where


def test_equals_brute_force(make_docs):
    import random
    rng = random.Random(9)
    own = [words(rng.randint(1, 300), 400 * i) for i in range(260)] + [words(2, 5 * i) for i in range(900)]
    docs = [(i, own[0] if i % 5 == 0 else own[1] if i % 11 == 0 else own[i % len(own)]) for i in range(1600)]
    got = {r["doc_id"]: r["shard"] for r in sharding.place(make_docs([(i, t, None, None) for i, t in docs]), shards=5, bundles=50).collect()}
    assert got == slow_place(docs, 5, 50)


def test_measures_are_balanced_and_equal_texts_stay_together(make_docs):
    import random
    rng = random.Random(2)
    own = [words(rng.randint(1, 60), 70 * i) for i in range(1500)]
    docs = [(i, rng.choice(own[:50]) if i % 5 == 0 else own[i % 1500], None, None) for i in range(4000)]
    rows = sharding.place(make_docs(docs), shards=6, bundles=600).collect()
    text = dict((d[0], d[1]) for d in docs)
    for measure in (lambda r: r["size"], lambda r: r["tokens"], lambda r: 1):
        sums = Counter()
        for r in rows:
            sums[r["shard"]] += measure(r)
        assert max(sums.values()) < 1.04 * min(sums.values())
    together = {}
    for r in rows:
        together.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    check_slots(rows)


def test_only_a_group_above_a_shard_is_split(make_docs):
    docs = [(i, "the same text" if i % 3 == 0 else words(3, 3 * i), None, None) for i in range(3000)]
    rows = sharding.place(make_docs(docs), shards=8).collect()
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) < 1.1 * min(sums.values())
    assert len({r["shard"] for r in rows if r["doc_id"] % 3 == 0}) > 2
    # 0.8 of a shard by rows, less by bytes
    docs = [(i, "the same text" if i % 10 == 0 else words(3, 3 * i), None, None) for i in range(3000)]
    rows = sharding.place(make_docs(docs), shards=8).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] % 10 == 0}) == 1
    sums = Counter(r["shard"] for r in rows)
    assert max(sums.values()) < 1.1 * min(sums.values())


def test_highest_dot_product_wins():
    # the third item has more to gain where the second measure is free, the fourth fits only there
    items = np.array([[0.6, 0.1, 0.1], [0.1, 0.5, 0.1], [0.45, 0.1, 0.1], [0.1, 0.44, 0.1]])
    assert sharding.best_shards(items, 2).tolist() == [0, 1, 1, 0]
    # where nothing fits, the product alone decides
    assert sharding.best_shards(np.array([[2.0, 0.0, 0.0], [1.5, 0.0, 0.0], [0.9, 0.0, 0.0]]), 2).tolist() == [0, 1, 1]
    assert len(sharding.best_shards(np.zeros((0, 3)), 4)) == 0


def test_odd_documents(odd_docs, no_docs, tmp_path, spark):
    rows = sharding.place(odd_docs, shards=3).collect()
    assert len(rows) == odd_docs.count()
    check_slots(rows)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 4} == {(8, 0)}
    assert sharding.place(no_docs).count() == 0
    sharding.write_shards(odd_docs.drop("shard"), str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd_docs.count() and set(back.columns) == set(odd_docs.columns)
    assert back.select(F.count_distinct("shard")).first()[0] <= 3

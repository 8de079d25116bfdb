import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.llm import toxicity
from lastleg.llm.queries import QUERIES
from llm.conftest import words


def test_search_is_exact():
    """The block-max search finds what comparing with every example finds."""
    rng = np.random.default_rng(1)
    terms, size = 40, 700
    vectors = []
    for _ in range(size):
        t = np.sort(rng.choice(terms, rng.integers(0, 8), replace=False))
        vectors.append((t, rng.integers(1, 5, len(t)).astype(float)))
    index = toxicity.Index(rng.permutation(size) * 3, rng.integers(0, 2, size), rng.uniform(1, 5, terms), 15, 0.5)
    index.build(vectors)
    dense = np.zeros((size, terms))
    for i, (t, n) in enumerate(vectors):
        if len(t):
            dense[i, t] = index.vector(t, n)
    asked = range(0, size, 7)
    for i, (at, cosine) in zip(asked, index.nearest([vectors[i] for i in asked]), strict=True):
        t, n = vectors[i]
        q = np.zeros(terms)
        if len(t):
            q[t] = index.vector(t, n)
        full = np.round(dense @ q, 12)
        want = [j for j in np.lexsort((index.ids, -full)) if full[j] > 0][:15]
        assert np.allclose(cosine, full[want]) and [full[j] for j in at] == pytest.approx([full[j] for j in want])


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]
    assert (np.diff(y) >= 0).all()


def labelled(spark, docs, toxic):
    return spark.createDataFrame([(i, 1, toxic(i)) for i in docs], "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned(spark, make_docs):
    bad = ["vilea", "vileb", "vilec"]
    docs = [(i, words(30, 10 * (i % 90)) + (f" {bad[i % 3].upper()}! {bad[(i + 1) % 3]}" if i % 4 == 0 else ""), None, None) for i in range(1, 801)]
    labels = labelled(spark, range(1, 801), lambda i: int(i % 4 == 0) if i % 40 else 1 - int(i % 4 == 0))
    rows = toxicity.score(make_docs(docs), labels, F.col("doc_id") % 2 == 0, max_examples=100).collect()
    assert all((r["score"] >= 0.7) == (r["d"] % 4 == 0) for r in rows)
    evidence = next(r for r in rows if r["d"] == 4)["evidence"]
    assert len(evidence) == 15 and all(e["id"] % 2 == 0 for e in evidence)
    assert [e["cosine"] for e in evidence] == sorted((e["cosine"] for e in evidence), reverse=True)


def rare_words(count, seed=3):
    """Documents of which a quarter hold one of 60 toxic words, each word thus in few of them."""
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(count):
        text = " ".join(f"w{j:04d}" for j in rng.integers(0, 900, 40))
        docs.append((i, f"{text} vile{rng.integers(60):02d} {text[:20]}" if i % 4 == 0 else text, None, None))
    return docs


def test_rare_toxic_words_are_caught(spark, make_docs):
    """No toxic word is in more than one in 200 documents; every document that shares a word with an example has evidence."""
    docs = rare_words(2000)
    rows = toxicity.score(make_docs(docs), labelled(spark, range(2000), lambda i: int(i % 4 == 0)), F.col("doc_id") % 3 != 1).collect()
    held_out = [r for r in rows if r["d"] % 3 == 1]
    toxic = [r["score"] >= 0.7 for r in held_out if r["d"] % 4 == 0]
    clean = [r["score"] >= 0.7 for r in held_out if r["d"] % 4]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    assert all(len(r["evidence"]) == 15 for r in rows)


def test_scores_equal_brute_force_over_the_full_vocabulary(spark, make_docs):
    """Cosines of all documents and examples with every word, votes of the nearest, calibrated as the library does."""
    docs = rare_words(240)
    texts = {i: t for i, t, *_ in docs}
    labels = {i: int(i % 4 == 0) for i in texts}
    rows = toxicity.score(make_docs(docs), labelled(spark, texts, labels.get), F.col("doc_id") % 3 != 1).collect()
    examples = sorted(i for i in texts if i % 3 != 1)
    bags = {i: Counter(toxicity.words(t)) for i, t in texts.items()}
    vocabulary = sorted({w for i in examples for w in bags[i]})
    n, toxic = len(examples), sum(labels[i] for i in examples)
    weight = {}
    for w in vocabulary:
        m, a = sum(w in bags[i] for i in examples), sum(w in bags[i] for i in examples if labels[i])
        p, q = (a + 0.5) / (toxic + 1), (m - a + 0.5) / (n - toxic + 1)
        sure = abs(p - q) / math.sqrt(p * (1 - p) / (toxic + 1) + q * (1 - q) / (n - toxic + 1))
        depends = toxicity.LEAST + (1 - toxicity.LEAST) * abs(p - q) / (p + q) * sure**4 / (sure**4 + 81)
        weight[w] = depends * (math.log((1 + len(texts)) / (1 + sum(w in b for b in bags.values()))) + 1)
    vectors = {i: {w: (1 + math.log(c)) * weight[w] for w, c in bags[i].items() if w in weight} for i in texts}
    norms = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}

    def near(i, leave_out):
        found = []
        for e in examples:
            if leave_out and e == i:
                continue
            dot = sum(x * vectors[e][w] for w, x in vectors[i].items() if w in vectors[e])
            if dot > 0:
                found.append((-round(dot / norms[i] / norms[e], 12), e))
        found.sort()
        votes = [(1 / (1.3 + c), labels[e]) for c, e in found[:15]]
        return found[:15], sum(v * y for v, y in votes) / sum(v for v, _ in votes)

    x, y = toxicity.isotonic(np.array([near(e, True)[1] for e in examples]), np.array([labels[e] for e in examples], float), np.ones(n))
    for r in rows:
        want, vote = near(r["d"], False)
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx([-c for c, _ in want], abs=1e-9)
        assert r["score"] == pytest.approx(np.interp(vote, x, y), abs=1e-6)


def test_query(spark):
    rows = QUERIES["op6_toxicity"](spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and not math.isnan(r["score"])


def test_documents_without_labels_or_with_one_label(spark, odd_docs, no_docs):
    none = labelled(spark, [], int)
    assert {r["score"] for r in toxicity.score(odd_docs, none, F.lit(True)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(odd_docs, labelled(spark, [1, 2], lambda i: 1), F.lit(True)).collect()} == {1.0}
    kept = toxicity.keep_clean(odd_docs, none, F.lit(True))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score(no_docs, none, F.lit(True)).count() == 0


def test_odd_documents(spark, odd_docs):
    odd = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (7, 0, 0), (8, 0, 0), (9, None, None), (None, 0, 1), (10, 0, 5)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_docs, odd, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)

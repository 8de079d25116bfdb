import zlib

import numpy as np
from pyspark.sql import functions as F

from lastleg.llm import language_id as lid
from lastleg.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def small_network(hidden=3, languages=4, seed=0):
    rng = np.random.default_rng(seed)
    return lid.Network(
        [f"l{i}" for i in range(languages)], rng.normal(size=(2, 3 * hidden, 256)), rng.normal(size=(2, 3 * hidden, hidden)),
        rng.normal(size=(2, 3 * hidden)), rng.normal(size=(languages, 2 * hidden)), rng.normal(size=languages),
    )


def test_gradient_equals_differences():
    net, rng = small_network(), np.random.default_rng(1)
    ids, labels = rng.integers(0, 256, (6, 3)), np.array([0, 2, 3])
    loss, gradient = lid.loss_and_gradient(net, ids, labels)
    for p, g in zip(net.parameters(), gradient, strict=True):
        for i in [np.unravel_index(np.abs(g).argmax(), g.shape), (0,) * g.ndim]:
            p[i] += 1e-6
            more = lid.loss_and_gradient(net, ids, labels)[0]
            p[i] -= 1e-6
            assert abs((more - loss) / 1e-6 - g[i]) < 1e-4


def slow_pooled(net, data):
    """One byte after the other, as the equations say."""
    size, total = net.u.shape[2], np.zeros(len(net.c))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(data), lid.SEGMENT):
        part, states = data[at:at + lid.SEGMENT], []
        for way in (0, 1):
            h, found = np.zeros(size), []
            for byte in part if way == 0 else reversed(part):
                x, g = net.w[way][:, byte] + net.b[way], net.u[way] @ h
                z, r = sigmoid(x[:size] + g[:size]), sigmoid(x[size:2 * size] + g[size:2 * size])
                n = np.tanh(x[2 * size:] + r * g[2 * size:])
                h = (1 - z) * n + z * h
                found.append(h)
            states.append(found if way == 0 else found[::-1])
        for a, b in zip(*states, strict=True):
            logits = net.out @ np.concatenate([a, b]) + net.c
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / max(len(data), 1)


def test_reader_equals_the_equations():
    net, rng = small_network(), np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 127, 128, 129, 300, 256)]
    got = lid.Reader(net).pooled(texts)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, slow_pooled(net, text), atol=1e-5)
    spans = lid.label_spans(lid.Reader(net), net.languages, "ein Text\n" * 40)
    assert spans[0][0] == 0 and spans[-1][1] == 360 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_query_on_held_out_documents(spark):
    rows = QUERIES["op2_language"](spark, BIG).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_documents(spark, odd_docs, no_docs, make_docs):
    assert lid.fit(no_docs, F.lit(True)) is None
    assert {(r["lang_pred"], r["score"]) for r in lid.predict(odd_docs, None).collect()} == {("und", 0.0)}
    net = lid.fit(odd_docs, F.lit(True), steps=20)
    assert net.languages == ["de", "en", "fr"]
    rows = lid.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    of = {r["doc_id"]: r for r in rows}
    assert all(of[i]["lang_pred"] == "und" and of[i]["score"] == 0 for i in (4, 5, 6)) and of[8]["lang_pred"] in net.languages
    one = lid.fit(odd_docs.where("lang = 'en'"), F.lit(True))
    assert {(r["lang_pred"], round(r["score"], 6)) for r in lid.predict(make_docs([(1, "a b", None, None)]), one).collect()} == {("en", 1.0)}
    assert lid.predict(no_docs, net).count() == 0

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lastleg.llm import fim
from llm.conftest import words


def slow(doc_id, text, seed=7, percent=100, spm_percent=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(h[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or draws[2] % 100 >= percent or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, text
    a, b = sorted(d % (len(lines) + 1) for d in draws[:2])
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if draws[3] % 100 < spm_percent:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(0, 400), min_size=1, max_size=300), st.integers(0, 90))
@settings(max_examples=200, deadline=None)
def test_index_gives_every_offset(steps, error):
    offsets = np.concatenate([[0], np.cumsum(steps)])
    index = fim.RankIndex.fit(offsets, error)
    ranks = np.arange(len(offsets))
    assert (index.locate(ranks) == offsets).all()
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_segments_are_few_where_lines_are_even():
    rng = np.random.default_rng(3)
    even = np.arange(100_000) * 37
    assert len(fim.RankIndex.fit(even).first) == 1
    rough = np.concatenate([[0], np.cumsum(rng.integers(20, 60, 100_000))])
    index = fim.RankIndex.fit(rough, 64)
    assert 1 < len(index.first) < 10_000 and index.residual.dtype == np.int8
    wild = np.concatenate([[0], np.cumsum(rng.integers(0, 2**20, 500))])
    assert (fim.RankIndex.fit(wild, 64).locate(np.arange(501)) == wild).all()


def test_equals_brute_force(spark, odd_docs, no_docs, make_docs):
    rng = np.random.default_rng(9)
    texts = ["\n" * 5, "a\n\nb", "\n", "x", "one <P> two\n", "<S", "a<\nP>\n<\n", "äö\nß😀\n" * 50, "\r\n \x85\n"]
    texts += ["\n".join(words(int(rng.integers(0, 12)), 5 * j) for j in range(int(rng.integers(1, 60)))) for _ in range(150)]
    texts.append("\n".join(words(8, 8 * i) for i in range(40_000)))  # some MB
    made = make_docs([(i, t, "en", "a") for i, t in enumerate(texts)])
    for docs in (made, odd_docs, no_docs):
        got = fim.transform(docs)
        restored = got.withColumn("back", fim.restore(F.col("output"), F.col("form")))
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(slow(i, t)) for i, t in rows)
        assert sorted((r["back"], str(r["doc_id"])) for r in restored.collect()) == sorted((t or "", str(i)) for i, t in rows)


@pytest.mark.parametrize("percent,spm", [(0, 50), (60, 0), (60, 100)])
def test_shares(make_docs, percent, spm):
    docs = [(i, words(30) + "\n" + words(9), "en", "a") for i in range(300)]
    got = fim.transform(make_docs(docs), seed=11, percent=percent, spm_percent=spm)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [slow(i, t, 11, percent, spm) for i, t, _, _ in docs]


def test_index_table_finds_cuts_without_the_text(odd_docs):
    docs = {r["doc_id"]: r["text"] for r in odd_docs.filter("doc_id IN (1, 8)").collect()}
    for r in fim.index(odd_docs).filter("doc_id IN (1, 8)").collect():
        index = fim.RankIndex(*(np.array(r[c]) for c in ("first", "start", "slope", "residual")))
        ends = [0, *(m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", docs[r["doc_id"]]))]
        assert index.locate(np.arange(r["n"] + 1)).tolist() == ends

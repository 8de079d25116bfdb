import math
from collections import Counter

import pytest
import xxhash

from lastleg.llm import mixing
from llm.conftest import words


def test_alpha_meets_the_limit_and_the_entropy():
    tokens = [1000, 100, 100, 10]
    alpha = mixing.find_alpha(tokens, repetition_limit=3.0)
    assert max(mixing.repetitions(tokens, mixing.weights(tokens, alpha))) == pytest.approx(3.0, rel=1e-9)
    alpha = mixing.find_alpha(tokens, target_entropy=1.1)
    assert mixing.entropy(mixing.weights(tokens, alpha)) == pytest.approx(1.1, rel=1e-9)
    assert mixing.find_alpha(tokens, target_entropy=0.0) == 1.0
    assert mixing.find_alpha(tokens, target_entropy=9.0) == 0.0
    assert mixing.find_alpha([5, 5], repetition_limit=2.0) == 0.0
    assert mixing.weights(tokens, 0.0) == [0.25] * 4
    with pytest.raises(ValueError):
        mixing.find_alpha(tokens)


@pytest.mark.parametrize("block_tokens", [30, 100_000])
def test_budgets_and_passes(make_docs, block_tokens):
    docs = [(i, words(5 + i % 7, 20 * i), None, "big" if i % 4 else f"small{i % 8}") for i in range(600)]
    tokens = {i: 5 + i % 7 for i, *_ in docs}
    source = {i: s for i, _, _, s in docs}
    rows = mixing.schedule(make_docs(docs), repetition_limit=2.5, block_tokens=block_tokens).collect()
    totals = Counter()
    for i, n in tokens.items():
        totals[source[i]] += n
    plan = {m.source: m for m in mixing.plan_mix(sorted(totals.items()), None, 2.5, None)}
    read, seen = Counter(), Counter((r["d"], r["epoch"]) for r in rows)
    for r in rows:
        read[r["s"]] += r["tokens"]
        assert 0 <= r["mix_key"] < 1
    assert max(seen.values()) == 1
    for s, m in plan.items():
        assert 0 <= read[s] - m.budget < 11.001  # the budget is met within its last document
        for epoch in range(m.passes):
            assert sum(1 for d, e in seen if e == epoch and source[d] == s) == sum(1 for x in source.values() if x == s)
    assert max(m.budget / m.tokens for m in plan.values()) == pytest.approx(2.5)
    assert {r["d"] for r in rows} == set(source)


def test_a_budget_below_the_corpus_takes_parts(make_docs):
    docs = [(i, words(10, 10 * i), None, "ab"[i % 2]) for i in range(400)]
    rows = mixing.schedule(make_docs(docs), target_entropy=math.log(2), budget=1000.0, block_tokens=200).collect()
    assert Counter(r["s"] for r in rows) == {"a": 50, "b": 50} and {r["epoch"] for r in rows} == {0}


def hashed(*values, blocks=None):
    """Chained 64-bit hashes of an int and longs, as the engine's own function gives them."""
    seed = 42
    for size, v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=seed)
    n = seed - (1 << 64) if seed >= 1 << 63 else seed
    return n if blocks is None else n % blocks


def slow_schedule(docs, mixes, block_tokens, seed=1):
    """(doc, epoch, place in the mix) by a loop over sources, passes, blocks and documents."""
    def text_hash(text):
        n = xxhash.xxh64_intdigest(text.encode(), seed=42)
        return n - (1 << 64) if n >= 1 << 63 else n

    out = set()
    for m in mixes:
        count = max(1, -(-m.tokens // block_tokens))
        blocks = {}
        for i, text, _, source in docs:
            if source == m.source:
                t = text_hash(text)
                blocks.setdefault(hashed((4, seed), (8, i), (8, t), blocks=count), []).append((i, t, len(text.split())))
        for epoch in range(m.passes + (m.rest > 0)):
            start = 0
            for b in sorted(blocks, key=lambda b: (hashed((4, seed), (4, epoch), (8, b)), b)):
                room = math.inf if epoch < m.passes else m.rest - start
                inside = 0
                for i, _, n in sorted(blocks[b], key=lambda r: (hashed((4, seed), (4, epoch), (8, r[0]), (8, r[1])), r[0], r[1])):
                    if inside < room:
                        out.add((i, epoch, round((epoch * m.tokens + start) / m.budget, 9)))
                    inside += n
                start += inside
    return out


@pytest.mark.parametrize("options", [{"repetition_limit": 1.5}, {"repetition_limit": 2.7}, {"target_entropy": 0.9, "budget": 2500.0}])
def test_schedule_equals_brute_force(make_docs, options):
    docs = [(i, words(3 + i % 9, 20 * i), None, "c" if i % 10 == 0 else "ab"[i % 3 == 0]) for i in range(500)]
    totals = Counter()
    for _, text, _, source in docs:
        totals[source] += len(text.split())
    mixes = mixing.plan_mix(sorted(totals.items()), options.get("target_entropy"), options.get("repetition_limit"), options.get("budget"))
    rows = mixing.schedule(make_docs(docs), block_tokens=150, **options).collect()
    got = [(r["d"], r["epoch"], round(r["mix_key"], 9)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == slow_schedule(docs, mixes, 150)


def test_odd_documents(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, repetition_limit=1.0)
    assert sorted(mixed.columns) == sorted([*odd_docs.columns, "mix_key"])  # an own column "epoch" gives way
    assert mixed.count() == odd_docs.count()
    renamed = mixing.mix(odd_docs, "__e", "__k", repetition_limit=3.0)
    assert renamed.select(*odd_docs.columns).count() >= odd_docs.count()
    assert mixing.mix(no_docs, repetition_limit=2.0).count() == 0

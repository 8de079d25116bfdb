import numpy as np

import corpus_pipeline
from lastleg.llm import jaccard
from llm.conftest import words
from llm.test_simhash import slow_components


def slow_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def changed(base, at):
    """The words of ``base`` with those at the given places changed."""
    out = base.split()
    for i in at:
        out[i] += "q"
    return " ".join(out)


def test_stage_equals_exact_jaccard(spark, make_docs):
    """Pairs just above 0.8 are found, those just below are not linked."""
    rng = np.random.default_rng(5)
    docs = []
    for g in range(150):
        base = words(400, 1000 * g)
        docs.append((2 * g + 1, base, "en", "a"))
        # each changed word far from the others changes five shingles
        places = 10 + 12 * rng.choice(30, int(rng.integers(4, 13)), replace=False)
        docs.append((2 * g + 2, changed(base, places), "en", "a"))
    roots = brute_roots(docs)
    assert 50 < len(docs) - len(roots) < 140
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make_docs(docs), "").collect()} == roots


def test_recall_at_the_threshold():
    """Of 2,000 pairs of similarity 0.8 nearly all share a band."""
    rng = np.random.default_rng(7)
    factors, shifts = jaccard._permutations()
    met = 0
    for _ in range(2000):
        h = rng.integers(0, 2**64, 200, np.uint64)
        a, b = (jaccard.band_keys(x, factors, shifts) for x in (h[:180], h[20:]))  # 160 of 200 shared
        met += any(x == y for x, y in zip(a, b, strict=True))
    assert met >= 1995


def test_links_rest_on_the_texts(spark, make_docs):
    """One line repeated many times doesn't make different texts alike; a chain is one group, its ends being joined by real links."""
    line = " same line again" * 300
    chain = [words(400, 90_000)]
    for step in range(3):
        chain.append(changed(chain[-1], range(15 + 130 * step, 15 + 130 * step + 60, 10)))
    sets = [slow_set(t) for t in chain]
    assert all(alike(a, b) for a, b in zip(sets, sets[1:])) and not alike(sets[0], sets[3])
    docs = make_docs([
        (1, words(40, 100) + line, "en", "a"), (2, words(40, 500) + line, "en", "a"),
        *[(10 + i, t, "en", "a") for i, t in enumerate(chain)], (20, words(9), "en", "a"), (21, words(9).upper(), "en", "a"),
        (None, words(9), "en", "a"), (30, None, None, None), (31, "", None, None),
    ])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 2, 10, 20, 30}


def brute_roots(docs):
    sets = {i: slow_set(t) for i, t, _, _ in docs}
    pairs = [(b, a) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    return {i for i, c in slow_components(sorted(sets), pairs).items() if i == c}


def family(size, seed, base, most):
    """Copies of one text, each changed in its own places, up to far beyond the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for number in range(size):
        copy = base.split()
        for i in rng.choice(len(copy), int(rng.integers(0, most)), replace=False):
            copy[i] = f"v{seed}v{number}v{i}"
        out.append(" ".join(copy))
    return out


def test_large_buckets_equal_exact_jaccard(spark, make_docs):
    """A large group of near copies, among them copies of a far copy, some of which reach back to the group."""
    base = words(150)
    far = changed(base, range(3, 150, 9))
    bridge = changed(base, range(3, 75, 9))
    texts = [base, *family(120, 1, base, 22), far, *family(60, 2, far, 12), bridge]
    texts += [" ".join(base.split()[i:]) for i in range(0, 60, 3)] + [" ".join(base.split()[: 150 - i]) for i in range(1, 60, 3)]
    docs = [(i + 1, t, "en", "a") for i, t in enumerate(dict.fromkeys(texts))]
    want = brute_roots(docs)
    assert 10 < len(want) < len(docs) - 50
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make_docs(docs), "").collect()} == want


def test_candidates_grow_with_a_group_not_its_square(make_docs, monkeypatch):
    """Near copies of one text, many of them not alike to it, cost a few rows each, where all pairs of 400 would be 200 each.

    The rows still grow somewhat faster than the group at these sizes (2.26 times from 200 to 400), as more of its texts share a bucket; a text
    can't be in more than ``BANDS`` buckets.
    """
    seen = {}
    for size in (200, 400):
        counts = []
        real_rare, real_compared, real_spokes = jaccard._rare_pairs, jaccard._compared, jaccard._spokes

        def count(make):
            def counted(*args):
                made = make(*args)
                counts.append(made.count())
                return made
            return counted

        monkeypatch.setattr(jaccard, "_rare_pairs", count(real_rare))
        monkeypatch.setattr(jaccard, "_spokes", count(real_spokes))
        monkeypatch.setattr(jaccard, "_compared", lambda pairs, *rest: (counts.append(pairs.count()), real_compared(pairs, *rest))[1])
        base = words(150)
        docs = make_docs([(0, base, "en", "a")] + [(i + 1, t, "en", "a") for i, t in enumerate(family(size, 4, base, 8))])
        jaccard.keep_one(docs).count()
        monkeypatch.undo()
        seen[size] = sum(counts)
    assert all(rows <= 6 * size for size, rows in seen.items()) and seen[400] <= 2.5 * seen[200]

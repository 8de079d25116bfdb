"""The SimHash operator's part in near-dedup."""

import random

from lastleg.llm import jaccard, simhash
from llm.test_jaccard import alike, slow_set


def test_near_fingerprints_link_without_minhash(make_docs, monkeypatch):
    """With no MinHash candidates at all, what is alike and within the radius still links; a near fingerprint alone never does."""
    rng = random.Random(8)
    texts = []
    for f in range(6):
        words = [f"w{f}x{rng.randrange(4000)}" for _ in range(400)]
        for _ in range(2):
            texts.append(" ".join(words))
            words[rng.randrange(400)] = "changed"
    texts += ["a b c", "A  b c", None, "", "a b d"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    prints = [simhash.text_fingerprint(t, 5) for t in texts]
    sets = [slow_set(t) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4 and alike(sets[i], sets[j])}
    assert sum(j - i == 1 and j < 12 for i, j in near) >= 4
    monkeypatch.setattr(jaccard, "_twos", lambda members, threshold: members.limit(0).selectExpr("node AS a", "node AS b"))
    monkeypatch.setattr(jaccard, "_spokes", lambda large: large.limit(0).selectExpr("node AS c", "node AS x"))
    kept = {r.doc_id for r in jaccard.keep_one(make_docs(rows)).collect()}
    assert kept == set(range(len(texts))) - {j for _, j in near}

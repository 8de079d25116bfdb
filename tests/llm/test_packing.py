import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import DATA
from lastleg.llm import packing
from lastleg.llm.common import stage
from lastleg.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def slow_pieces(tokenizer, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    parts = [ids[a:a + capacity] for a in range(0, len(ids), capacity)]
    return [(i, i * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(parts)]


def test_chunks_give_the_tokens_of_the_whole_text(tokenizer):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "é", "́", "ß", "İ", "Σ", "'s", "'LL", "9", "12", "!", "…", "中", "👍🏽", " ", "\n", "\t", "\x85", " ", " ", "\x1c",
                "\x1f", "<|endoftext|>", "<|", "|>", "\0", "‍"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x100)] if c != 39]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for encode in (packing.ChunkEncoder(), packing.ChunkEncoder(most_chunks=500)):
        for at in range(0, len(texts), 700):
            part = texts[at:at + 700]
            for text, ids in zip(part, encode(pa.array(part)), strict=True):
                assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        sliced = encode(pa.array(texts[:50]).slice(3, 20))
        assert [s.tolist() for s in sliced] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[3:23]]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 30, 100])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50, 1000]) for _ in range(rng.randint(0, 25))}
    patterns = packing.plan_patterns(counts, capacity)
    used = Counter()
    for lengths, times in patterns:
        assert 0 < sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in patterns) <= 1 + 1.7 * total / capacity  # best fit's guarantee


def test_exact_complements_are_found():
    counts = {60: 10, 40: 10, 50: 6, 30: 6, 20: 6, 90: 4, 5: 4, 3: 4, 2: 4}
    patterns = packing.plan_patterns(counts, 100)
    assert all(sum(p) == 100 for p, _ in patterns)


def check_sequences(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_query_equals_brute_force(spark, tokenizer):
    rows = QUERIES["op7_packing"](spark, DATA).collect()
    want = {
        (r["doc_id"], *p) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for p in slow_pieces(tokenizer, r["text"], 2048)
    }
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bound = -(-sum(r["length"] for r in rows) // 2048)
    assert check_sequences(rows, 2048) <= bound * 1.02 + 2


def test_odd_documents(odd_docs, no_docs, tokenizer):
    packed = packing.pack_documents(odd_docs, capacity=64, with_ids=True).collect()
    want = Counter((r["doc_id"], *p) for r in odd_docs.collect() for p in slow_pieces(tokenizer, r["text"], 64))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in packed)
    check_sequences(packed, 64)
    assert packing.pack_documents(no_docs).count() == 0


def test_one_hot_length(spark):
    pieces = stage(spark.range(50_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 7, 5) AS length", "id AS ids_crc32"), "test_pieces")
    rows = packing.pack(pieces, 12).collect()
    assert len(rows) == 50_000 and check_sequences(rows, 12) <= 25_010

"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is 1 where more than half of the hashes of a text's word
shingles have it. Two fingerprints link when at most ``radius`` bits differ. Candidates come
from covering masks: give every bit position i a vector m(i) of radius + 1 bits; for each
nonzero vector v the mask holds the positions with <m(i), v> = 1. Any ``radius`` positions
span less than the whole space, so some v is orthogonal to all of them: its mask ignores
exactly those differences, and the pair meets in that table. No pair within the radius is lost.

Buckets above ``max_bucket`` fingerprints are not paired but split again by a second set of
masks joined to the first, and so on: the same argument holds inside a bucket, and with each
level half of the free bits are fixed, so a bucket ends with few distinct fingerprints.

Defined cases: null and empty texts have fingerprint 0 and link like any other; exact copies
share one fingerprint and are one node of the graph; rows without doc_id get a fingerprint and the
component of the documents that share it (null if none does); an empty table gives no rows; other
columns of the input are ignored or, by ``keep_one``, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import stage_texts
from lastleg.llm.graph import connected_components
from lastleg.session import stage

BITS = 64
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16  # shingles hashed at once, so that a very long text needs little memory


def text_fingerprint(text: str | None, shingle_words: int) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        pairs = zip(starts[at: at + _CHUNK], ends[at: at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, t, fp) of every row; t is the text's hash, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle_words) for t in batch.column(2)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("<i8"))], ["doc_id", "t", "fp"])

    columns = [F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.col("text").cast("string")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, t long, fp long")


def covering_masks(radius: int, level: int) -> list[int]:
    """The 2^(radius+1) - 1 masks as signed longs.

    Nonzero vectors are dealt to positions evenly, and of several deals that one is taken whose smallest
    mask has most bits, since a mask of few bits makes large buckets.
    """
    vectors = np.arange(1, 2 ** (radius + 1), dtype=np.uint64)
    rng = np.random.default_rng(SEED + level)
    best = None
    for _ in range(50):
        deal = np.concatenate([rng.permutation(vectors) for _ in range(-(-BITS // len(vectors)))])[:BITS]
        odd = np.bitwise_count(deal[None, :] & vectors[:, None]) % 2  # a row for each mask
        if best is None or odd.sum(axis=1).min() > best.sum(axis=1).min():
            best = odd
    packed = np.packbits(best.astype(np.uint8), axis=1, bitorder="little")
    return [int(m) for m in packed.view("<i8")[:, 0]]


def _links(radius: int):
    def in_bucket(fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
        """Edges that join each cluster of close fingerprints to its smallest node; at most one a node."""
        n = len(fp)
        root = np.arange(n)
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        order = np.argsort(node)
        seen = np.zeros(n, bool)
        for first in order:
            if seen[first]:
                continue
            seen[first] = True
            frontier = np.array([first])
            while len(frontier):
                reached = near[frontier].any(axis=0) & ~seen
                seen |= reached
                root[reached] = first
                frontier = np.nonzero(reached)[0]
        for i in np.nonzero(root != np.arange(n))[0]:
            yield int(node[i]), int(node[root[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(4)]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            table, key, fp, node = now
            new = np.nonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]))[0] + 1
            bounds = np.concatenate([[0], new, [len(key)]])
            held = [x[bounds[-2]:] for x in now]
            yield edges(fp, node, bounds[:-1])
        if held is not None:
            yield edges(held[2], held[3], np.array([0, len(held[0])]))

    def edges(signed: np.ndarray, node: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        fp = signed.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        found: list[tuple[int, int]] = []
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        more = np.nonzero(sizes > 2)[0]
        for i in more:
            found += in_bucket(fp[bounds[i]: bounds[i + 1]], node[bounds[i]: bounds[i + 1]])
        a = np.concatenate([node[two], np.array([x for x, _ in found], np.int64)])
        b = np.concatenate([node[two + 1], np.array([x for _, x in found], np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def covering_edges(nodes: DataFrame, radius: int, max_bucket: int = 2048) -> DataFrame:
    """Edges (a, b) between the nodes of fingerprints within ``radius``, enough to connect all of them.

    ``nodes`` has one row (fp, node) for each distinct fingerprint and is a stored table.
    Inside a bucket every cluster gives a star, so edges grow with the bucket, not its square.
    """
    mask_columns = [F.lit(m) for m in covering_masks(radius, 0)]
    rows = _spread(nodes.select("fp", "node", F.lit(0).cast("long").alias("table"), F.lit(0).cast("long").alias("mask")), mask_columns)
    found = None
    level = 0
    while True:
        large = stage(rows.groupBy("table", "key").count().filter(F.col("count") > max_bucket).drop("count"), "large_buckets")
        any_large = bool(large.take(1))
        cold = rows.join(large, ["table", "key"], "left_anti") if any_large else rows
        dealt = cold.select("table", "key", "fp", "node").repartition("table", "key").sortWithinPartitions("table", "key")
        edges = stage(dealt.mapInArrow(_links(radius), "a long, b long").distinct(), "links")
        found = edges if found is None else found.unionByName(edges)
        if not any_large:
            return found
        level += 1
        hot = rows.join(large, ["table", "key"], "left_semi").select("fp", "node", "table", "mask")
        rows = _spread(stage(hot, "split_buckets"), [F.lit(m) for m in covering_masks(radius, level)])


def _spread(rows: DataFrame, masks: list[Column]) -> DataFrame:
    """One row for each row and mask; masks add up over the levels, table numbers stay distinct."""
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("t"), m.alias("m")) for i, m in enumerate(masks)]))
    return rows.select("fp", "node", "table", "mask", each.alias("x")).select(
        "fp", "node", (F.col("table") * (len(masks) + 1) + F.col("x.t")).alias("table"),
        F.col("mask").bitwiseOR(F.col("x.m")).alias("mask"),
    ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def near_groups(docs: DataFrame, shingle_words: int = 5, radius: int = 4, max_bucket: int = 2048) -> DataFrame:
    """(doc_id, t, fp, component_id) of every row; the component is its smallest doc_id."""
    prints = stage_texts(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stage(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct_fingerprints")
    linked = stage(connected_components(covering_edges(nodes, radius, max_bucket), "a", "b"), "components")
    joined = nodes.join(linked, "node", "left").select(F.col("fp").alias("known"), F.coalesce("component", "node").alias("component_id"))
    classes = stage(joined, "classes")
    return prints.join(classes, F.col("fp") == F.col("known"), "left").select("doc_id", "t", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, all columns as they are.

    Rows without doc_id belong to no group and stay; a kept row that is repeated stays repeated. Rows
    that share a doc_id but not the text are judged each by its text.
    """
    groups = near_groups(docs.select("doc_id", "text"), shingle_words, radius)
    copies = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"))
    # always a merge join: copies grow with the corpus, so a broadcast would only suit small inputs
    same = (F.col("doc_id").cast("long") == F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    return docs.join(copies.hint("merge"), same, "left_anti")

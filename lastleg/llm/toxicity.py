"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over a vocabulary, and a text is scored by its ``k`` nearest labelled
examples by exact cosine. Examples lie in an inverted index in blocks of ``BLOCK``; for each term
and block the largest weight is kept. The sum of these maxima bounds the cosine of every example in
the block. The blocks of the highest bounds are opened first, then every other one whose bound reaches the k-th best cosine
found there: the neighbours are exact. Each neighbour votes with weight 1 / (0.3 + 1 - cosine), and isotonic
regression over the examples' own leave-one-out votes, weighted back to the labels' true
shares, turns the vote into a probability.

Every word of an example is a term. Its weight is its inverse document frequency, counted over all documents, times how far the examples
say that it depends on the label: 1/20 for a word that tells nothing, up to 1 for one that only one label has, rising smoothly with the difference
of its shares in both labels and with the standard errors that this is worth. So a rare toxic word counts from its first examples on,
and ordinary words, which all texts share, decide only between examples that have nothing else in common with a text.

What is bounded: examples, at most ``max_examples`` of each label (those with the smallest hash of doc_id; equal texts are one
example). The words of 3,000 examples make a small index. Every whole text is scored.

Defined cases: a null or empty text, or one without a term of the vocabulary, gets the calibrated share of
toxic examples without terms, or of all examples if each has one; with no labelled document every score is 0; with one label only every
score is 0 or 1 by that label; labels other than 0 and 1 and null ids are ignored; a document
labelled twice is toxic if one label says so; rows that repeat are scored alike; an empty table gives no rows; other columns are
ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import stage_texts, unused
from lastleg.session import stage

BLOCK = 64
COMMON = 32  # a word in more than one of so many examples is common
FIRST_BLOCKS = 4
TOGETHER = 400_000  # postings and examples that one search may hold
LEAST = 0.05  # the weight of a word that tells nothing about the label
_WORD = re.compile(r"[^\W_]+")
_KEPT_ANSWERS = 20_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Index:
    """Normalised example vectors as postings by term, in blocks of examples, with block maxima.

    The postings of a word that more than 1/``COMMON`` of the examples have are full rows, with zeros, so that many texts meet them in one product.
    """

    ids: np.ndarray
    labels: np.ndarray
    idf: np.ndarray
    k: int
    base_score: float
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the row of a common term, else -1
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, BLOCK)))  # (block, row, example of the block)
    tops: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (row, block): the block maxima of common terms
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where the postings of a rarer term begin
    examples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ascending within a term
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cells: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each term's block maxima begin
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    maxima: np.ndarray = field(default_factory=lambda: np.zeros(0))
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # where the postings of a term and block begin

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return weights / np.sqrt((weights**2).sum())

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if sizes else np.zeros(0, np.int64)
        weight = np.concatenate([self.vector(t, c) if len(t) else np.zeros(0) for t, c in vectors])
        example = np.repeat(np.arange(len(vectors)), sizes)
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        count = -(-len(vectors) // BLOCK)
        common = np.nonzero(np.bincount(term, minlength=len(self.idf)) * COMMON > len(vectors))[0]
        self.rows = np.full(len(self.idf), -1)
        self.rows[common] = np.arange(len(common))
        row = self.rows[term]
        full, rest = row >= 0, row < 0
        self.dense = np.zeros((count, len(common), BLOCK))
        self.dense[example[full] // BLOCK, row[full], example[full] % BLOCK] = weight[full]
        self.tops = self.dense.max(axis=2).T.copy()
        term, self.examples, self.weights = term[rest], example[rest], weight[rest]
        self.starts = np.searchsorted(term, np.arange(len(self.idf) + 1))
        cell = term * (count + 1) + self.examples // BLOCK
        self.firsts = np.nonzero(np.diff(cell, prepend=-1))[0]
        self.blocks = self.examples[self.firsts] // BLOCK
        self.maxima = np.maximum.reduceat(self.weights, self.firsts) if len(cell) else np.zeros(0)
        self.cells = np.searchsorted(term[self.firsts], np.arange(len(self.idf) + 1))
        self.firsts = np.append(self.firsts, len(cell))

    def _ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of all ranges, one after the other."""
        sizes = ends - starts
        return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, counts): positions and cosines of the k nearest examples, nearest first, ties to the smaller id.

        Cosine 0 is no neighbour, nor is the example at the position that ``without`` names for a query. Queries are searched together, as many as
        have ``TOGETHER`` postings.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        waiting: list[int] = []
        postings = 0
        for i, (terms, _) in enumerate(queries):
            if len(terms) and len(self.ids):
                waiting.append(i)
                postings += len(self.ids) + int((self.starts[terms + 1] - self.starts[terms]).sum())
            if waiting and (postings >= TOGETHER or i == len(queries) - 1):
                found = self._search([queries[j] for j in waiting], [without[j] if without else -1 for j in waiting])
                for j, answer in zip(waiting, found, strict=True):
                    out[j] = answer
                waiting, postings = [], 0
        return out

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        size, count = len(queries), len(self.dense)
        width = count * BLOCK
        text = np.repeat(np.arange(size), [len(t) for t, _ in queries])
        term = np.concatenate([t for t, _ in queries])
        mine = np.concatenate([self.vector(t, c) for t, c in queries])
        row = self.rows[term]
        full, rest = row >= 0, row < 0
        common = np.zeros((size, self.tops.shape[0]))
        common[text[full], row[full]] = mine[full]
        spans = self.cells[term[rest] + 1] - self.cells[term[rest]]
        at = self._ranges(self.cells[term[rest]], self.cells[term[rest] + 1])
        text, mine, block = np.repeat(text[rest], spans), np.repeat(mine[rest], spans), self.blocks[at]
        bounds = common @ self.tops + np.bincount(text * count + block, mine * self.maxima[at], size * count).reshape(size, count)
        cosine = np.zeros((size, width))

        def look(opened: np.ndarray) -> np.ndarray:
            """Cosines of the opened blocks are added up; the k-th best of each text, 0 with fewer."""
            for b in range(count):
                who = np.nonzero(opened[:, b])[0]
                if len(who):
                    cosine[who, b * BLOCK : (b + 1) * BLOCK] = common[who] @ self.dense[b]
            chosen = opened[text, block]
            cells = at[chosen]
            long = self.firsts[cells + 1] - self.firsts[cells]
            postings = self._ranges(self.firsts[cells], self.firsts[cells + 1])
            places = np.repeat(text[chosen] * width, long) + self.examples[postings]
            cosine[:] += np.bincount(places, np.repeat(mine[chosen], long) * self.weights[postings], size * width).reshape(size, width)
            np.round(cosine, 12, out=cosine)
            for i, at_ in enumerate(without):
                if at_ >= 0:
                    cosine[i, at_] = 0
            return np.partition(cosine, -self.k, axis=1)[:, -self.k] if width > self.k else np.zeros(size)

        # first the blocks of the highest bounds, then all whose bound reaches what these gave
        few = min(FIRST_BLOCKS, count)
        opened = bounds >= np.partition(bounds, -few, axis=1)[:, -few][:, None]
        least = look(opened & (bounds > 0))
        least = look(~opened & (bounds > 0) & (bounds >= least[:, None] - 1e-9))
        out = []
        for i in range(size):
            found = np.nonzero((cosine[i] > 0) & (cosine[i] >= least[i]))[0]
            order = np.lexsort((self.ids[found], -cosine[i, found]))[: self.k]
            out.append((found[order], cosine[i, found[order]]))
        return out

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (0.3 + 1 - cosine)
        return float((weight * self.labels[at]).sum() / weight.sum())

    def score(self, at: np.ndarray, cosine: np.ndarray) -> float:
        return float(np.interp(self.vote(at, cosine), self.votes, self.scores)) if len(at) else self.base_score


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares by a rising step function: its corners, by pooling adjacent violators."""
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for value in np.unique(x):
        at = x == value
        pools.append([float(np.average(y[at], weights=w[at])), float(w[at].sum()), value, value])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    corners = [(p[i], p[0]) for p in pools for i in ((2, 3) if p[2] < p[3] else (2,))]
    return np.array([c[0] for c in corners]), np.array([c[1] for c in corners])


def _terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(d, t, terms, counts): the vocabulary terms of every text, by number; t is the text's hash."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in batches:
            terms, counts = [], []
            for text in batch.column(2):
                found = words(text.as_py())
                shared = sorted(number[w] for w in known & set(found))
                total = Counter(found) if shared else {}
                terms.append(shared)
                counts.append([total[vocabulary[i]] for i in shared])
            arrays = [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["d", "t", "terms", "counts"])

    columns = [F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string")]
    return docs.select(*columns).mapInArrow(run, "d long, t long, terms array<int>, counts array<int>")


def _document_counts(featured: DataFrame, terms: int) -> DataFrame:
    """(term, n): documents with each term of the vocabulary, counted in every task before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=terms)[:terms]
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    return featured.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _sample(labels: DataFrame, learn: Column, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of the examples, and the number of labelled documents by label."""
    known = (
        labels.filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    )
    known = stage(known, "labels")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # the hash below which there are max_examples of a label, first to its bucket of 1/4096, then inside that bucket alone
    placed = known.withColumn("h", F.xxhash64("id")).withColumn("bucket", F.shiftright("h", 52))
    limits = {}
    sizes = placed.groupBy("label", "bucket").agg(F.count("*").alias("n")).collect()  # at most 4096 a label
    for label in shares:
        before = 0
        for bucket, n in sorted((r["bucket"], r["n"]) for r in sizes if r["label"] == label):
            if before + n >= max_examples:
                inside = placed.filter((F.col("label") == label) & (F.col("bucket") == bucket))
                limits[label] = inside.orderBy("h", "id").limit(max_examples - before).agg(F.max("h")).first()[0]
                break
            before += n
    chosen = F.lit(False)
    for label in shares:
        chosen = chosen | ((F.col("label") == label) & (F.col("h") <= limits[label] if label in limits else F.lit(True)))
    return placed.filter(chosen).select("id", "label"), shares


def _vocabulary(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the examples, and how far each depends on the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, y) for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for w in set(words(text.as_py()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], ["term", "label"],
            )

    size = texts.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = size["n"], size["toxic"] or 0
    if not 0 < toxic < n:
        return [], np.zeros(0)
    seen = texts.select("label", "text").mapInArrow(run, "term string, label int").groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("m"))
    # as many rows as the examples have words
    rows = seen.orderBy("term").collect()
    a, m = (np.array([r[c] for r in rows], float) for c in ("a", "m"))
    # the rates of the word in both labels, and how many standard errors lie between them
    p, q = (a + 0.5) / (toxic + 1), (m - a + 0.5) / (n - toxic + 1)
    error = np.sqrt(p * (1 - p) / (toxic + 1) + q * (1 - q) / (n - toxic + 1))
    sure = np.abs(p - q) / error
    purity = np.abs(p - q) / (p + q)
    return [r["term"] for r in rows], LEAST + (1 - LEAST) * purity * sure**4 / (sure**4 + 81)


def score(docs: DataFrame, labels: DataFrame, learn: Column, k: int = 15, max_examples: int = 1500) -> DataFrame:
    """(d, t, score, evidence) of every row: doc_id, text hash, probability, nearest examples (id, cosine, label).

    ``learn`` is a condition on the columns of ``labels`` that says which labels may be learned from.
    """
    spark = docs.sparkSession
    chosen, shares = _sample(labels, learn, max_examples)
    examples = docs.select(F.col("doc_id").cast("long").alias("x"), "text").join(F.broadcast(chosen), F.col("x") == F.col("id"))
    texts = stage(examples.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")), "examples")
    vocabulary, depends = _vocabulary(texts)
    featured = stage_texts(_terms(docs, vocabulary), "terms")
    size = featured.count()
    seen = {r["term"]: r["n"] for r in _document_counts(featured, len(vocabulary)).collect()}
    idf = np.array([np.log((1 + size) / (1 + seen.get(i, 0))) + 1 for i in range(len(vocabulary))]) * depends
    rows = _terms(texts.select(F.col("id").alias("doc_id"), "text"), vocabulary).join(texts.select("id", "label"), F.col("d") == F.col("id"))
    shared = spark.sparkContext.broadcast(_fit(rows.select("id", "label", "terms", "counts").orderBy("id").collect(), idf, shares, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        answers: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            if len(answers) >= _KEPT_ANSWERS:
                answers.clear()
            keys, new = [], {}
            ends = np.asarray(batch.column(2).offsets)
            terms, counts = (np.asarray(batch.column(c).values) for c in (2, 3))
            for start, end in zip(ends, ends[1:], strict=False):
                key = terms[start:end].tobytes() + counts[start:end].tobytes()
                keys.append(key)
                if key not in answers:
                    new[key] = (terms[start:end].astype(np.int64), counts[start:end].astype(float))
            for key, (at, cosine) in zip(new, index.nearest(list(new.values())), strict=True):
                near = [(int(index.ids[i]), float(c), int(index.labels[i])) for i, c in zip(at, cosine, strict=True)]
                answers[key] = (index.score(at, cosine), [{"id": i, "cosine": c, "label": y} for i, c, y in near])
            out = [answers[key] for key in keys]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)],
                ["d", "t", "score", "evidence"],
            )

    return featured.mapInArrow(run, "d long, t long, score double, evidence array<struct<id: long, cosine: double, label: int>>")


def _alike_together(rows: list, terms: int) -> list:
    """Examples in the order of their most common words, so that a block holds texts of one language or kind and its maxima tell it from others."""
    known = np.bincount(np.concatenate([np.array(r["terms"], np.int64) for r in rows]), minlength=terms) if rows else np.zeros(0)
    return sorted(rows, key=lambda r: (sorted(r["terms"], key=lambda t: (-known[t], t))[:8], r["id"]))


def _fit(rows: list, idf: np.ndarray, shares: dict[int, int], k: int) -> Index:
    """The index over the collected examples, calibrated by leaving one out."""
    rows = _alike_together(rows, len(idf))
    labels = np.array([r["label"] for r in rows], np.int64)
    index = Index(np.array([r["id"] for r in rows], np.int64), labels, idf, k, float(labels.mean()) if len(rows) else 0.0)
    if not len(rows) or labels.min() == labels.max():
        return index
    vectors = [(np.array(r["terms"], np.int64), np.array(r["counts"], float)) for r in rows]
    index.build(vectors)
    weight = np.array([shares[y] / (labels == y).sum() for y in (0, 1)])[labels]
    votes, bare = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
    for i, (at, cosine) in enumerate(index.nearest(vectors, without=list(range(len(vectors))))):
        bare[i] = not len(at)
        if len(at):
            votes[i] = index.vote(at, cosine)
    index.base_score = float((weight * labels)[bare].sum() / max(weight[bare].sum(), 1e-12))
    index.votes, index.scores = isotonic(votes[~bare], labels[~bare], weight[~bare]) if (~bare).any() else (np.zeros(1), np.array([index.base_score]))
    return index


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all columns as they are."""
    scored = stage(score(docs, labels, learn).filter(F.col("score") >= threshold).select("d", "t"), "rejected")
    d, t = unused(docs, "d", "t")
    bad = scored.select(F.col("d").alias(d), F.col("t").alias(t))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    # always a merge join: rejections grow with the corpus, so a broadcast would only suit small inputs
    return docs.join(bad.hint("merge"), same, "left_anti")

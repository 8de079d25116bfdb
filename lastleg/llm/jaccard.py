"""Near-dedup by the Jaccard similarity of word shingles: SimHash fingerprints, then MinHash buckets, every link checked exactly.

A text is the set of its word shingles. The first candidates are those of the SimHash operator: texts whose fingerprints differ in
``RADIUS`` bits or fewer, by its covering masks. At a similarity of 0.8 fingerprints differ by more, so candidates are also texts that agree in all ``ROWS`` minima of one of ``BANDS``
bands: a pair of similarity s is found with probability 1 - (1 - s^ROWS)^BANDS, 0.99994 at 0.8 and more above.
A candidate links only if its exact similarity reaches the threshold, so a link never rests on hashes of minima alone.

The two texts of a bucket of two are compared. A larger bucket gets a centre: the text that meets most others over all
its buckets, which is the original where a bucket holds its copies. All texts of the bucket are compared with the
centre, and what links becomes one class. No task holds a bucket.

Pairs of a larger bucket that are in different classes still are found through what tells their texts from the centre. Let D(x) be the
shingles that just one of x and the centre c has, and k = (1 - t) / (1 + t) for the threshold t. x and y are alike just if they differ in at
most k(|x| + |y|) shingles, and they differ in |D(x)| + |D(y)| less twice what D(x) and D(y) share. So if x is not alike to c, a y
that is alike to x shares o shingles of D(x) and D(y) with it or more:

    2 o = beyond(x) + reach(y),   beyond(x) = |D(x)| - k(|x| + |c|) > 0,   reach(y) = |D(y)| + k(|c| - |y|)

Two sets that share o elements share one among the |D| - o + 1 rarest of each, in one order of all. Only texts with such a rare shingle
in common are compared, and of these only those whose bitmaps of D don't differ in more bits than the texts may in shingles. Copies that were changed each in its own places have none, so a group of them costs its size; copies of a changed copy
do, and are found. Nothing is lost by it: the argument holds for every pair.

Defined cases: null and empty texts have no shingles and are alike; texts shorter than a shingle are one shingle;
exact copies (equal in two 64-bit hashes) are one node of the graph; rows without doc_id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.llm import simhash
from lastleg.llm.common import stage_texts, unused
from lastleg.llm.graph import connected_components
from lastleg.session import stage

BANDS, ROWS = 32, 6
RADIUS = 4  # bits in which the fingerprints of candidates may differ
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 12  # shingles whose minima are taken at once


def shingles(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of one text, ascending."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
    return factors | np.uint64(1), shifts


def band_keys(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    """One signed key for each band: the hash of its minima."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = (hashes[at: at + _CHUNK][None, :] ^ shifts[:, None]) * factors[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    minima = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), SEED) for m in minima], "<u8").view("<i8").tolist()


def _text_hashes() -> list:
    """Two independent hashes of a text."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(h1, h2, n, keys, fp) of every row: text hashes, number of shingles, band keys, SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations()
        for batch in batches:
            sizes, keys, prints = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), shingle_words)
                sizes.append(len(found))
                keys.append(band_keys(found, factors, shifts))
                prints.append(simhash.text_fingerprint(text.as_py(), shingle_words))
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            arrays.append(pa.array(np.array(prints, "<u8").view("<i8")))
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "n", "keys", "fp"])

    return docs.select(*_text_hashes(), F.col("text").cast("string")).mapInArrow(run, "h1 long, h2 long, n long, keys array<long>, fp long")


def _shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(k, s): node and shingle hashes of every row of (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle_words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["k", "s"])

    return texts.select("k", "text").mapInArrow(run, "k long, s array<long>")


def _once_a_task(texts: DataFrame) -> DataFrame:
    """(h1, h2, text) without what a task has seen before, so that a hot text passes on once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [p not in seen and not seen.add(p) for p in pairs]
            yield batch.filter(pa.array(new, pa.bool_()))

    return texts.mapInArrow(run, "h1 long, h2 long, text string")


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): each text with the first of its fingerprint, and the stars of first texts whose fingerprints are near."""
    first = stage(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    firsts = first.select(F.col("fp").alias("known"), F.col("node").alias("a"))
    same = nodes.select("fp", F.col("node").alias("b")).join(firsts.hint("merge"), F.col("fp") == F.col("known")).filter("a <> b").select("a", "b")
    stars = simhash.covering_edges(first, RADIUS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stage(same.unionByName(stars).distinct(), "near_prints")


def _twos(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the two texts of each bucket of two whose sizes allow the threshold."""
    text = F.struct("node", "n")
    both = members.filter("m = 2").groupBy("table", "key").agg(F.min(text).alias("a"), F.max(text).alias("b"))
    fits = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    return stage(both.filter(fits).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are alike."""
    left = sets.select(F.col("k").alias("a"), F.col("s").alias("x")).hint("merge")
    right = sets.select(F.col("k").alias("b"), F.col("s").alias("y")).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= threshold * (F.size("x") + F.size("y") - both)
    return stage(pairs.join(right, "b").join(left, "a").filter(alike).select("a", "b"), "links")


def _spokes(large: DataFrame) -> DataFrame:
    """(c, x): every text of a bucket of three or more with the centre of the bucket."""
    score = large.groupBy(F.col("node").alias("k")).agg(F.sum("m").alias("score"))
    scored = large.join(score.hint("merge"), F.col("node") == F.col("k"))
    centres = stage(scored.groupBy("table", "key").agg(F.max(F.struct("score", (-F.col("node")).alias("c"))).alias("best")), "centres")
    met = large.join(centres.hint("merge"), ["table", "key"]).select((-F.col("best.c")).alias("c"), F.col("node").alias("x"))
    return stage(met.filter("c <> x").distinct(), "spokes")


def _deltas(spokes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(c, x, nc, nx, delta, alike): what tells each text from its centre, and whether they are alike."""
    left = sets.select(F.col("k").alias("c"), F.col("s").alias("p")).hint("merge")
    right = sets.select(F.col("k").alias("x"), F.col("s").alias("q")).hint("merge")
    delta = F.concat(F.array_except("q", "p"), F.array_except("p", "q"))
    found = spokes.join(right, "x").join(left, "c").select("c", "x", F.size("p").alias("nc"), F.size("q").alias("nx"), delta.alias("delta"))
    size = F.col("nc") + F.col("nx")
    return stage(found.withColumn("alike", size - F.size("delta") >= threshold * (size + F.size("delta"))), "deltas")


def _bitmap(tokens: Column) -> Column:
    """Eight longs with a bit for each token. Two sets differ in at least as many tokens as their bitmaps differ in bits."""
    powers = F.array(*[F.lit(-(2**63) if i == 63 else 2**i) for i in range(64)])

    def word(i: int) -> Column:
        mine = F.filter(tokens, lambda x: x.bitwiseAND(F.lit(7)) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.element_at(powers, (F.shiftright(x, 3).bitwiseAND(F.lit(63)) + 1).cast("int"))))
    return F.array(*[word(i) for i in range(8)])


def _rare_pairs(deltas: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): texts of different classes with a rare shingle of their deltas in common, one of them not alike to their centre."""
    k = (1 - threshold) / (1 + threshold)
    open_centres = deltas.filter("NOT alike").select("c").distinct()
    known = classes.select(F.col("node").alias("w"), F.col("component").alias("class"))
    d, nx, nc = F.size("delta"), F.col("nx"), F.col("nc")
    members = deltas.join(open_centres.hint("merge"), "c", "left_semi").join(known.hint("merge"), F.col("x") == F.col("w"), "left").select(
        "c", "x", F.coalesce("class", "x").alias("class"), "alike", "nx", d.alias("d"), (d - (nx + nc) * k).alias("beyond"),
        (d + (nc - nx) * k).alias("reach"), _bitmap(F.col("delta")).alias("bits"), "delta",
    )
    members = stage(members, "delta_members")
    spread = members.select("c", "x", "class", "d", "beyond", "reach", F.explode("delta").alias("token"))
    counts = spread.groupBy("c", "token").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    ranked = spread.join(stage(counts, "token_counts").hint("merge"), ["c", "token"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("c", "x").orderBy("n", "token")),
    )
    # x and y share (beyond(x) + reach(y)) / 2 or more; the places they share one at leave as many behind. Rounding gets some slack.
    left = F.lit(2) * (F.col("d") + 1 - F.col("rank")) + 1e-6
    ranked = ranked.withColumns({"as_x": left - F.col("beyond"), "as_y": left - F.col("reach")})
    # a shingle that one class alone has joins nothing
    rare = stage(ranked.filter("low <> high").select("c", "token", "x", "class", "beyond", "reach", "as_x", "as_y"), "rare_tokens")
    far = members.select(F.col("c").alias("fc"), F.col("x").alias("fx"), "nx", "bits")
    x = rare.filter("beyond > -1e-6 AND as_x >= 0").select("c", "token", "x", "class", "beyond", "as_x")
    y = rare.filter("as_y >= -1e-6").select("c", "token", F.col("x").alias("y"), F.col("class").alias("other"), "reach", "as_y")
    x = x.join(far.hint("merge"), (F.col("c") == F.col("fc")) & (F.col("x") == F.col("fx"))).select(x["*"], "nx", "bits")
    y = y.join(far.hint("merge"), (F.col("c") == F.col("fc")) & (F.col("y") == F.col("fx"))).select(y["*"], F.col("nx").alias("ny"), F.col("bits").alias("others"))
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("others")[i])) for i in range(8)), F.lit(0))
    near = (F.col("class") != F.col("other")) & (F.col("reach") <= F.col("as_x")) & (F.col("beyond") <= F.col("as_y"))
    met = x.alias("l").join(
        y.alias("r"), (F.col("l.c") == F.col("r.c")) & (F.col("l.token") == F.col("r.token")) & near & (differ <= (F.col("nx") + F.col("ny")) * k + 1e-6),
    )
    return stage(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "rare_pairs")


def near_links(docs: DataFrame, shingle_words: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """The distinct texts (node, h1, h2), and (node, component) of those that are alike to others; None if there are none."""
    rows = stage_texts(signatures(docs, shingle_words), "signatures")
    distinct = rows.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_texts")
    texts = nodes.select("node", "h1", "h2")
    buckets = nodes.select("node", "n", F.posexplode("keys").alias("table", "key"))
    shared = buckets.groupBy("table", "key").agg(F.count("*").alias("m")).filter("m > 1")
    members = stage(buckets.join(shared.hint("merge"), ["table", "key"]).select("table", "key", "node", "n", "m"), "buckets")
    near = _near_prints(nodes.select("node", "fp"))
    pairs = _twos(members, threshold).unionByName(near).distinct()
    spokes = _spokes(members.filter("m > 2"))
    ends = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    if not ends.take(1):
        return texts, None
    ends = texts.join(ends.hint("merge"), "node").select(F.col("node").alias("k"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    found = _once_a_task(docs.select(*_text_hashes(), F.col("text").cast("string").alias("text")))
    found = found.join(ends.hint("merge"), (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))).groupBy("k").agg(F.first("text").alias("text"))
    sets = stage_texts(_shingle_sets(found, shingle_words), "shingle_sets")
    links = _compared(pairs, sets, threshold)
    deltas = _deltas(spokes, sets, threshold)
    links = links.unionByName(deltas.filter("alike").select(F.col("c").alias("a"), F.col("x").alias("b")))
    classes = stage(connected_components(links, "a", "b"), "classes")
    rest = _rare_pairs(deltas, classes, threshold)
    if rest.take(1):
        classes = stage(connected_components(links.unionByName(_compared(rest, sets, threshold)), "a", "b"), "classes")
    return texts, classes


def keep_one(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by doc_id (null last) and text hash; all columns as they are.

    A kept row that is repeated stays repeated.
    """
    texts, classes = near_links(docs.select("text"), shingle_words, threshold)
    if classes is not None:
        known = classes.select(F.col("node").alias("k"), "component")
        texts = texts.join(known.hint("merge"), F.col("node") == F.col("k"), "left").select("h1", "h2", F.coalesce("component", "node").alias("class"))
    else:
        texts = texts.select("h1", "h2", F.col("node").alias("class"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").cast("long").alias("d"), *_text_hashes())
    rows = docs.select(place.alias("place")).distinct().select("place", "place.h1", "place.h2")
    rows = stage(rows.join(texts.hint("merge"), ["h1", "h2"]).select("place", "class"), "places")
    first = stage(rows.groupBy(F.col("class").alias("c")).agg(F.min("place").alias("first")), "first_places")
    behind = rows.join(first, F.col("class") == F.col("c")).filter(F.col("place") != F.col("first"))
    names = unused(docs, "d", "t", "u")
    behind = behind.select(*[F.col(f"place.{c}").alias(n) for c, n in zip(("d", "h1", "h2"), names, strict=True)])
    # always a merge join: copies grow with the corpus, so a broadcast would only suit small inputs
    t, u = _text_hashes()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (t == F.col(names[1])) & (u == F.col(names[2]))
    return docs.join(behind.hint("merge"), same, "left_anti")

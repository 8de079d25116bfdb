"""Fill-in-the-middle transformation, cut at line ends that a learned rank index finds.

A text consists of n lines, each with its line feed, and so has n + 1 boundaries. ``RankIndex`` stores their offsets, in code points, as
line segments over the rank: a segment goes on while one slope from its first boundary passes within ``error`` code points of
every boundary. What a segment's line misses is stored as a small residual for each boundary, so a looked-up offset is the
prediction plus the residual, exactly. A regular text needs few segments, one with lines of all lengths more.

Two ranks cut a text in prefix, middle and suffix. They come from the sha256 of ``seed`` and doc_id, as do the choice between plain
text and cut text and that between the orders: psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm ``<S>`` suffix ``<P>`` prefix ``<M>``
middle. A text that holds a marker stays plain, so ``restore`` rebuilds every text from output and form.

Rows are independent: texts go to Python in Arrow batches, nothing is shuffled, and a task holds one batch.

Defined cases: a null text counts as empty; empty texts stay plain with n = 0; a null doc_id counts as an empty string in the
hash; rows that repeat are cut alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
ERROR = 64
_STEP = 64  # boundaries looked at first when a segment is drawn out


@dataclass
class RankIndex:
    """Ascending offsets by rank: segments (first rank, first offset, slope), and what they miss."""

    first: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Each segment is drawn out as far as some slope keeps all its boundaries within ``error``."""
        first, start, slope = [], [], []
        at, n = 0, len(offsets)
        while at < n:
            low, high, end, step = -np.inf, np.inf, at + 1, _STEP
            while end < n:
                stop = min(n, end + step)
                run = np.arange(end - at, stop - at)
                rise = offsets[end:stop] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                apart = np.nonzero(lows > highs)[0]
                good = int(apart[0]) if len(apart) else stop - end
                if good:
                    low, high = lows[good - 1], highs[good - 1]
                end += good
                if len(apart):
                    break
                step *= 2
            first.append(at)
            start.append(int(offsets[at]))
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        index = cls(np.array(first, np.int64), np.array(start, np.int64), np.array(slope, float), np.zeros(0, np.int8))
        missed = offsets - index.predict(np.arange(n))
        index.residual = missed.astype(np.min_scalar_type(-int(np.abs(missed).max(initial=0)) - 1))
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return self.start[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries of these ranks."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(text: str) -> np.ndarray:
    """Offsets of all line boundaries in code points, from 0 to the length; just 0 for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.nonzero(points == 10)[0] + 1
    if len(points) and (not len(ends) or ends[-1] != len(points)):
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends]).astype(np.int64)


def index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """(doc_id, n, first, start, slope, residual): the rank index of every text, for cutting it again without a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [RankIndex.fit(boundaries(t.as_py() or ""), error) for t in batch.column(1)]
            kind = pa.list_(pa.int64())
            arrays = [
                batch.column(0), pa.array([len(i.residual) - 1 for i in made], pa.int64()), pa.array([i.first for i in made], kind),
                pa.array([i.start for i in made], kind), pa.array([i.slope for i in made], pa.list_(pa.float64())),
                pa.array([i.residual.astype(np.int32) for i in made], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "first", "start", "slope", "residual"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n long, first array<long>, start array<long>, slope array<double>, residual array<int>")


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, error: int = ERROR) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``percent`` of the texts are cut, ``spm_percent`` of these in the order spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.column_stack([np.asarray(batch.column(i)) for i in range(2, 6)])
            rows = [_cut(t.as_py() or "", d, percent, spm_percent, error) for t, d in zip(batch.column(1), draws, strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *h)
    return chosen.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _cut(text: str, draws: np.ndarray, percent: int, spm_percent: int, error: int) -> tuple:
    found = RankIndex.fit(boundaries(text), error)
    n = len(found.residual) - 1
    if not text or draws[2] % 100 >= percent or any(marker in text for marker in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    a, b = found.locate(np.sort(draws[:2] % (n + 1))).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_percent:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No marker can arise where a piece meets a marker, as markers hold ``<`` only in front."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == PSM, F.concat(part[1], part[3], part[2]))
        .when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)
    )

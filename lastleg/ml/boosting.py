"""Gradient-boosted trees for two classes, grown from histograms of first and second derivatives.

Features are binned once, at quantiles of their distinct values. Each partition keeps its binned rows as one small matrix. A level
of a tree is one job: every partition adds up gradients and hessians by (node, feature, bin), for the lighter child of every pair of siblings,
and ``treeReduce`` adds the partitions; the other child is its parent less its sibling. The driver sees
histograms, at most nodes x features x bins numbers, and finds the splits. Leaf values come from the sums that the last split already has, so
a tree of depth d takes d jobs. Margins stay with the rows: a partition keeps them next to its matrix, and the first job of a tree adds the tree before.
A bounded number of rows is one partition, whose task grows all trees; there, features of few bins that mostly determine each other are added up as one.

The split gain and the leaf value are those of second order, G^2 / (H + lambda) and -G / (H + lambda); a child needs a sum of hessians of
``min_child_weight``; each tree sees a draw of the rows and of the features.

A model is plain arrays, a node a row. It is scored by a column expression whose batches walk all trees at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from lastleg.session import enable_checkpoints, find_package

MOST_BINS = 256
# A job of many small tasks spends its time on starting them and on adding up their histograms: more rows make larger
# partitions, one a core, until a partition has this many.
MOST_ROWS = 1_000_000
# A tree over this many rows (some 90 MB) takes one task as long as starting the six jobs of its levels, and leaves the other cores
# to the other models: so many rows are one partition, whose task grows all trees in one job.
ALONE_ROWS = 2_500_000
_CHUNK = 20_000  # rows binned at once, so that a large partition is never held unbinned
STEP_ROWS = 32_768  # rows whose sums are added up at once: what a step makes stays in the cache of a core
PACK_BINS = 2048  # values that features added up as one may have together
# Blocks are bytes already: the other levels would write and compress them once more at every tree, and undo it at every level.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
CHECKPOINT_TREES = 25  # margins are checkpointed so often, which bounds their lineage and the work after a lost executor


@dataclass
class Boosted:
    """Trees as arrays by node: feature (-1 at a leaf), threshold, gain, value; children of node i are 2i + 1 and 2i + 2."""

    features: list[str]
    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    extra: dict = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees for each row of ``x``."""
        return self.base + walk_sums(x, self.feature, self.threshold, self.value)

    def probability(self, **given: Column) -> Column:
        """The probability of class 1 as a column, from columns named like the features or those given for them."""
        model = self
        score = row_function(lambda x: 1 / (1 + np.exp(-model.margins(x))))
        return score(*[given.get(c, F.col(c)) for c in self.features])

    def importances(self) -> np.ndarray:
        """Mean gain of each feature's splits, as a share of all features' (zero for one that is never used)."""
        used = self.feature >= 0
        gain = np.bincount(self.feature[used], self.gain[used], len(self.features))
        count = np.bincount(self.feature[used], minlength=len(self.features))
        mean = gain / np.maximum(count, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean


def row_function(answer: Callable[[np.ndarray], np.ndarray]) -> Callable[..., Column]:
    """A function over double columns that is computed from batches of rows, one row of a matrix each."""

    def score(batches):
        for columns in batches:
            single = isinstance(columns, pd.Series)
            yield pd.Series(answer(np.column_stack([c.to_numpy(float) for c in ((columns,) if single else columns)])))

    # the string form of the hints would be looked up where they don't exist
    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def walk_sums(x: np.ndarray, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values that each row of ``x`` reaches in all trees."""
    depth = (features.shape[1] + 1).bit_length() - 2
    total, lines, rows = np.zeros(len(x)), np.ascontiguousarray(x.T), np.arange(len(x))
    for feature, threshold, value in zip(features, thresholds, values, strict=True):
        total += value.take(_walk(lines, rows, feature, threshold, depth))
    return total


def bin_edges(df: DataFrame, features: list[str], bins: int = MOST_BINS) -> list[np.ndarray]:
    """Ascending cut points of each feature, at its quantiles: a value's bin is the number of cuts below it."""
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(
        *[F.approx_percentile(c, steps, F.lit(20 * bins)).alias(f"q{i}") for i, c in enumerate(features)],
        *[F.max(c).alias(f"m{i}") for i, c in enumerate(features)],
    ).first()
    edges = []
    for i in range(len(features)):
        cuts = np.unique(np.array(row[f"q{i}"] or [], float))
        edges.append(cuts[cuts < row[f"m{i}"]] if len(cuts) else cuts)
    return edges


def _blocks(df: DataFrame, features: list[str], label: str, key: str, edges: list[np.ndarray], partitions: int, kind: type = np.uint8) -> RDD:
    """(binned rows as one line a feature, labels of a ``kind`` of number, draws) of every partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, labels, draws = [np.empty((len(edges), 0), np.uint8)], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                *columns, y, draw = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, _CHUNK).columns)
                lines.append(np.stack([np.searchsorted(e, x, side="left").astype(np.uint8) for e, x in zip(edges, columns, strict=True)]))
                labels.append(y.astype(kind).tobytes())
                draws.append(draw.astype(np.uint32).tobytes())
        parts = (np.concatenate(lines, axis=1).tobytes(), b"".join(labels), b"".join(draws))
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["binned", "y", "draws"])

    def block(row: tuple) -> tuple:
        return np.frombuffer(row[0], np.uint8).reshape(len(edges), -1), np.frombuffer(row[1], kind), np.frombuffer(row[2], np.uint32)

    def joined(blocks: Iterator[tuple]) -> list[tuple]:
        parts = list(blocks)
        return [(np.concatenate([p[0] for p in parts], axis=1), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)))]

    chosen = df.select(*[F.col(c).cast("double") for c in (*features, label)], F.pmod(F.xxhash64(key), F.lit(2**31)).alias("draw"))
    if partitions > 1:
        # dealt by the key's hash, so partitions are alike and a row's draws don't depend on where it was read
        chosen = chosen.repartition(partitions, "draw")
    blocks = chosen.mapInArrow(pack, "binned binary, y binary, draws binary").rdd.map(block)
    # rows of the only partition are binned where they are read: small matrices travel
    return blocks if partitions > 1 else blocks.repartition(1).mapPartitions(joined)


def _drawn(draws: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a hash of the row's draw and the tree, alike on every attempt of a task."""
    x = draws.astype(np.uint64) + np.uint64(((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(40)) < np.uint64(np.ceil(share * 2**24))


def _walk(binned: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, start: np.ndarray | None = None) -> np.ndarray:
    """The nodes that the given rows of a matrix, one line a feature, reach, from the root or the nodes that they start at."""
    node = np.zeros(len(rows), np.int64) if start is None else start
    lines, length = binned.reshape(-1), binned.shape[1]
    inner = feature >= 0
    line = np.where(inner, feature, 0).astype(np.int64) * length
    # a leaf is its own left child, and nothing is above its cut
    left, above = np.where(inner, 2 * np.arange(len(feature)) + 1, np.arange(len(feature))), np.where(inner, cut, np.inf)
    if binned.dtype == np.uint8:
        above = np.minimum(above, 255).astype(np.uint8)
    for _ in range(levels):
        right = lines.take(line.take(node) + rows) > above.take(node)
        node = left.take(node) + right
    return node


def _with_tree(block: tuple, tree: tuple, depth: int) -> tuple:
    feature, cut, _, value = tree
    binned, y, draws, margins = block
    return binned, y, draws, margins + value[_walk(binned, np.arange(len(y)), feature, cut, depth)]


@dataclass
class Grower:
    """How a tree grows, level by level, from histograms that the caller adds up."""

    depth: int
    rate: float
    penalty: float
    min_child_weight: float
    row_share: float
    seed: int
    bins: list[int]  # of each feature

    def sums(self, block: tuple, level: dict) -> np.ndarray:
        """(nodes, bins of all features, 2): gradients and hessians of one partition for the nodes asked for."""
        binned, y, draws, margins = block
        packs = [(binned[f], self.bins[f]) for f in level["chosen"]]
        added = self._zeros(packs, level)
        for at in range(0, len(y), STEP_ROWS):
            rows = at + np.nonzero(_drawn(draws[at : at + STEP_ROWS], level["number"], self.seed, self.row_share))[0]
            node = _walk(binned, rows, level["feature"], level["cut"], level["level"])
            asked, place = self._asked(node, level)
            rows = rows.take(asked)
            self._add_up(added, packs, rows, place, _derivatives(margins.take(rows), y.take(rows)))
        return np.concatenate([x.reshape(2, len(level["nodes"]), -1).transpose(1, 2, 0) for x in added], axis=1)

    def _asked(self, node: np.ndarray, level: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are in the nodes asked for, and the place of their node among these."""
        place = np.full(2 ** (self.depth + 1), -1)
        place[level["nodes"]] = np.arange(len(level["nodes"]))
        at = place.take(node)
        asked = np.nonzero(at >= 0)[0]
        return asked, at.take(asked)

    @staticmethod
    def _zeros(packs: list[tuple], level: dict) -> list[np.ndarray]:
        return [np.zeros((2, len(level["nodes"]) * width)) for _, width, *_ in packs]

    @staticmethod
    def _add_up(added: list[np.ndarray], packs: list[tuple], rows: np.ndarray, place: np.ndarray, weights: tuple) -> None:
        """Add the rows' weights to the cells of their nodes and of the values that each pack has for them."""
        for (line, width, *_), total in zip(packs, added, strict=True):
            cell = place * width
            cell += line.take(rows)
            for x, weight in zip(total, weights, strict=True):
                x += np.bincount(cell, weight, len(x))

    def spread(self, sums: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """(nodes, features, bins, 2), with zeros beyond the bins that a feature has. Only what it has is sent to the driver."""
        out, first = np.zeros((len(sums), len(chosen), max(self.bins), 2)), 0
        for j, f in enumerate(chosen):
            out[:, j, : self.bins[f]] = sums[:, first : first + self.bins[f]]
            first += self.bins[f]
        return out

    def grow(self, number: int, chosen: np.ndarray, total: Callable[[dict], np.ndarray]) -> tuple:
        """(feature, cut, gain, value) by node of a tree; ``total`` gives the histograms of a level."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut = np.full(size, -1), np.zeros(size, np.int64)
        gain, value = np.zeros(size), np.zeros(size)
        nodes, asked, known = [0], [0], {}
        for level in range(self.depth):
            wanted = {"number": number, "level": level, "feature": feature, "cut": cut, "nodes": np.array(asked), "chosen": chosen}
            sums = dict(zip(asked, self.spread(total(wanted), chosen), strict=True))
            for n in nodes:
                if n not in sums:
                    sums[n] = known[(n - 1) // 2] - sums[n + 1 if n % 2 else n - 1]
            found = {n: split for n in nodes if (split := _best_split(sums[n], self.penalty, self.min_child_weight))}
            for n, (worth, j, at, left, right) in found.items():
                feature[n], cut[n], gain[n] = chosen[j], at, worth
                value[2 * n + 1], value[2 * n + 2] = (-self.rate * s[0] / (s[1] + self.penalty) for s in (left, right))
            # of two siblings only the one with the lesser sum of hessians is added up
            asked = [2 * n + 1 + int(right[1] < left[1]) for n, (*_, left, right) in found.items()]
            nodes, known = [c for n in found for c in (2 * n + 1, 2 * n + 2)], sums
            if not nodes:
                break
        return feature, cut, gain, value

    def alone(self, block: tuple, drawn: list[np.ndarray]) -> list[tuple]:
        """All trees over the only partition there is. The rows a tree sees move on by one level at a time, a step of them after the other."""
        binned, y, draws, margins = block
        packed, done = _packs(binned, self.bins), []
        margins = margins.copy()
        for number, chosen in enumerate(drawn):
            sees = np.concatenate([_drawn(draws[at : at + STEP_ROWS], number, self.seed, self.row_share) for at in range(0, max(1, len(y)), STEP_ROWS)])
            seen, unseen = np.nonzero(sees)[0], np.nonzero(~sees)[0]
            weights = _derivatives(margins.take(seen), y.take(seen))
            node = np.zeros(len(seen), np.int64)
            places = {f: j for j, f in enumerate(chosen)}
            packs = [(line, width, held) for line, width, values in packed if (held := {f: v for f, v in values.items() if f in places})]

            def total(level: dict) -> np.ndarray:
                added = self._zeros(packs, level)  # noqa: B023
                for at in range(0, len(seen), STEP_ROWS):  # noqa: B023
                    step = slice(at, at + STEP_ROWS)
                    rows = seen[step]  # noqa: B023
                    if level["level"]:
                        node[step] = _walk(binned, rows, level["feature"], level["cut"], 1, node[step])  # noqa: B023
                    asked, place = self._asked(node[step], level)  # noqa: B023
                    self._add_up(added, packs, rows.take(asked), place, tuple(w[step].take(asked) for w in weights))  # noqa: B023
                return self._unpacked(added, packs, chosen, level)  # noqa: B023

            feature, cut, gain, value = self.grow(number, chosen, total)
            for rows, start, levels in ((seen, node, 1), (unseen, None, self.depth)):
                for at in range(0, len(rows), STEP_ROWS):
                    some = rows[at : at + STEP_ROWS]
                    margins[some] += value[_walk(binned, some, feature, cut, levels, None if start is None else start[at : at + STEP_ROWS])]
            done.append((feature, cut, gain, value))
        return done

    def _unpacked(self, added: list[np.ndarray], packs: list[tuple], chosen: np.ndarray, level: dict) -> np.ndarray:
        """(nodes, bins of all features, 2) from the sums of packs."""
        count, out = len(level["nodes"]), {}
        for total, (_, _, held) in zip(added, packs, strict=True):
            for f, bin_of in held.items():
                cell = (np.arange(count)[:, None] * self.bins[f] + bin_of).ravel()
                out[f] = np.stack([np.bincount(cell, x, count * self.bins[f]).reshape(count, -1) for x in total], axis=2)
        return np.concatenate([out[f] for f in chosen], axis=1)


def _derivatives(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margins))
    return p - y, p * (1 - p)


def _packs(binned: np.ndarray, bins: list[int], most: int = PACK_BINS) -> list[tuple[np.ndarray, int, dict[int, np.ndarray]]]:
    """Features dealt to lines of numbers: (line, how many numbers, the bin of each feature by number).

    A feature joins the line that it makes the fewest new numbers with; a number stands for bins that occur together, so what is added up by
    number gives the sums by bin of every feature of the line.
    """
    out: list[list] = []
    for f in sorted(range(len(bins)), key=lambda f: bins[f]):
        best = None
        for i, (line, count, _) in enumerate(out):
            if count * bins[f] > 64 * most:
                continue
            joint = line.astype(np.int64) * bins[f] + binned[f]
            there = np.nonzero(np.bincount(joint, minlength=count * bins[f]))[0]
            if len(there) <= most and (best is None or len(there) / count < best[0]):
                best = (len(there) / count, i, joint, there)
        if best is None:
            out.append([binned[f].astype(np.uint16), bins[f], {f: np.arange(bins[f])}])
            continue
        _, i, joint, there = best
        number = np.zeros(out[i][1] * bins[f], np.uint16)
        number[there] = np.arange(len(there))
        values = {g: v[there // bins[f]] for g, v in out[i][2].items()}
        out[i] = [number.take(joint), len(there), {**values, f: there % bins[f]}]
    return [tuple(p) for p in out]


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def fit(
    df: DataFrame, features: list[str], label: str, key: str, trees: int, depth: int, rate: float, row_share: float = 1.0, column_share: float = 1.0,
    min_child_weight: float = 1.0, penalty: float = 1.0, seed: int = 0, bins: int = MOST_BINS, rows_per_partition: int = ALONE_ROWS,
) -> Boosted:
    """Boosted trees over the double columns ``features`` of ``df`` for a label of 0 and 1; ``key`` tells rows apart.

    Up to ``rows_per_partition`` rows are one partition, whose task has no one to add up with and so grows all trees in one job.
    More rows are dealt to as many partitions as there are cores, and to more only when these would be too large.
    """
    enable_checkpoints(df.sparkSession)
    find_package(df.sparkSession)
    rng = np.random.default_rng(seed)
    edges = bin_edges(df, features, bins)
    counts = df.agg(F.count("*").alias("n"), F.avg(label).alias("mean")).first()
    partitions = _partitions(counts["n"], rows_per_partition, df.sparkSession.sparkContext.defaultParallelism)
    mean = min(max(counts["mean"] or 0.0, 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    grower = Grower(depth, rate, penalty, min_child_weight, row_share, seed, [len(e) + 1 for e in edges])
    drawn = [np.sort(rng.choice(len(features), max(1, round(column_share * len(features))), replace=False)) for _ in range(trees)]
    start = _blocks(df, features, label, key, edges, partitions).map(lambda b: (*b, np.full(len(b[1]), base)))
    if partitions == 1:
        done = start.map(lambda b: grower.alone(b, drawn)).collect()[0]
        return _model(features, base, depth, edges, done)
    done, before, kept = [], None, start.persist(KEPT)
    try:
        for number, chosen in enumerate(drawn):
            done.append(grower.grow(number, chosen, lambda level: _reduced(kept, grower, level, partitions)))
            if before is not None:
                before.unpersist()  # the tree's jobs have kept the newer margins
            before, kept = kept, _moved_on(kept, done[-1], depth)
            if (number + 1) % CHECKPOINT_TREES == 0:
                kept.checkpoint()
        return _model(features, base, depth, edges, done)
    finally:
        for rdd in (before, kept):
            if rdd is not None:
                rdd.unpersist()


def _partitions(rows: int, rows_per_partition: int, cores: int) -> int:
    return max(1, min(-(-rows // rows_per_partition), max(cores, -(-rows // MOST_ROWS))))


def _moved_on(kept: RDD, tree: tuple, depth: int) -> RDD:
    """The partitions with their margins after one more tree, kept by the next job."""
    return kept.map(lambda b: _with_tree(b, tree, depth)).persist(KEPT)


def _reduced(kept: RDD, grower: Grower, level: dict, partitions: int) -> np.ndarray:
    """The histograms of one level over all partitions."""
    parts = kept.map(lambda b: grower.sums(b, level))
    return parts.reduce(_add) if partitions <= 32 else parts.treeReduce(_add, 2)


def _best_split(sums: np.ndarray, penalty: float, min_child_weight: float) -> tuple | None:
    """(gain, feature, bin, left sums, right sums) of the best split of a node; None if no split gains."""
    total = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    heavy = (left[..., 1] >= min_child_weight) & (right[..., 1] >= min_child_weight)
    if not heavy.any():
        return None

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + penalty)

    gain = np.where(heavy, worth(left) + worth(right) - worth(total), -np.inf)
    most = gain.max()
    if most <= 1e-9:
        return None
    # the first of equal gains: the last bits of a sum depend on how the rows are dealt
    j, b = np.unravel_index(int((gain >= most * (1 - 1e-9)).argmax()), gain.shape)
    return float(gain[j, b]), int(j), int(b), left[j, b], right[j, b]


def _model(features: list[str], base: float, depth: int, edges: list[np.ndarray], done: list[tuple]) -> Boosted:
    """The trees with cut values in place of bins."""
    feature = np.array([t[0] for t in done]).reshape(len(done), -1)
    threshold = np.zeros(feature.shape)
    for at in zip(*np.nonzero(feature >= 0), strict=True):
        # a bin holds what lies above the cut before it, up to its own
        threshold[at] = edges[feature[at]][done[at[0]][1][at[1]]]
    return Boosted(
        list(features), base, depth, feature, threshold, np.array([t[2] for t in done]).reshape(feature.shape),
        np.array([t[3] for t in done]).reshape(feature.shape),
    )

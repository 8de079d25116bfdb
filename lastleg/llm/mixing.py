"""Temperature mixing of sources.

The weight of a source is its share of all tokens (words) to the power ``alpha``, normalised. alpha
is found by bisection in 0 to 1: the largest that reaches ``target_entropy`` (in nats), or the smallest, hence the
flattest mix, at which no source is read more than ``repetition_limit`` times. The budget is given in
tokens; by default it is the smallest at which every source is read at least once, so no document is lost.

The weights are realised as block permutations. A source's documents are dealt by hash to blocks;
each pass over the source takes its blocks in another random order. Whole passes take everything, the last pass
takes blocks until the source's budget is met and stops inside the block that meets it.
``mix_key`` is the part of the source's budget that lies before the block: ordered by it the
sources interleave at their weights.

One row for each source comes to the driver. Blocks are at most 65,536 for each source, and only the block in
which the budget ends is ordered document by document.

Defined cases: a null source is a source of its own; documents without words are read once, in the first
pass, and weigh nothing; rows equal in doc_id, text and source are one document, taken or not together; an empty table gives no
rows; other columns pass through ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.llm.common import unused
from lastleg.session import stage

MOST_BLOCKS = 65_536


@dataclass(frozen=True)
class Mix:
    """What a source is read for: ``passes`` whole passes, then ``rest`` tokens of one more."""

    source: str | None
    tokens: int
    weight: float
    budget: float
    passes: int
    rest: float


def weights(tokens: list[int], alpha: float) -> list[float]:
    """Normalised powers of the token shares; sources without tokens weigh nothing."""
    total = sum(tokens)
    powers = [(t / total) ** alpha if t else 0.0 for t in tokens]
    return [p / sum(powers) for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x)


def repetitions(tokens: list[int], w: list[float], budget: float | None = None) -> list[float]:
    """How often each source is read; without a budget, the least read one once."""
    rates = [x / t if t else 0.0 for x, t in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min(r for r in rates if r)
    return [r * scale for r in rates]


def find_alpha(tokens: list[int], target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> float:
    """The exponent in 0 to 1. Entropy falls and repetition falls as alpha grows; bisection stops at 2^-60."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")

    def flat_enough(alpha: float) -> bool:
        return entropy(weights(tokens, alpha)) >= target_entropy

    def within_limit(alpha: float) -> bool:
        return max(repetitions(tokens, weights(tokens, alpha), budget)) <= repetition_limit

    low, high = 0.0, 1.0
    if target_entropy is not None:
        if flat_enough(1.0):
            return 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if flat_enough(mid) else (low, mid)
        return low
    if within_limit(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if within_limit(mid) else (mid, high)
    return high


def plan_mix(totals: list[tuple[str | None, int]], target_entropy: float | None, repetition_limit: float | None, budget: float | None) -> list[Mix]:
    counted = [(s, t) for s, t in totals if t]
    if not counted:
        return [Mix(s, 0, 0.0, 0.0, 1, 0.0) for s, _ in totals]
    tokens = [t for _, t in counted]
    w = weights(tokens, find_alpha(tokens, target_entropy, repetition_limit, budget))
    mixes = []
    for (source, t), weight, times in zip(counted, w, repetitions(tokens, w, budget), strict=True):
        nearest = round(times)
        times = nearest if abs(times - nearest) < 1e-9 else times
        passes = int(times)
        mixes.append(Mix(source, t, weight, times * t, passes, (times - passes) * t))
    return mixes + [Mix(s, 0, 0.0, 0.0, 1, 0.0) for s, t in totals if not t]


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def schedule(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None,
             budget: float | None = None, block_tokens: int = 200_000, seed: int = 1) -> DataFrame:
    """(d, t, s, tokens, block, epoch, mix_key): when each document (id, text hash, source) is read."""
    spark = docs.sparkSession
    counted = docs.select(
        F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("source").cast("string").alias("s"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("words"),
    )
    base = stage(counted.groupBy("d", "t", "s").agg(F.sum("words").alias("tokens")), "counted")
    totals = [(r["s"], r["n"]) for r in base.groupBy("s").agg(F.sum("tokens").alias("n")).collect()]
    mixes = plan_mix(sorted(totals, key=lambda x: (x[0] is None, x[0] or "")), target_entropy, repetition_limit, budget)
    if not mixes:
        empty = "d long, t long, s string, tokens long, block long, epoch int, mix_key double"
        return spark.createDataFrame([], empty)
    rows = [(m.source, max(1, min(MOST_BLOCKS, -(-m.tokens // block_tokens))), float(m.budget), m.passes, float(m.rest)) for m in mixes]
    plan = F.broadcast(spark.createDataFrame(rows, "ps string, blocks long, budget double, passes int, rest double"))
    blocked = base.join(plan, F.col("s").eqNullSafe(F.col("ps"))).withColumn("block", F.pmod(_hash(seed, F.col("d"), F.col("t")), "blocks"))
    passes = F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    blocks = (
        blocked.groupBy("s", "block", "budget", "passes", "rest").agg(F.sum("tokens").alias("n"))
        .filter("passes > 0 OR rest > 0").withColumn("epoch", passes)
    )
    order = Window.partitionBy("s", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("block")), "block")
    starts = blocks.withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = F.sum("n").over(Window.partitionBy("s", "epoch"))
    room = F.when(F.col("epoch") < F.col("passes"), F.lit(float("inf"))).otherwise(F.col("rest") - F.col("start"))
    key = F.when(F.col("budget") > 0, (F.col("epoch") * size + F.col("start")) / F.col("budget")).otherwise(0.0)
    taken = stage(
        starts.withColumn("room", room).withColumn("mix_key", key).filter("room > 0")
        .select(F.col("s").alias("bs"), F.col("block").alias("b"), "epoch", "n", "room", "mix_key"), "blocks",
    )
    on = F.col("s").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b"))
    fields = ["d", "t", "s", "tokens", "block", "epoch", "mix_key"]
    documents = blocked.select("d", "t", "s", "tokens", "block")
    whole = documents.join(taken.filter("room >= n"), on).filter("epoch = 0 OR tokens > 0").select(*fields)
    cut = documents.join(taken.filter("room < n"), on)
    inside = Window.partitionBy("s", "block", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("d"), F.col("t")), "d", "t")
    before = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = cut.withColumn("before", before).filter((F.col("before") < F.col("room")) & ((F.col("epoch") == 0) | (F.col("tokens") > 0)))
    return whole.unionByName(some.select(*fields))


def mix(docs: DataFrame, epoch_column: str = "epoch", key_column: str = "mix_key", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, with the pass and the place in the mix."""
    inside = ("d", "t", "s", "epoch", "mix_key")
    d, t, s, epoch, key = unused(docs, *inside)
    plan = stage(schedule(docs.select("doc_id", "text", "source"), **options), "schedule")
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip(inside, (d, t, s, epoch, key), strict=True)])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)) & F.col("source").cast("string").eqNullSafe(F.col(s))
    kept = [F.col(c) for c in docs.columns if c not in (epoch_column, key_column)]
    # always a merge join: the schedule grows with the corpus, so a broadcast would only suit small inputs
    return docs.join(plan.hint("merge"), same).select(*kept, F.col(epoch).alias(epoch_column), F.col(key).alias(key_column))

"""Dealing documents to shards by vector bin packing.

A group (equal texts) is a vector of bytes, tokens (words) and rows, each as a share of what one
shard should hold. Groups are placed largest first where the dot product with the residual capacity of
the shard is highest, among the shards it fits into if there are any.

Every group above 1/``SINGLE`` of a shard by any measure is placed by itself; of such groups there are at most
3 * ``SINGLE`` for each shard, however large the corpus. The small rest is placed as ``bundles`` hash
classes of groups. Only a group above a whole shard is split, by a hash of doc_id into parts of about an eighth of a shard;
every other one stays in one shard. Bytes are near equal as long as no single item is a large part of a shard.

Defined cases: a null text has 8 bytes, no tokens and the checksum of an empty text; repeated rows are
rows of their own in the same shard; null doc_ids are kept; an empty table gives no rows; other columns
are ignored by ``place`` and kept by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import numbered
from lastleg.session import stage

ROW_BYTES = 8
SINGLE = 200
_MEASURES = ["bytes", "tokens", "rows"]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, g): g tells groups of equal texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )


def best_shards(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``items`` has a row of shares for each."""
    residual = np.ones((shards, items.shape[1]))
    chosen = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        score = np.round(residual @ items[i], 12)  # ties are the same on every machine
        fits = (residual >= items[i] - 1e-12).all(axis=1)
        at = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        residual[at] -= items[i]
        chosen[i] = at
    return chosen


def place(docs: DataFrame, shards: int = 24, bundles: int = 6144) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) for every row; slots are gapless in a shard."""
    spark = docs.sparkSession
    base = stage(measured(docs), "measured")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = base.agg(*sums).first()
    share = {m: max(total[m] or 0, 1) / shards for m in _MEASURES}
    groups = base.groupBy("g").agg(*sums)
    taken = F.greatest(*[F.col(m) / share[m] for m in _MEASURES])
    parts = F.when(taken > 1, F.ceil(8 * taken)).otherwise(1).cast("long")
    large = stage(groups.filter(taken > 1 / SINGLE).select(F.col("g").alias("big"), parts.alias("parts")), "large_groups")
    # at most SINGLE * shards large groups for each of the three measures
    split = base.join(F.broadcast(large), F.col("g") == F.col("big"), "left")
    keyed = split.withColumn(
        "item", F.when(F.col("big").isNull(), F.concat(F.lit("b"), F.pmod("g", F.lit(bundles))))
        .otherwise(F.concat_ws(":", "big", F.pmod(F.xxhash64("doc_id"), "parts"))),
    ).select(*base.columns, "item")
    rows = keyed.groupBy("item").agg(*sums).orderBy("item").collect()  # bundles, large groups and parts: bounded
    vectors = np.array([[r[m] / share[m] for m in _MEASURES] for r in rows]).reshape(-1, 3)
    chosen = best_shards(vectors, shards)
    where = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(rows, chosen, strict=True)], "item string, shard int")
    dealt = keyed.join(F.broadcast(where), "item").select("doc_id", "size", "tokens", "text_crc32", "shard")
    return numbered(stage(dealt, "dealt"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, bundles: int = 6144) -> None:
    """Write the rows of ``docs`` to one folder for each shard. Rows are told apart by doc_id and text."""
    placed = place(docs, shards, bundles).select(
        F.col("doc_id").alias("__d"), F.col("text_crc32").alias("__c"), F.col("size").alias("__s"), "shard",
    ).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.crc32(text) == F.col("__c"))
        & (F.octet_length(text) + ROW_BYTES == F.col("__s"))
    )
    docs.join(placed, same).drop("__d", "__c", "__s").write.partitionBy("shard").parquet(path)

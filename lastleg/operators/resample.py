"""Weighted draws with replacement, for any column of weights.

All rows lie on a line, each as long as its weight. A draw is a point of that line and takes the row it falls on. The line is never
sorted as a whole: rows above 1/``HEAVY`` of all weight, fewer than ``HEAVY``, come first, and hash buckets of the others follow. Draws meet these
stretches, of which there is a bounded number, in an equi-join on cells of equal width; inside a bucket they meet its rows in one ordered pass.
So neither a row nor a bucket gets more draws into one task than its own small share of the weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lastleg.operators.sampling import bucket_digits, hash_key
from lastleg.session import stage

HEAVY = 1000


def weighted_resample(df: DataFrame, key: str, weight: str, n: int, digits: int | None = None) -> DataFrame:
    """(draw, ``key``): ``n`` draws numbered from 0, each row drawn with a chance proportional to its weight.

    Weights are whole numbers (scale others first) with a sum below 2^56; rows with a null, zero or negative one, or without
    key, are never drawn; keys are unique. Without such rows there are no draws. Draws are hashes of their number, so a run can be repeated.
    """
    spark = df.sparkSession
    weighed = df.select(F.col(key).alias("key"), F.col(weight).cast("bigint").alias("w")).where("w > 0 AND key IS NOT NULL")
    lines = stage(weighed.withColumn("hash", hash_key("key")), "weights")
    size = lines.agg(F.count("*").alias("rows"), F.sum("w").alias("total")).first()
    rows, total = size["rows"], size["total"]
    if not rows:
        return weighed.select(F.lit(0).cast("bigint").alias("draw"), F.col("key").alias(key)).where("false")
    digits = digits or bucket_digits(rows)
    heavy = F.col("w") * HEAVY > total
    lines = lines.withColumns({
        "stretch": F.when(heavy, F.col("hash")).otherwise(F.substring("hash", 1, digits)),
        "part": F.when(heavy, F.lit("")).otherwise(F.substring("hash", 1, 1)),
    })

    # Where each stretch begins: inside its part by a window, and the parts, at most 17, one after the other.
    stretches = lines.groupBy("part", "stretch").agg(F.sum("w").alias("long"), F.min("key").alias("only"))
    stretches = stage(stretches, "stretches")
    begins, at = {}, 0
    for r in stretches.groupBy("part").agg(F.sum("long").alias("long")).orderBy("part").collect():
        begins[r["part"]] = at
        at += r["long"]
    first = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])[F.col("part")]
    inside = F.sum("long").over(W.partitionBy("part").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("long")
    stretches = stretches.withColumn("start", (first + inside).cast("bigint"))

    # Draws meet the stretches by cells: a stretch takes one row for each cell it touches, twice the number of cells in all.
    width = -(-total // (HEAVY + 16**digits))
    touched = F.sequence(F.expr(f"start div {width}L"), F.expr(f"(start + long - 1) div {width}L"))
    word = F.conv(F.substring(F.md5(F.col("draw").cast("string")), 1, 14), 16, 10).cast("bigint")
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("point", word % F.lit(total))
    met = draws.withColumn("cell", F.expr(f"point div {width}L")).join(stretches.withColumn("cell", F.explode(touched)), "cell")
    met = met.where((F.col("point") >= F.col("start")) & (F.col("point") < F.col("start") + F.col("long")))
    met = stage(met.select("draw", "part", "stretch", "only", (F.col("point") - F.col("start")).alias("point")), "met")
    alone = met.where("part = ''").select("draw", F.col("only").alias("key"))

    # Inside a bucket the row of a draw is the last one that begins at or before it.
    light = lines.where("part <> ''")
    running = F.sum("w").over(W.partitionBy("stretch").orderBy("hash").rowsBetween(W.unboundedPreceding, 0)) - F.col("w")
    begun = light.select("stretch", running.alias("point"), "key", F.lit(None).cast("bigint").alias("draw"))
    asked = met.where("part <> ''").select("stretch", "point", F.lit(None).cast(lines.schema["key"].dataType).alias("key"), "draw")
    so_far = W.partitionBy("stretch").orderBy("point", F.col("draw").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = begun.unionByName(asked).withColumn("key", F.last("key", ignorenulls=True).over(so_far)).where("draw IS NOT NULL")
    return found.select("draw", "key").unionByName(alone).withColumnRenamed("key", key)

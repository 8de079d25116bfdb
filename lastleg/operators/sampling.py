"""Deterministic sampling, ranking and resampling without sorting a table in one place.

Rows are ordered by the MD5 of their key. The first hex digits of the hash form buckets of
equal size, so bucket counts, which are few, say where a rank falls; only one bucket has to
be sorted to find the exact row.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lastleg import settings
from lastleg.functions import dates
from lastleg.operators.joins import fits_broadcast, lookup_join

# Hex digits of the hash that form a bucket: 16^n buckets per group.
BUCKET_DIGITS = 4
# Rows one sort should see at most, when all rows are in one group.
BUCKET_ROWS = 1_000_000


def bucket_digits(rows: int) -> int:
    """Digits that keep buckets near ``BUCKET_ROWS``; at most 16^5 buckets per group."""
    digits = 1
    while digits < 5 and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def hash_key(key: str) -> Column:
    """Sort key of a row. It is never null, so no null check repeats the hash."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.concat(F.md5(text), text)


def _bucket(digits: int) -> Column:
    return F.substring("_hash", 1, digits)


def _bucket_offsets(hashed: DataFrame, group: list[str], digits: int) -> DataFrame:
    """Rows per bucket, and rows in the buckets before it, within the group."""
    counts = hashed.groupBy(*group, _bucket(digits).alias("_bucket")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_total": F.sum("_n").over(W.partitionBy(*group)),
    })


def hash_thresholds(
    df: DataFrame, key: str, keep: Column, group: tuple[str, ...] = (), digits: int = BUCKET_DIGITS, few: bool = True,
) -> DataFrame:
    """Per group, the hash of the ``keep``-th row; ``keep`` may use the group size ``_total``.

    A group with fewer rows gets no threshold. ``few`` says that the groups are known to be
    few; otherwise the edge buckets are found by a shuffle on group and bucket, which spreads
    every group.
    """
    keys = list(group)
    hashed = df.select(*keys, hash_key(key).alias("_hash"))
    offsets = _bucket_offsets(hashed, keys, digits).withColumn("_keep", keep.cast("bigint"))
    edge = offsets.where((F.col("_before") < F.col("_keep")) & (F.col("_keep") <= F.col("_before") + F.col("_n")))
    edge = edge.select(*keys, "_bucket", (F.col("_keep") - F.col("_before")).alias("_nth"))
    in_edge = hashed.withColumn("_bucket", _bucket(digits)).join(F.broadcast(edge) if few else edge, [*keys, "_bucket"])
    rank = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_hash"))
    return in_edge.withColumn("_rank", rank).where("_rank = _nth").select(*keys, F.col("_hash").alias("_threshold"))


def hash_sample(df: DataFrame, key: str, n: int, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), uniform and repeatable; keys are unique."""
    threshold = hash_thresholds(df, key, F.least(F.lit(n), F.col("_total")), digits=digits).select("_threshold").scalar()
    return df.where(hash_key(key) <= threshold)


def stratified_split(
    df: DataFrame, key: str, label: str | None, test_share: float = settings.TEST_SHARE, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``split``: exactly the given share of every label value goes to the test set.

    The facts are not shuffled or sorted: they are compared with one threshold per label
    value, once the label values were counted and are few.
    """
    train = F.col("_total") - F.ceil(F.col("_total") * F.lit(test_share))
    group = (label,) if label else ()
    few = fits_broadcast(df.select(label).distinct()) if label else True
    thresholds = hash_thresholds(df, key, train, group, digits, few)
    if label:
        marked = lookup_join(df, thresholds, label, small=few)
        inside = hash_key(key) <= F.col("_threshold")
    else:
        marked = df
        inside = hash_key(key) <= thresholds.select("_threshold").scalar()
    split = F.when(inside, "train").otherwise("test")
    return marked.withColumn("split", split).drop("_threshold")


def hash_rank(
    df: DataFrame, key: str, group: tuple[str, ...] = (), digits: int | None = None, name: str = "position",
) -> DataFrame:
    """Exact rank by key hash within each group, from 1, however large a group is.

    Rows are shuffled by group and bucket, so the rows of a hot group spread over 16^digits
    sorts; the ranks before each bucket come from the bucket counts. By default the digits
    follow from the row count.
    """
    if digits is None:
        digits = bucket_digits(df.count())
    keys = list(group)
    hashed = df.withColumn("_hash", hash_key(key))
    offsets = _bucket_offsets(hashed.select(*keys, "_hash"), keys, digits).select(*keys, "_bucket", "_before")
    inner = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_hash"))
    ranked = hashed.withColumn("_bucket", _bucket(digits)).withColumn("_inner", inner)
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inner")).cast("bigint"))
        .drop("_hash", "_bucket", "_inner", "_before")
    )


def weighted_bootstrap(orders: DataFrame, n: int | None = None, key: str = "order_id", digits: int | None = None) -> DataFrame:
    """Draw rows with replacement, each with a chance proportional to its hour's weight.

    Weights depend on the hour only, so a draw is a point on a line of 24 stretches, each as
    long as weight x rows of that hour: the stretch gives the hour and the place in it gives
    the row. Draws meet rows in an equi-join on hour and position; no range join is needed.
    Weights are counted in tenths, which makes every step integer and exact.
    """
    spark: SparkSession = orders.sparkSession
    if n is None:
        n = orders.count()
    tenths = F.rint(dates.hour_weight("hour") * 10.0).cast("bigint")
    hours = (
        orders.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("rows"))
        .where(F.col("hour").isNotNull()).withColumn("w", tenths).orderBy("hour")
    ).collect()  # at most 24 rows
    if not hours:
        return orders.select(F.lit(0).cast("bigint").alias("draw"), key, "created_at", F.hour("created_at").alias("hour")).where("false")
    ends = list(accumulate(r["rows"] * r["w"] for r in hours))
    starts = [0, *ends[:-1]]

    def per_hour(values: list[int], type_: str) -> Column:
        out = F
        for end, value in list(zip(ends, values))[:-1]:
            out = out.when(F.col("_at") < end, F.lit(value).cast(type_))
        last = F.lit(values[-1]).cast(type_)
        return last if out is F else out.otherwise(last)

    word = F.conv(F.substring(F.md5(F.col("draw").cast("string")), 1, 14), 16, 10).cast("bigint")
    draws = spark.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_at", F.coalesce(word % F.lit(ends[-1]), F.lit(0).cast("bigint"))).withColumns({
        "hour": per_hour([r["hour"] for r in hours], "int"),
        "_start": per_hour(starts, "bigint"),
        "_w": per_hour([r["w"] for r in hours], "bigint"),
    })
    place = F.coalesce(F.expr("(_at - _start) div _w"), F.lit(0).cast("bigint")) + 1
    draws = draws.select("draw", "hour", place.alias("position"))
    numbered = hash_rank(orders.select(key, "created_at", F.hour("created_at").alias("hour")), key, ("hour",), digits)
    return draws.join(numbered, ["hour", "position"]).select("draw", key, "created_at", "hour")


def roster(df: DataFrame, group: str, member: str, digits: int | None = None) -> DataFrame:
    """The numbered members of every group, and the group size.

    One row per member instead of one list per group, so a group of any size is fine; a
    random member of a group is a join on its position.
    """
    members = df.select(group, member).na.drop("any")
    sizes = members.groupBy(group).agg(F.count("*").alias("members"))
    return lookup_join(hash_rank(members, member, (group,), digits), sizes, group)


def hour_spine(df: DataFrame, time: str) -> DataFrame:
    """Every full hour between the first and the last timestamp."""
    hours = df.agg(F.date_trunc("hour", F.min(time)).alias("a"), F.date_trunc("hour", F.max(time)).alias("b"))
    return hours.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))

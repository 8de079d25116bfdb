"""Exact dedup by deterministic block naming.

A text, without its white space, is cut into blocks of ``block`` bytes. The distinct blocks of all texts are sorted and
numbered: a block's place is its name. Then adjacent names of a text are paired, the distinct pairs are sorted and
numbered in turn, and so on until each text has one name. Two texts have equal names, reached at the same level, only if their
blocks were equal all the way down: no hash decides that two texts are equal.

Blocks find their names by two 64-bit marks instead of their bytes. That is exact, as the marks of all distinct blocks are
compared first; should two blocks share both, all marks are taken anew with another salt.

What moves: each task passes on its distinct blocks once (copies fall together before the shuffle), then 16 bytes a block and
8 a name. Names are joined, not gathered: a text's names never have to meet in one task, nor do the copies of one text, since
adaptive execution splits a hot key of a join. A level has half the rows of the one before; levels grow with the logarithm of the longest
text. Each level is a stored table.

Defined cases: null counts as empty, and empty and blank texts are equal; every row counts, also one that repeats in all
columns; of equal texts the row with most code points stays, then the smallest doc_id, rows without doc_id last, then the first in file
order, so that one row of each group stays; an empty table gives no rows; other columns are ignored or, by ``keep_one``, passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastleg.session import stage

BLOCK = 1024
_SPACE = r"[\x20\x09-\x0D]+"
_NONE = -1  # the missing right half of a last pair


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, "")


def _cut(data: Column, block: int) -> Column:
    """Binary data in blocks; empty data is one empty block."""
    last = F.greatest(F.ceil(F.octet_length(data) / block).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def marks(block: Column, salt: int) -> list[Column]:
    """Two 64-bit hashes of a block."""
    return [F.xxhash64(block, F.lit(2 * salt)), F.xxhash64(F.lit(2 * salt + 1), block)]


def _keys(rows: DataFrame, block: int, salt: int) -> DataFrame:
    """(rid, doc_id, n, sha, found) of every row: code points, hash of the bare text, marks of its blocks."""

    def described(data: Column) -> Column:
        found = F.transform(_cut(data, block), lambda b: F.struct(*[m.alias(f"m{i}") for i, m in enumerate(marks(b, salt))]))
        return F.struct(F.unhex(F.sha2(data, 256)).alias("sha"), found.alias("found"))

    # a lambda's argument is computed once, however often its body names it
    seen = F.transform(F.array(_bare(F.col("text")).cast("binary")), described)[0]
    n = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), seen.alias("x")).select(
        "rid", "doc_id", "n", "x.sha", "x.found",
    )


def _block_names(rows: DataFrame, block: int, salt: int) -> DataFrame:
    """(m0, m1, name) of every distinct block, named by its place in sorted order."""
    blocks = F.transform(F.array(_bare(F.col("text")).cast("binary")), lambda data: _cut(data, block))[0]
    distinct = rows.select(F.explode(blocks).alias("b")).distinct().sortWithinPartitions("b")
    named = [m.alias(f"m{i}") for i, m in enumerate(marks(F.col("b"), salt))]
    return stage(distinct.select(*named, F.monotonically_increasing_id().alias("name")), "block_names")


def _named_blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The keys of all rows, and the names of all blocks under marks that tell every two of them apart."""
    salt = 0
    while True:
        names = _block_names(rows, block, salt)
        if not names.groupBy("m0", "m1").count().filter("count > 1").take(1):
            return stage(_keys(rows, block, salt), "keys"), names
        salt += 1


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, n, sha, level, name) of every row of (rid, doc_id, text): level and name are equal just for equal texts.

    ``rid`` is unique. ``rows`` is read twice.
    """
    keys, names = _named_blocks(rows, block)
    spread = keys.select("rid", F.size("found").alias("m"), F.posexplode("found").alias("pos", "f")).select("rid", "m", "pos", "f.m0", "f.m1")
    named = spread.join(names.hint("merge"), ["m0", "m1"]).select("rid", "m", "pos", "name")
    level, done = 0, None
    while True:
        named = stage(named, "names")
        ready = named.filter("m = 1").select("rid", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        open_rows = named.filter("m > 1")
        if not open_rows.take(1):
            break
        side = F.col("pos") % 2
        pairs = open_rows.groupBy("rid", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(_NONE)).alias("b"),
        )
        pairs = stage(pairs, "pairs")
        distinct = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        names = stage(distinct.withColumn("name", F.monotonically_increasing_id()), "pair_names")
        named = pairs.join(names.hint("merge"), ["a", "b"]).select("rid", "m", "pos", "name")
        level += 1
    return keys.drop("found").join(done.hint("merge"), "rid")


def _judged(rows: DataFrame, block: int) -> DataFrame:
    """(rid, doc_id, sha, keep, group_size) of every row; ``keep`` is the place of the row that stays."""
    place = F.struct((-F.col("n")).alias("most"), F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    known = stage(identities(rows, block), "identities")
    groups = known.groupBy(F.col("level").alias("l"), F.col("name").alias("g")).agg(F.count("*").alias("group_size"), F.min(place).alias("keep"))
    same = (F.col("level") == F.col("l")) & (F.col("name") == F.col("g"))
    return known.join(stage(groups, "groups").hint("merge"), same).select("rid", "doc_id", "sha", "keep", "group_size")


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), *columns)


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    judged = _judged(_numbered(docs, "doc_id", "text"), block)
    return judged.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.rid") == F.col("rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of equal texts, all columns as they are."""
    stored = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    judged = _judged(stored.select("rid", "row.doc_id", "row.text"), block)
    kept = judged.filter(F.col("keep.rid") == F.col("rid")).select("rid")
    return stored.join(kept.hint("merge"), "rid", "left_semi").select("row.*")

"""Repeated runs of lines, found by winnowing over line hashes and deleted from later documents.

A line counts with its surrounding blanks cut off; lines without a word are transparent. A window is the
shortest run of lines from a line on with ``min_words`` words.

1. select: the smallest line hash of each window, the leftmost of equal ones, is a fingerprint. It is kept
   once for each position, where the minimum of the sliding window changes. Equal runs of
   ``min_words`` words or more hold equal windows, so they are guaranteed to share a fingerprint;
2. join positions: fingerprints selected at two positions or more make these positions anchors;
3. extend: from each anchor the line hashes are compared both ways, forward in the windows that have it as
   minimum, backward in the shortest runs that hold it and end in a given line. The former reach
   from the first line of a repeated run to its last full window, the latter on to its last line;
4. delete: every line in an extended match that occurred before, in the order of doc_id and line. The
   first occurrence of a run stays.

So a line goes exactly if it lies in a run of ``min_words`` words or more that occurred earlier, within
the same document too; blank lines go with the lines on both sides. Line order of what stays is kept.

All steps are DataFrame operations. No pairs are formed: each extended match meets the first of its content, so
a line that a third of all documents share costs one row for each of them. Tables that meet
on a fingerprint are stored before, and adaptive execution splits the common ones. Lines of texts without an
anchor are not looked at again.

Defined cases: a null text stays null, an empty one empty; a document that only repeats keeps its row
with an empty text; rows with equal doc_id and text are one document and get the same result; a null
doc_id comes before all others; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.llm.common import unused
from lastleg.session import stage

_DOC = ["d", "t"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ahead(min_words: int):
    return Window.partitionBy(*_DOC).orderBy("before").rangeBetween(0, min_words - 1)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with a word: document (d, t), position, number, hash, words before it and up to its end.

    ``least`` and ``fp`` are number and hash of the minimum of the window that starts here, null where the window before has
    the same minimum and where too few words follow.
    """
    exploded = docs.select(
        F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"),
    ).select("d", "t", "pos", F.xxhash64(F.trim("line")).alias("h"), F.regexp_count("line", F.lit(r"[^ \t\r]+")).alias("words"))
    one = (
        exploded.filter("words > 0").repartition(*_DOC).groupBy(*_DOC, "pos")
        .agg(F.first("h").alias("h"), F.first("words").cast("long").alias("words"))
    )
    in_order = Window.partitionBy(*_DOC).orderBy("pos")
    upto = F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    counted = one.withColumns({"upto": upto, "number": F.row_number().over(in_order)})
    placed = counted.withColumn("before", F.col("upto") - F.col("words"))
    ahead = _ahead(min_words)
    slid = placed.withColumn("m", F.when(F.sum("words").over(ahead) >= min_words, F.min(F.struct("h", "number")).over(ahead)))
    changed = ~F.col("m.number").eqNullSafe(F.lag("m.number").over(Window.partitionBy(*_DOC).orderBy("before")))
    return slid.select(
        *_DOC, "pos", "number", "h", "before", "upto",
        F.when(changed, F.col("m.number")).alias("least"), F.when(changed, F.col("m.h")).alias("fp"),
    )


def selected(lines: DataFrame) -> DataFrame:
    """(d, t, number, fp): each selected position once."""
    return lines.filter("least IS NOT NULL").select(*_DOC, F.col("least").alias("number"), "fp")


def anchors(lines: DataFrame) -> DataFrame:
    """(d, t, number): selected positions whose fingerprint is selected elsewhere too."""
    shared = stage(selected(lines).groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "shared_fingerprints")
    return selected(lines).join(shared, "fp", "left_semi").select(*_DOC, "number")


def extended(lines: DataFrame, anchored: DataFrame, min_words: int) -> DataFrame:
    """Runs of lines around anchors: (d, t, lo, hi, first, last, fp, content); first and last number the lines with words."""
    columns = ["pos", "h", "before", "upto"]
    plain = lines.select(*_DOC, "number", *columns, F.lit(False).alias("anchor"))
    marks = anchored.select(*_DOC, "number", *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in columns], F.lit(True).alias("anchor"))
    # brought together by document, as the windows need them, not by document and number
    marked = (
        plain.unionByName(marks).repartition(*_DOC).groupBy(*_DOC, "number")
        .agg(*[F.max(c).alias(c) for c in columns], F.max("anchor").alias("anchor"))
    )
    near = marked.withColumn("any", F.max("anchor").over(Window.partitionBy(*_DOC))).filter("any")
    behind = Window.partitionBy(*_DOC).orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def of(w, keep: Column) -> Column:
        run = F.struct(
            F.min("pos").over(w).alias("lo"), F.max("pos").over(w).alias("hi"), F.min("number").over(w).alias("first"),
            F.max("number").over(w).alias("last"), F.min("h").over(w).alias("fp"), F.xxhash64(F.collect_list("h").over(w)).alias("content"),
        )
        enough = F.max("upto").over(w) - F.min("before").over(w) >= min_words
        return F.when(enough & keep, run)

    ahead = _ahead(min_words)
    forward = of(ahead, F.min(F.struct("h", "number", "anchor")).over(ahead)["anchor"])
    wide = near.select(*_DOC, forward.alias("a"), of(behind, F.max("anchor").over(behind)).alias("b"))
    return wide.select(*_DOC, F.explode(F.array("a", "b")).alias("w")).filter("w IS NOT NULL").select(*_DOC, "w.*").distinct()


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, lo, hi, first, last) of every extended match that occurred before."""
    lines = stage(line_table(docs, min_words), "lines")
    matched = stage(extended(lines, stage(anchors(lines), "anchors"), min_words), "extended")
    first = stage(
        matched.groupBy("fp", "content").agg(F.min(F.struct("d", "t", "lo", "hi")).alias("earliest"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("fp").alias("f"), F.col("content").alias("c"), "earliest"), "first_runs",
    )
    again = matched.join(first, (F.col("fp") == F.col("f")) & (F.col("content") == F.col("c")))
    later = F.struct("d", "t", "lo", "hi") > F.col("earliest")
    return again.filter(later).select(*_DOC, "lo", "hi", "first", "last")


def removed_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, spans): the maximal line intervals to delete from each document."""
    spans = repeated_runs(docs, min_words).distinct()
    by_start = Window.partitionBy(*_DOC).orderBy("lo", "hi")
    reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", (F.coalesce(F.col("first") > reach + 1, F.lit(True))).cast("int"))
    grouped = opened.withColumn("g", F.sum("new").over(by_start)).groupBy(*_DOC, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return grouped.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = 50, spans_column: str = "removed_spans") -> DataFrame:
    """``docs`` with repeated runs cut from ``text``, and the line spans cut, an array of (lo, hi), null if none."""
    d, t, cut = unused(docs, "d", "t", "spans")
    spans = stage(removed_spans(docs.select("doc_id", "text"), min_words), "removed_spans")
    spans = spans.select(F.col("d").alias(d), F.col("t").alias(t), F.col("spans").alias(cut))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    kept = F.filter(_lines(F.col("text")), lambda _, i: ~F.exists(cut, lambda s: i.between(s["lo"], s["hi"])))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns if c != spans_column]
    # always a merge join: spans grow with the corpus, so a broadcast would only suit small inputs
    return docs.join(spans.hint("merge"), same, "left").select(*others, F.col(cut).alias(spans_column))

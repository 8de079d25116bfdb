"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared
folder and reads again as the next stage's documents. All stages but the last return the columns of their
input; tables that a stage gathers for itself are stored in the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastleg.llm import jaccard, line_dedup, mixing, packing, toxicity
from lastleg.llm.common import find_package, id_fold, stage, table, unused

NEAR_SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go.

    Null and empty texts have no words and stay unless the labels call such texts toxic; rows that repeat are judged alike; rows without
    doc_id are judged by their text; without labels, or documents, all rows stay.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), id_fold(F.col("doc_id"), 3) != 1, threshold=0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines with 50 words or more that occurred before are cut out; ``n_chars`` follows the text.

    Null and empty texts stay as they are; a document that only repeats keeps its row with an empty text; rows equal in doc_id and text are
    one document; the first run by doc_id stays, nulls first.
    """
    (spans,) = unused(docs, "removed_spans")
    cut = line_dedup.dedup_lines(docs, min_words=50, spans_column=spans)
    changed = F.col(spans).isNotNull()
    kept = [
        F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ]
    return cut.select(*kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id.

    Texts link at a Jaccard similarity of five-word shingles of ``NEAR_SIMILARITY`` or more. All texts without a word are one
    group; a shorter text is one shingle; rows without doc_id come last; a kept row that is repeated stays repeated.
    """
    find_package(spark)
    return jaccard.keep_one(docs, shingle_words=5, threshold=NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix that reads every document at least once and no source more than one and a half times.

    Rows without a source are one source; empty texts hold no tokens and are read once; an empty table stays empty.
    """
    epoch, key = unused(docs, "epoch", "mix_key")
    mixed = mixing.mix(docs, epoch_column=epoch, key_column=key, repetition_limit=1.5)
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of 2048 tokens.

    A null text counts as an empty one, a document of one end token; every row is packed, also one that repeats.
    """
    find_package(spark)
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Nearest-neighbour votes, fingerprint components, bisection and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs

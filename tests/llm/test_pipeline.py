import importlib
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from conftest import DATA
from lastleg.llm import line_dedup, mixing, toxicity
from lastleg.llm.common import id_fold, numbered
from llm.test_jaccard import alike, slow_set
from llm.test_line_dedup import slow
from llm.test_simhash import slow_components


def test_stages_equal_brute_force_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.dtypes == before.dtypes
    original = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"].collect()}
    scores = toxicity.score(
        spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), id_fold(F.col("doc_id"), 3) != 1).collect()
    assert clean == {i: original[i] for i in original if i not in {r["d"] for r in scores if r["score"] >= 0.7}}
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    assert {(i, clean[i]): t for i, t in lines.items()} == slow(list(clean.items()), 50)
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].where("length(text) > 0").collect() if r["text"] != clean[r["doc_id"]])
    sets = {i: slow_set(t) for i, t in lines.items()}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if b < a and alike(sets[a], sets[b])]
    roots = {i for i, c in slow_components(ids, pairs).items() if i == c}
    assert {r["doc_id"] for r in kept["near_dedup"].collect()} == roots
    mixed = [(r["doc_id"], r["source"]) for r in kept["mixing"].collect()]
    assert {i for i, _ in mixed} == roots and max(mixed.count(m) for m in set(mixed)) <= 2
    plan = mixing.schedule(kept["near_dedup"], repetition_limit=1.5)
    assert len(mixed) == plan.count()
    packed = kept["packing"].collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(i for i, _ in mixed)
    assert sum(r["length"] for r in packed) <= 2048 * len({r["sequence_id"] for r in packed})


def test_every_stage_stands_odd_documents(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for _, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, str(tmp_path))
            assert out.count() >= 0
            if "text" in out.columns:
                assert out.columns == docs.columns


def test_columns_of_any_name_pass(spark, odd_docs, tmp_path):
    """Names that stages use inside are just columns of the documents."""
    inside = ("d", "t", "u", "spans", "epoch", "mix_key", "removed_spans", "__d", "__t", "__epoch", "__mix_key", "__removed_spans", "class", "place")
    docs = odd_docs
    for c in inside:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.select(*inside).distinct().collect():
            assert r.asDict() == {c: f"own {c}" for c in inside}


def test_line_dedup_stage_passes_on_changed_rows_only(odd_docs):
    assert line_dedup.dedup_lines(odd_docs).where("removed_spans IS NOT NULL").count() == 2


def test_registered():
    names = entry_module.queries()
    assert "pipeline" in names and sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None


def test_numbers_are_gapless(spark):
    rows = numbered(spark.range(5000).selectExpr("id % 3 % 2 AS k", "id DIV 2 AS x"), ["k"], ["x"], "n", per_bucket=100).collect()
    for k in (0, 1):
        mine = [r["n"] for r in rows if r["k"] == k]
        assert sorted(mine) == list(range(len(mine)))

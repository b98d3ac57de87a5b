"""The pipeline on a small table against brute force, stage by stage."""

import shutil

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillbase.llm import quality_classifier, quality_rules
from test_dedup import brute_components, brute_strip


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The test data's documents with copies, near copies and a passage that many share."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.where("doc_id < 12").withColumn("doc_id", F.col("doc_id") + 1000)
    near = docs.where("doc_id < 12").withColumns({"doc_id": F.col("doc_id") + 2000, "text": F.concat("text", F.lit(" Theend of it."))})
    docs.unionByName(more).unionByName(near).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    shutil.copy("/root/testdata/sf0.001/labels.parquet", folder)
    return str(folder)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    ruled = stages["quality_rules"](spark, docs, small).cache()
    assert {r.doc_id for r in ruled.collect()} == kept and ruled.columns == columns

    judged = {r.doc_id for r in quality_classifier.quality_classifier(ruled, labels).where("kept").collect()}
    good = stages["quality_classifier"](spark, ruled, small).cache()
    assert {r.doc_id for r in good.collect()} == judged and good.columns == columns

    left = sorted((k, rows[k]) for k in judged)
    single = stages["near_dedup"](spark, good, small).cache()
    heads = {k for k, _, c in brute_components(left) if k == c}
    assert {r.doc_id for r in single.collect()} == heads and single.columns == columns and len(heads) < len(left)

    cut = stages["substring_dedup"](spark, single, small).cache()
    want = {k: text for k, _, _, text in brute_strip(sorted((k, rows[k]) for k in heads))}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == columns

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in packed} == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in want.items()} and all(r.n == r.m for r in packed)


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names go through every stage; so does an empty table."""
    for name, docs in (("odd", odd), ("none", none)):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

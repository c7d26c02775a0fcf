import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from recordloom.llm import exact_dedup, mixing


@pytest.mark.parametrize("extra", [False, True])
def test_every_stage_on_hard_documents(spark, sf, extra):
    docs = brute.hard_documents(spark, extra=extra)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = sorted(r[0] or 0 for r in docs.select("doc_id").collect())
        assert docs.columns == columns or name == "bpe"
        if extra and name != "bpe":
            assert docs.filter("score <> 'x' or lang_pred <> 'x' or _found <> 'x'").count() == 0
    assert seen["language"] == [0, 4, 5, 5, 6, 7, 9, 10]
    assert seen["exact_dedup"] == [5, 6, 7, 9, 10]
    assert seen["near_dedup"] == [5, 6, 7, 9, 10]
    assert seen["bpe"] == seen["mixing"]


def test_every_stage_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], brute.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_run_equals_the_stages_one_by_one(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = documents.filter(F.col("text").rlike(r"\p{L}"))
    marks = {r[0]: brute.fingerprint(r[1]) for r in exact_dedup.deduplicated(kept).select("doc_id", "text").collect()}
    roots = brute.components(marks, lambda a, b: bin(a ^ b).count("1") <= 3)
    left = kept.filter(F.col("doc_id").isin([k for k, v in roots.items() if k == v]))
    want = mixing.mixed(left).groupBy("doc_id").count()
    found = corpus_pipeline.run(spark, sf).groupBy("doc_id").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lang_is_filled_only_where_missing(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    holes = docs.withColumn("lang", F.when(F.col("doc_id") % 10 > 0, F.col("lang")))
    out = corpus_pipeline.identify_language(spark, holes, sf)
    assert out.filter("lang is null").count() == 0
    same = out.join(docs.select("doc_id", F.col("lang").alias("was")), "doc_id")
    assert same.filter("doc_id % 10 > 0 and lang <> was").count() == 0
    assert same.filter("lang = was").count() > 0.97 * docs.count()

import brute
import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import mixing


def _plan(docs, **options):
    plan = F.col("_mix_plan")
    names = [c for c in ("doc_id", "source") if c in docs.columns]
    return mixing.plan_draws(docs, **options).select(
        *names, plan["size"].alias("words"), plan["source_size"].alias("total"), plan["target"].alias("goal"), plan["draws"].alias("draws")
    )


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300, 3) == [50, 100, 150]
    assert np.allclose(mixing.targets([10, 1000], [3, 1], 1010, 3), [30, 980])
    assert mixing.targets([0, 0], [1, 2], 0, 3) == [0, 0]
    assert mixing.targets([], [], 0, 3) == []


def test_quotas_are_exact():
    blocks = np.array([17, 0, 230, 1])
    quotas = mixing.split_quotas(blocks, 13, 1)
    assert (quotas.sum(axis=1) == blocks).all() and (quotas >= 0).all()
    sums = quotas.sum(axis=0)
    assert sums.max() - sums.min() <= 4
    assert (quotas == mixing.split_quotas(blocks, 13, 1)).all()


def test_taken_words_come_near_targets(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = _plan(docs, block_words=500).collect()
    sizes = {r[0]: len(brute.WORD.findall(r[1])) for r in docs.select("doc_id", "text").collect()}
    by_source: dict = {}
    for row in rows:
        assert row["words"] == sizes[row["doc_id"]]
        assert len(row["draws"]) <= 3
        entry = by_source.setdefault(row["source"], [0, 0, row["goal"], 0])
        entry[0] += row["words"]
        entry[1] += row["words"] * len(row["draws"])
        entry[3] = max(entry[3], row["words"])
    total = sum(e[0] for e in by_source.values())
    names = sorted(by_source, key=lambda s: (s is None, s))
    goal = mixing.targets([by_source[n][0] for n in names], [1 + i % 3 for i in range(len(names))], total, 3)
    for name, want in zip(names, goal, strict=True):
        size, taken, target, largest = by_source[name]
        assert abs(target - want) < 1e-6 * max(1, want)
        assert abs(taken - target) <= largest
        assert taken <= 3 * size


def test_draws_are_disjoint_and_shards_even(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "source")
    drawn = _plan(docs, shards=5, block_words=200).select("doc_id", F.explode("draws").alias("d"))
    assert drawn.select("doc_id", "d.round").distinct().count() == drawn.count()
    counts = [r[0] for r in drawn.groupBy("d.shard").count().select("count").collect()]
    assert len(counts) == 5 and max(counts) < 2 * min(counts)


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {(r[0], str(r[4])) for r in _plan(docs).select("doc_id", "words", "total", "goal", "draws").collect()}
    again = {(r[0], str(r[4])) for r in _plan(docs.repartition(7)).select("doc_id", "words", "total", "goal", "draws").collect()}
    assert first == again


def test_hard_documents_and_clashing_names(spark):
    docs = brute.hard_documents(spark)
    rows = mixing.plan_draws(docs)
    assert rows.columns == [*docs.columns, "_mix_plan"]
    assert rows.count() == docs.count()
    mixed = mixing.mixed(brute.hard_documents(spark, extra=False))
    assert mixed.columns == brute.hard_documents(spark, extra=False).columns
    assert mixed.filter("doc_id = 6").count() <= 3


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], brute.SCHEMA)).count() == 0

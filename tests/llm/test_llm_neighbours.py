import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import neighbours


def _check(rows, found, least):
    table = [(r[0], np.array(r[1], dtype=float)) for r in rows]
    ids, vectors = np.array([t[0] for t in table]), np.stack([t[1] for t in table])
    hit = total = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for query, got in by_query.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        at = vectors[np.flatnonzero(ids == query)[0]]
        for _, vec, score in got:
            assert vec != query
            assert abs(score - np.sqrt(((vectors[np.flatnonzero(ids == vec)[0]] - at) ** 2).sum())) < 1e-12
        want = brute.nearest(ids, vectors, query, 10)
        hit += len(set(want) & {g[1] for g in got})
        total += len(want)
    assert hit / total >= least
    return by_query


def test_recall_on_the_tables(spark):
    for size, least in (("0.001", 0.9), ("0.1", 0.9)):
        rows = spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet")
        found = neighbours.nearest(rows, F.col("vec_id") % 100 == 0).collect()
        by_query = _check(rows.select("vec_id", "embedding").collect(), found, least)
        assert len(by_query) == rows.filter("vec_id % 100 = 0").count()


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5, -1.0]) for i in range(40)]
    rows += [(100 + i, rng.normal(size=4).tolist()) for i in range(30)]
    odd = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4), (600, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (700, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    for name in ("id", "bucket", "vector", "query", "asks", "first_id"):
        df = df.withColumn(name, F.lit("x"))
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    by_query = _check(rows, found, 1.0)
    assert set(by_query) == {0, 100}
    assert [v for _, v, _ in by_query[0]] == list(range(1, 11))
    twice = neighbours.nearest(df.unionByName(df), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, found))


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_split_buckets_lose_nothing(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    ask = F.col("vec_id") % 100 == 0
    whole = {tuple(r) for r in neighbours.nearest(rows, ask).collect()}
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 2)
    assert {tuple(r) for r in neighbours.nearest(rows, ask).collect()} == whole


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3, 0), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("probes", [1, 10])
def test_first_probe_is_the_own_bucket(probes):
    x = np.random.default_rng(0).normal(size=(20, 64))
    unit = neighbours._unit(x)
    assert (neighbours.probe_codes(unit, 2, probes)[:, 0] == neighbours.bucket_codes(unit, 2)).all()

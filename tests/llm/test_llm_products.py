import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import top_products as P


def _brute(rows, step, k=5):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in whole if i % step == 0}):
        best = {}
        for i, asked in whole:
            for j, v in whole:
                if i == q and j != q and len(v) == len(asked):
                    best[j] = max(best.get(j, -math.inf), sum(a * b for a, b in zip(asked, v, strict=True)))
        cut = {j: max(-(2**63), min(2**63 - 1, s)) for j, s in best.items()}
        first = sorted(cut, key=lambda j: (-cut[j], j))[:k]
        out.extend((q, r + 1, j, cut[j]) for r, j in enumerate(first))
    return out


def _found(df, step, **more):
    return sorted(map(tuple, P.top_products(df, F.col("vec_id") % step == 0, **more).collect()))


def test_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    assert _found(df, 50) == _brute(rows, 50)


@pytest.mark.parametrize(("slice_bytes", "group_bytes"), [(1 << 23, 1 << 23), (4000, 700)])
def test_hard_vectors_in_one_cell_and_in_many(spark, monkeypatch, slice_bytes, group_bytes):
    monkeypatch.setattr(P, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(P, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, -2.0, 0.5]) for i in range(40)]  # copies, ties
    rows += [(100 + i, rng.normal(size=7).tolist()) for i in range(60)]
    rows += [(200 + i, (rng.normal(size=7) * 0.01).tolist()) for i in range(30)]
    rows += [(i, rng.normal(size=7).tolist()) for i in (100, 100, 103)]  # ids on several rows
    rows += [(300 + i, [float(i % 3)]) for i in range(10)] + [(400, []), (410, []), (411, [])]
    rows += [(500, None), (501, [None, 1.0, 2.0]), (502, [float("nan")] * 3), (503, [float("inf"), 0.0, 1.0]), (None, [1.0] * 3)]
    rows += [(510, [1e300] * 4), (511, [1e300, -1e300, 1e200, 0.0]), (512, [1e15, 1.0, -1e15, 3.0]), (513, [1e15, 2.0, 1e15, 1.0]), (514, [1e308] * 4)]
    rows += [(520, [0.0] * 3), (530, [-0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name in ("id", "vector", "asks", "cell", "least", "place", "slice", "group", "rank", "score"):
        df = df.withColumn(name, F.lit("x"))
    want = _brute(rows, 10)
    assert len(want) > 60
    assert _found(df, 10) == want
    assert _found(df.unionByName(df), 10) == want


def test_fewer_candidates_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert _found(df, 50) == [(0, 1, 1, 256 * 128)]
    assert _found(df.limit(0), 50) == []


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 64, 100):
        a, b = np.floor(rng.normal(size=(2, 40, size)) * 256)
        exact = a @ b.T
        for segments in (1, 4, 16, 64):
            upper = P.statistics(a, segments) @ P.statistics(b, segments).T
            assert (upper >= exact - 1e-6 * np.abs(exact).max()).all()
        # the finer resolution is never looser
        coarse, fine = (P.statistics(a, s) @ P.statistics(b, s).T for s in (1, size))
        assert (fine <= coarse + 1e-6 * np.abs(coarse).max()).all()


def test_most_pairs_drop_out_where_segments_differ():
    rng = np.random.default_rng(1)
    kinds = np.repeat(rng.normal(size=(40, 8)), 8, axis=1)
    x = np.floor(256 * (kinds[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 64))))
    ids = np.arange(8000)
    held, queries = P.Slice(ids, x), ids[::50]
    found = dict(held.best(queries, x[queries], np.full(len(queries), -np.inf), 5))
    exact = x[queries] @ x.T
    exact[np.arange(len(queries)), queries] = -np.inf
    for q, best in found.items():
        want = np.lexsort([ids, -exact[q]])[:5]
        assert [i for _, i in best] == want.tolist()
    assert held.left[-1] < 0.35 * len(queries) * len(x)
    assert held.left[0] > held.left[1] > held.left[2] > held.left[3]

import brute
from pyspark.sql import functions as F

from recordloom.llm import common, exact_dedup, simhash


def test_exact_groups_of_hard_documents(spark):
    docs = brute.hard_documents(spark)
    found = [tuple(r) for r in exact_dedup.duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted((r for r in found if r[0] is not None)) == [
        (1, 2, 3, False),
        (2, 2, 3, True),
        (3, 3, 1, True),
        (4, 5, 4, False),
        (5, 5, 4, True),
        (5, 5, 4, True),
        (6, 6, 1, True),
        (7, 7, 1, True),
        (8, 8, 1, True),
        (9, 9, 1, True),
        (10, 10, 1, True),
    ]
    assert sorted(r[1:] for r in found if r[0] is None) == [(2, 3, False), (5, 4, False)]


def test_exact_survivors_keep_all_columns_and_one_of_repeated_rows(spark):
    docs = brute.hard_documents(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [2, 3, 5, 6, 7, 8, 9, 10]


def test_heavy_and_ordinary_digests_agree_with_plain_grouping(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text")
    )
    found = exact_dedup.duplicate_groups(docs)
    plain = docs.groupBy("text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
    sizes = found.filter("kept").select("keep_id", "group_size")
    assert sizes.count() == plain.count()
    assert sizes.exceptAll(plain.select("keep", "n")).count() == 0


def test_frequent_items_include_every_hot_one(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert "hot" in {r[0] for r in exact_dedup.frequent(rows, "v").collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], brute.SCHEMA)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.near_deduplicated(none).count() == 0


def test_fingerprints_and_components_of_hard_documents(spark):
    docs = brute.hard_documents(spark)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect() if r[0] is not None}
    marks = {k: brute.fingerprint(t) for k, t in texts.items()}
    want = brute.components(marks, lambda a, b: bin(a ^ b).count("1") <= 3)
    found = simhash.near_groups(docs).collect()
    assert len(found) == docs.count()
    for row in found:
        if row["doc_id"] is not None:
            assert row["fingerprint"] % 2**64 == marks[row["doc_id"]]
            assert row["component_id"] == want[row["doc_id"]]
    assert sorted(r[0] or 0 for r in simhash.near_deduplicated(docs).select("doc_id").collect()) == [0, 0, 1, 4, 6, 7, 8, 9, 10]


def test_an_id_on_different_texts_stays_where_its_group_needs_it(spark):
    one, two = "the first text of all that are here", "something else that was written on another day"
    rows = [(1, one, "a"), (5, one, "a"), (5, two, "b"), (7, two, "b"), (None, two, "b"), (9, None, "c"), (5, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string")
    kept = simhash.near_deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_components_match_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r[0]: brute.fingerprint(r[1]) for r in docs.select("doc_id", "text").collect()}
    want = brute.components(marks, lambda a, b: bin(a ^ b).count("1") <= 3)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert found == want


def test_links_of_random_near_fingerprints(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    marks = set(rng.integers(0, 2**63, size=150, dtype=np.uint64).tolist())
    for mark in list(marks):
        for bits in (1, 2, 3, 4):
            flipped = mark
            for b in rng.choice(64, size=bits, replace=False).tolist():
                flipped ^= 1 << b
            marks.add(flipped)
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()}
    values = [s[0] for s in signed]
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    assert found == want


def test_thresholds_sum_to_the_budget_and_cost_least():
    import numpy as np

    rng = np.random.default_rng(1)
    cost = rng.random((4, 5, 20))
    chosen = simhash.allocate(cost, 0)
    assert (chosen.sum(axis=1) == 0).all()
    levels = [(a, b, c, -a - b - c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if -1 <= -a - b - c <= 3]
    for r in range(20):
        best = min(sum(cost[p, t[p] + 1, r] for p in range(4)) for t in levels)
        assert abs(sum(cost[p, chosen[r, p] + 1, r] for p in range(4)) - best) < 1e-12


def test_connected_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    found = dict(map(tuple, common.connected(spark.createDataFrame(path + star, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 150), 100)}


def test_attach_splits_hot_keys_and_loses_no_row(spark):
    left = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    right = counts.select("k", (F.col("k") + 1).alias("w"))
    found = common.attach(left, right, "k", counts, 4000)
    assert found.count() == 4000 and found.filter("w <> k + 1").count() == 0

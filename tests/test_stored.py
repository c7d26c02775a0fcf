import os
import re

from pyspark.sql import functions as F

from recordloom.operators.stored import StoredSnapshot

SCHEMA = "id string, n int"


def _made(spark, path, rows, parts=16):
    return StoredSnapshot.create(spark.createDataFrame(rows, SCHEMA), str(path), "id", parts, 2)


def _files(path):
    return {os.path.join(f, n) for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_batch_rewrites_the_parts_of_its_keys_only(spark, tmp_path, rowset):
    stored = _made(spark, tmp_path / "t", [(f"k{i}", i) for i in range(500)])
    before = _files(tmp_path / "t")
    parts = stored.merge(spark.createDataFrame([("k7", -7), ("new", 1)], SCHEMA))
    after = _files(tmp_path / "t")
    assert 1 <= len(parts) <= 2
    rewritten = {int(re.search(r"_part=(\d+)", f)[1]) for f in before ^ after}
    assert rewritten == set(parts)
    expected = [(f"k{i}", -7 if i == 7 else i) for i in range(500)] + [("new", 1)]
    assert rowset(stored.read()) == sorted(expected, key=repr)
    assert rowset(stored.lookup("k7")) == [("k7", -7)] and rowset(stored.lookup("k501")) == []


def test_a_merge_may_run_again(spark, tmp_path, rowset):
    stored = _made(spark, tmp_path / "t", [("a", 1), ("b", 2), (None, 3)])
    change = spark.createDataFrame([("b", 5), ("c", 6), (None, 7)], SCHEMA)
    for _ in range(2):
        stored.merge(change, spark.createDataFrame([("a",), ("a",), ("zz",)], "id string"))
        assert rowset(stored.read()) == [("b", 5), ("c", 6)]
    stored.merge(spark.createDataFrame([("a", 9)], SCHEMA))  # a deleted key comes back
    assert rowset(stored.read()) == [("a", 9), ("b", 5), ("c", 6)]


def test_a_part_may_lose_all_its_rows(spark, tmp_path, rowset):
    stored = _made(spark, tmp_path / "t", [("a", 1), ("b", 2)], parts=1)
    both = spark.createDataFrame([("a",), ("b",)], "id string")
    stored.merge(spark.createDataFrame([("a", 4)], SCHEMA), both)  # deleted wins
    assert rowset(stored.read()) == []
    assert stored.merge(spark.createDataFrame([], SCHEMA)) == []


def test_an_empty_snapshot_takes_rows(spark, tmp_path, rowset):
    stored = _made(spark, tmp_path / "t", [])
    assert rowset(stored.near(spark.createDataFrame([("a",)], "id string"))) == []
    stored.merge(spark.createDataFrame([("a", 1)], SCHEMA).withColumn("more", F.lit(1)))
    assert rowset(stored.read()) == [("a", 1)]


def test_the_snapshot_is_not_shuffled(spark, tmp_path):
    stored = _made(spark, tmp_path / "t", [(f"k{i}", i) for i in range(100)])
    change = spark.createDataFrame([("k1", 0)], SCHEMA).withColumn("_deleted", F.lit(False))
    plan = stored._merged(change, stored.touched(change))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1  # that of the changes
    assert "Bucketed: true" in plan
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan

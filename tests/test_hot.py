"""Hot keys in joins, batch search without all pairs, and faults found in order."""

import pytest
from pyspark.sql import functions as F

from recordloom.catalog import tables as B
from recordloom.functions import hot
from recordloom.operators import histories as H
from recordloom.operators import information as I
from recordloom.operators import lifecycle as L
from recordloom.operators import memories as M
from recordloom.plans import decisions as D

ACTION = "thread_id string, pos int, action_id string, description string, status string, metadata string"


def skewed(spark, rows=20_000):
    """80 % of the rows bear one key, some none."""
    i = F.col("id")
    key = F.when(i % 10 < 8, "hot").when(i % 10 == 8, F.concat(F.lit("k"), i % 500))
    return spark.range(rows).select(key.alias("key"), i.alias("seq"))


def test_no_task_of_a_join_holds_the_hot_key(spark):
    left = skewed(spark)
    right = left.filter("key is not null").select("key").distinct().withColumn("value", F.length("key"))
    spread = hot.spread_over(left, "key", hot_rows=100)
    joined = spread.salted(left, "seq").join(spread.copied(right), ["key", hot.SALT], "left")
    assert joined.count() == left.count()
    assert joined.filter("key is not null and (value is null or value <> length(key))").count() == 0
    groups = joined.groupBy("key", hot.SALT).count()
    assert groups.agg(F.max("count")).first()[0] < 20_000 / 20
    assert spread.hot.count() <= hot.HOT_SHARE


def test_operators_agree_when_every_key_is_split(spark, sf, rowset, monkeypatch):
    def run():
        replayed = L.replay_commands(B.threads(spark, sf), B.thread_actions(spark, sf), B.commands(spark, sf)).rows.drop("chunk")
        stored = M.store_batch(B.memories(spark, sf), B.memory_arrivals(spark, sf))[1]
        updated = M.update_batch(B.memories(spark, sf), B.memory_updates(spark, sf))[1]
        manual = I.manual_updates(B.information(spark, sf), B.manual_updates(spark, sf), "now")[2]
        reviewed = I.resolve_reviews(B.reviews(spark, sf), B.information(spark, sf), B.review_decisions(spark, sf), "now")[3]
        return [rowset(df) for df in (replayed, stored, updated, manual, reviewed)]

    whole = run()
    monkeypatch.setattr(hot, "HOT_ROWS", 2)
    monkeypatch.setattr(hot, "HOT_SHARE", 10_000)
    assert run() == whole


@pytest.mark.parametrize(
    ("actions", "error"),
    [
        ([("a", "ok"), ("a", "again"), ("b", " ")], "duplicate action_id: a"),
        ([("a", "ok"), ("b", " "), ("a", "again")], "action description is required: b"),
        ([("a", "ok"), ("", " "), ("a", "again")], "action_id is required"),
        ([("a", "ok"), ("a", " ")], "action description is required: a"),
        ([("a", "ok"), ("b", "ok")], None),
    ],
)
def test_first_fault_is_that_of_the_first_action(spark, actions, error):
    threads = spark.createDataFrame(
        [("t", "title", "objective", "TESTING", 1, "c", "u", None)],
        "thread_id string, title string, objective string, status string, revision int, created_at string, updated_at string, completed_at string",
    )
    rows = spark.createDataFrame([("t", i, a, d, "PLANNED", "{}") for i, (a, d) in enumerate(actions)], ACTION)
    assert L.thread_errors(threads, rows).first()["error"] == error


def test_ledger_repeats_count_once(spark):
    plans = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h")], "operation_id string, execution_plan_hash string")
    ledger = spark.createDataFrame(
        [("a", "h"), ("a", "h"), ("b", "x"), ("c", "h"), ("c", "x"), ("e", None)], "operation_id string, execution_plan_hash string"
    )
    found = {r["operation_id"]: r["idempotency"] for r in D.idempotency(plans, ledger).collect()}
    assert found == {"a": "ALREADY_EXECUTED", "b": "CONFLICT", "c": "CONFLICT", "d": "NEW"}
    assert D.idempotency(plans, ledger).count() == 4


def test_empty_operational_state_blocks_a_review(spark, sf):
    information = B.information(spark, sf).withColumn("operational_state", F.lit(""))
    outcomes = I.resolve_reviews(B.reviews(spark, sf), information, B.review_decisions(spark, sf), "now")[3]
    found = {r[0] for r in outcomes.select("outcome").distinct().collect()}
    assert "RESOLVED" not in found and "INVALID_OPERATIONAL_STATE" in found


def test_contradictions_of_a_hub_are_split_without_a_change(spark, monkeypatch):
    relations = spark.createDataFrame(
        [("hub", "CONTRADICTS", f"n{i}") for i in range(40)] + [(f"n{i}", "CONTRADICTS", "hub") for i in range(30)] + [("n1", "SUPPORTS", "hub"), (None, "CONTRADICTS", "hub")],
        "source_id string, type string, target_id string",
    )
    statuses = [("hub", "CONFIRMED")] + [(f"n{i}", ("REFUTED", "DOUBTFUL", "SUPERSEDED")[i % 3]) for i in range(35)]
    information = spark.createDataFrame(statuses, "id string, epistemic_status string")
    whole = sorted(map(tuple, H.open_contradictions(information, relations).collect()))
    assert len(whole) == 12 + 10
    monkeypatch.setattr(hot, "HOT_ROWS", 2)
    monkeypatch.setattr(hot, "HOT_SHARE", 10_000)
    assert sorted(map(tuple, H.open_contradictions(information, relations).collect())) == whole

"""Order, paging and validation quirks of thread queries."""

import pytest
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.operators import lifecycle as L
from recordloom.operators import memories as M
from recordloom.operators import threads as T

SCHEMA = (
    "thread_id string, title string, objective string, status string, revision int, context string, created_at string, "
    "updated_at string, started_at string, completed_at string, provenance map<string,string>"
)


def thread(name, status="TESTING", updated="2026-09-10", **over):
    row = dict(thread_id=name, title=name, objective="o", status=status, revision=1, context="{}", created_at="2026-01-01",
               updated_at=updated, started_at=None, completed_at=None, provenance={})
    row.update(over)
    return tuple(row.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return [r.thread_id for r in df.collect()]


def test_ties_keep_file_order_both_ways(spark):
    df = frame(spark, thread("a"), thread("a-b"))
    assert ids(T.list_threads(df)) == ["a-b", "a"] == ids(T.list_threads(df, sort_order="ASC"))


def test_default_order_and_pages(spark):
    df = frame(spark, thread("x", updated="2026-09-10"), thread("y", updated="2026-09-11"), thread("z", updated="2026-09-12"))
    assert ids(T.list_threads(df)) == ["z", "y", "x"]
    assert ids(T.list_threads(df, limit=1, offset=1)) == ["y"]


def test_open_and_status_lists(spark):
    df = frame(spark, thread("o"), thread("c", "COMPLETED", completed_at="x"), thread("d", "CANCELLED"))
    assert ids(T.list_open_threads(df)) == ["o"]
    assert sorted(ids(T.list_threads(df))) == ["c", "d", "o"]
    assert ids(T.list_threads_by_status(df, status="CANCELLED")) == ["d"]


@pytest.mark.parametrize(
    "call",
    [
        lambda d: T.get_thread(d, ""),
        lambda d: T.list_threads_by_status(d),
        lambda d: T.list_threads(d, limit=1001),
        lambda d: T.list_threads(d, limit=0),
        lambda d: T.list_threads(d, offset=-1),
        lambda d: T.list_threads(d, title=" "),
        lambda d: T.list_threads(d, title_contains=""),
        lambda d: T.list_threads(d, sort_by="UPDATED_AT"),
        lambda d: T.list_thread_actions(d, d, action_id="a"),
    ],
)
def test_bad_queries(spark, call):
    with pytest.raises(T.QueryError):
        call(frame(spark, thread("a")))


def test_casefold_and_offsets(spark):
    df = frame(spark, thread("a", title="STRASSE ﬁn ΣΑΣ"), thread("b", title="Straße FIN σας", created_at="2026-01-01T01:00:00+02:00"))
    for needle in ("straße", "FIN", "σασ"):
        assert sorted(ids(T.list_threads(df, title_contains=needle))) == ["a", "b"]
    got = df.select(X.casefold(F.col("title")).alias("t"), "title").collect()
    assert all(r.t == r.title.casefold() for r in got)
    # as text 01:00+02:00 comes after 00:30Z; as an instant it is before
    after = dict(created_after="2026-01-01T00:30:00Z")
    assert ids(T.list_threads(df, **after)) == ["b"]
    assert ids(T.list_threads(df, as_instants=True, **after)) == []


def test_nested_relations(spark):
    df = frame(spark, thread("a"), thread("b")).withColumn(
        "relations",
        F.when(
            F.col("thread_id") == "a",
            F.array(
                F.struct(F.lit("PART_OF").alias("type"), F.lit("a").alias("source_id"), F.lit("x").alias("target_id")),
                F.struct(F.lit("FOLLOWS").alias("type"), F.lit("a").alias("source_id"), F.lit("y").alias("target_id")),
            ),
        ).otherwise(F.array()),
    )
    # the two filters may be met by different relations
    assert ids(T.list_threads(df, relation_type="PART_OF", related_to="y")) == ["a"]
    assert ids(T.list_threads(df, relation_type="DEPENDS_ON")) == []


def test_all_status_pairs(spark):
    pairs = spark.createDataFrame([(a, b) for a in K.THREAD_STATUSES for b in K.THREAD_STATUSES], "a string, b string")
    got = pairs.withColumn("e", L.transition_error(F.col("a"), F.col("b"))).collect()
    for r in got:
        want = "SAME_STATUS" if r.a == r.b else None if r.b in K.THREAD_TRANSITIONS[r.a] else "INVALID_TRANSITION"
        assert r.e == want


def test_command_log_order(spark):
    threads = frame(spark, thread("a", "VALIDATED"), thread("bad", title=" "))
    actions = spark.createDataFrame([("a", 0, "x", "d", "COMPLETED", "{}")], "thread_id string, pos int, action_id string, description string, status string, metadata string")
    log = [
        (1, "a", "SET_STATUS", "TESTING", None, None),
        (2, "a", "SET_STATUS", "IMPLEMENTATION", None, None),
        (3, "a", "ADD_ACTION", "PLANNED", "x", "again"),
        (4, "a", "ADD_ACTION", "PLANNED", "y", "new"),
        (5, "a", "SET_ACTION_STATUS", "PLANNED", "y", None),
        (6, "a", "SET_STATUS", "CANCELLED", None, None),
        (7, "a", "ADD_ACTION", "PLANNED", "z", "late"),
        (8, "bad", "SET_STATUS", "COMPLETED", None, None),
        (9, "none", "SET_STATUS", "COMPLETED", None, None),
    ]
    commands = spark.createDataFrame(
        [(s, t, f"at{s}", k, st, a, d) for s, t, k, st, a, d in log],
        "seq long, thread_id string, at string, kind string, status string, action_id string, description string",
    )
    after, steps, outcomes, events = L.apply_commands(threads, actions, commands)
    assert [r.outcome for r in outcomes.orderBy("seq").collect()] == [
        "INVALID_TRANSITION", "OK", "DUPLICATE_ACTION", "OK", "OK", "OK", "CLOSED_THREAD", "INVALID_THREAD", "THREAD_NOT_FOUND",
    ]
    a = after.filter("thread_id = 'a'").first()
    assert (a.status, a.revision, a.started_at, a.updated_at, a.completed_at) == ("CANCELLED", 5, "at2", "at6", None)
    assert [(r.action_id, r.status) for r in steps.orderBy("pos").collect()] == [("x", "COMPLETED"), ("y", "PLANNED")]
    assert [r.revision for r in events.orderBy("revision").collect()] == [2, 5]


def test_memory_filters(spark):
    memories = spark.createDataFrame(
        [("a", 1, {"lang": '"fr"'}), ("b", 1, {"revision": "1", "n": "1.0"})], "information_id string, revision int, metadata map<string,string>"
    )
    found = lambda f: [r.information_id for r in M.list_memories(memories, f).collect()]
    assert found({"lang": "fr"}) == ["a"]
    assert found({"revision": 1}) == ["b"]
    assert found({"n": 1}) == ["b"]
    assert found({"n": "1.0"}) == []


def test_ids(spark):
    names = ["ok-1_a.b", "", "../escape", "thread/test", "thread test", "thread@test", "line\n"]
    got = spark.createDataFrame([(n,) for n in names], "information_id string")
    assert M.invalid_ids(got).count() == 6


def test_canonical_json_control_characters(spark):
    import json

    text = 'é "q" \\u001B \x1b \x0b \n \\\x1f'
    row = spark.createDataFrame([(text,)], "t string").select(X.json_string(F.col("t")).alias("j")).first()
    assert row.j == json.dumps(text, ensure_ascii=False)

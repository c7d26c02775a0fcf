"""Keyed stream state: stream equals batch, late commands, repeats that expire, restarts."""

import pytest
from pyspark.sql import functions as F

from recordloom.catalog import queries as Q
from recordloom.catalog import tables as B
from recordloom.operators import lifecycle as L
from recordloom.streaming import fold
from recordloom.streaming.dedupe import dedupe_stream, judge_batch

SHOWN = ("seq", "thread_id", "before_status", "outcome", "revision")
PLAN = "seq long, operation_id string, execution_plan_hash string"
LEDGER = "operation_id string, execution_plan_hash string"


def _command(seq, thread, status, kind="SET_STATUS", action=None, text=None):
    return (thread, seq, f"t{seq}", kind, status, action, text)


def _stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture(scope="module")
def threads(spark):
    rows = [(t, "title", "objective", "VALIDATED", 1, "c", "u", None, None) for t in ("a", "b")]
    rows.append(("bad", "", "objective", "VALIDATED", 4, "c", "u", None, None))
    return spark.createDataFrame(
        rows,
        "thread_id string, title string, objective string, status string, revision int, created_at string, updated_at string, started_at string, completed_at string",
    )


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame(
        [("a", 1, "one", "text", "PLANNED", "{}")], "thread_id string, pos int, action_id string, description string, status string, metadata string"
    )


LOG = [
    _command(1, "a", "IMPLEMENTATION"),
    _command(2, "b", "nonsense"),
    _command(3, "a", "IMPLEMENTATION"),
    _command(4, "a", "PLANNED", "ADD_ACTION", "one", "again"),
    _command(5, "a", "PLANNED", "ADD_ACTION", "two", "new"),
    _command(6, "a", "BLOCKED", "SET_ACTION_STATUS", "two"),
    _command(7, "nobody", "TESTING"),
    _command(8, "bad", "TESTING"),
    _command(9, "a", "PLANNED", "ADD_ACTION", "three", " "),
    _command(10, "a", "CANCELLED"),
    _command(11, "a", "BLOCKED", "SET_ACTION_STATUS", "one"),
    _command(12, "b", "BLOCKED", "SET_ACTION_STATUS", "none"),
    _command(13, "b", None, "OTHER"),
    _command(14, None, "TESTING"),
]


def _batch(spark, threads, actions, rows):
    commands = spark.createDataFrame(rows, fold.COMMAND)
    return sorted(map(tuple, L.replay_commands(threads, actions, commands).rows.select(*SHOWN).collect()), key=repr)


def _rows(fold_):
    return sorted(map(tuple, fold_.outcomes().select(*SHOWN).collect()), key=repr)


@pytest.mark.parametrize("loaded", [False, True])
def test_a_log_in_order_gives_the_outcomes_of_a_batch_and_goes_on_after_a_restart(spark, threads, actions, tmp_path, loaded):
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    first = _stream(spark, tmp_path, [LOG[:5], LOG[5:9]], fold.COMMAND)
    kept.start(first, threads, actions, loaded=loaded).awaitTermination()
    assert _rows(kept) == _batch(spark, threads, actions, LOG[:9])
    again = _stream(spark, tmp_path, [LOG[9:]], fold.COMMAND)
    kept.start(again, threads, actions, loaded=loaded).awaitTermination()
    assert _rows(kept) == _batch(spark, threads, actions, LOG)
    state = {r["thread_id"]: (r["status"], r["revision"], r["started_at"], r["updated_at"]) for r in kept.states().collect()}
    assert state["a"] == ("CANCELLED", 5, "t1", "t10") and state["b"][:2] == ("VALIDATED", 1)
    moves = sorted((r["thread_id"], r["before"], r["after"]) for r in kept.history().collect())
    assert moves == [("a", "IMPLEMENTATION", "CANCELLED"), ("a", "VALIDATED", "IMPLEMENTATION")]


def test_commands_in_any_order_wait_for_the_watermark(spark, threads, actions, tmp_path):
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    shuffled = [LOG[i::4] for i in (3, 1, 0, 2)]
    closing = [tuple(fold.closing_command(spark, 14, 14).first())]
    kept.start(_stream(spark, tmp_path, [*shuffled, closing], fold.COMMAND), threads, actions, delay=14).awaitTermination()
    assert _rows(kept) == _batch(spark, threads, actions, LOG)


def test_late_commands_are_reported_and_change_nothing(spark, threads, actions, tmp_path):
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    log = [_command(1, "a", "IMPLEMENTATION"), _command(5, "a", "TESTING"), _command(3, "b", "IMPLEMENTATION")]
    far, more = [_command(100, "b", "TESTING")], [_command(101, "b", "PAUSED")]
    # 4 comes after 5 was applied; 50 waits and is in time
    late = [_command(4, "a", "CANCELLED"), _command(50, "a", "PAUSED"), _command(200, "b", "nonsense")]
    # Spark drops late rows by the watermark of the batch before the last
    then = [[_command(201, "b", "PAUSED")], [_command(202, "b", "PAUSED")]]
    lost = [_command(6, "b", "CANCELLED")]
    closing = [_command(5000, "", None)]
    stream = _stream(spark, tmp_path, [log, far, more, late, *then, lost, closing], fold.COMMAND)
    query = kept.start(stream, threads, actions, delay=10, report=150)
    query.awaitTermination()
    found = {(r["thread_id"], r["seq"]): r["outcome"] for r in kept.outcomes().collect()}
    on_time = [*log, *far, *more, late[1], late[2], *then[0], *then[1]]
    want = {(r[1], r[0]): r[3] for r in _batch(spark, threads, actions, on_time)}
    assert found == want | {("a", 4): fold.LATE}
    dropped = sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 1  # number 6 of thread b


def test_stream_equals_batch_on_the_table(spark, sf, tmp_path):
    threads, actions = B.threads(spark, sf), B.thread_actions(spark, sf)
    commands = B.commands_of(B.read(spark, sf, "events"))
    batch = L.replay_commands(threads, actions, commands).rows.select(*SHOWN)
    commands.orderBy("seq").coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    stream = spark.readStream.schema(commands.schema).parquet(f"{tmp_path}/in")
    kept.start(stream, threads, actions).awaitTermination()
    assert sorted(map(tuple, kept.outcomes().select(*SHOWN).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def _judged(spark, folder):
    rows = spark.read.parquet(f"{folder}/judged").collect()
    return sorted((r["seq"], r["operation_id"], r["execution_plan_hash"], r["idempotency"]) for r in rows)


def test_conflicts_are_found_however_late_and_repeats_until_they_expire(spark, tmp_path):
    ledger = spark.createDataFrame([("old", "h"), ("old", "h"), ("torn", "h"), ("torn", "g"), ("none", None)], LEDGER)
    first = [(1, "new", "h"), (2, "new", "h"), (3, "old", "h"), (4, "old", "x"), (5, "torn", "h"), (6, "none", "h")]
    dedupe_stream(spark, _stream(spark, tmp_path, [first], PLAN), ledger, f"{tmp_path}/judged", f"{tmp_path}/cp").awaitTermination()
    want = [
        (1, "new", "h", "NEW"),
        (3, "old", "h", "ALREADY_EXECUTED"),
        (4, "old", "x", "CONFLICT"),
        (5, "torn", "h", "CONFLICT"),
        (6, "none", "h", "CONFLICT"),
    ]
    assert _judged(spark, tmp_path) == want
    # state, not old results, tells repeats and conflicts apart after a restart
    second = [(7, "new", "h"), (8, "new", "g"), (9, "old", "h")]
    dedupe_stream(spark, _stream(spark, tmp_path, [second], PLAN), ledger, f"{tmp_path}/judged", f"{tmp_path}/cp").awaitTermination()
    assert _judged(spark, tmp_path) == [*want, (8, "new", "g", "CONFLICT")]


def test_expired_repeats_are_reported_again(spark, tmp_path):
    batches = [[(1, "n", "h")], [(2, "n", "h"), (3, "n", "g")]]
    ledger = spark.createDataFrame([], LEDGER)
    args = (ledger, f"{tmp_path}/judged", f"{tmp_path}/cp", 0)
    dedupe_stream(spark, _stream(spark, tmp_path, batches[:1], PLAN), *args[:3], ttl_hours=1e-7).awaitTermination()
    dedupe_stream(spark, _stream(spark, tmp_path, batches[1:], PLAN), *args[:3], ttl_hours=1e-7).awaitTermination()
    assert _judged(spark, tmp_path) == [(1, "n", "h", "NEW"), (2, "n", "h", "ALREADY_EXECUTED"), (3, "n", "g", "CONFLICT")]


def test_first_batch_equals_the_batch_judgement(spark, tmp_path):
    rows = [(i, f"op{i % 13}", f"h{i % 3}") for i in range(200)]
    plans, ledger = spark.createDataFrame(rows, PLAN), spark.createDataFrame([("op2", "h1"), ("op5", "zz")], LEDGER)
    want = judge_batch(plans, ledger).groupBy("operation_id", "execution_plan_hash").agg(F.min_by("idempotency", "seq").alias("idempotency"))
    dedupe_stream(spark, _stream(spark, tmp_path, [rows], PLAN), ledger, f"{tmp_path}/judged", f"{tmp_path}/cp").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/judged").select("operation_id", "execution_plan_hash", "idempotency")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_waiting_commands_of_a_thread_are_one_element_of_its_state(spark, threads, actions, tmp_path):
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    odd = [_command(i, "a", None, f'"kind\\ {i}\n\u2028', None, "ä, ]") for i in range(20, 30)]
    kept.start(_stream(spark, tmp_path, [LOG[:6] + odd, LOG[6:]], fold.COMMAND), threads, actions, delay=100).awaitTermination()
    held = spark.read.format("statestore").option("path", f"{kept.root}/checkpoint").option("stateVarName", "held").load()
    assert held.filter("key.thread_id = 'a'").count() == 2
    closing = [tuple(fold.closing_command(spark, 30, 100).first())]
    kept.start(_stream(spark, tmp_path, [closing], fold.COMMAND), threads, actions, delay=100).awaitTermination()
    assert _rows(kept) == _batch(spark, threads, actions, LOG + odd)


def test_more_outcomes_than_a_row_holds(spark, threads, actions, tmp_path, monkeypatch):
    monkeypatch.setattr(fold, "BUNDLE", 3)
    kept = fold.CommandFold(spark, f"{tmp_path}/fold")
    closing = [tuple(fold.closing_command(spark, 14, 14).first())]
    kept.start(_stream(spark, tmp_path, [LOG[::-1], closing], fold.COMMAND), threads, actions, delay=14).awaitTermination()
    assert _rows(kept) == _batch(spark, threads, actions, LOG)


@pytest.mark.parametrize(("name", "batch", "limit"), [("stream_shuffled_commands", "stream_command_outcomes", ("FILE_COMMANDS", 100)), ("stream_ingest", "stream_ingest", ("FILE_BYTES", 50_000))])
def test_input_files_of_a_stream_have_a_bounded_size(spark, sf, tmp_path, monkeypatch, rowset, name, batch, limit):
    want = rowset(Q.QUERIES[batch](spark, sf))
    monkeypatch.setattr(Q, "_scratch", lambda spark: f"{tmp_path}")
    monkeypatch.setattr(Q, *limit)
    assert rowset(Q.QUERIES[name](spark, sf)) == want
    inputs = [f for f in (tmp_path / "in").iterdir() if f.name.startswith("part-")]
    assert len(inputs) > 8
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) <= 4

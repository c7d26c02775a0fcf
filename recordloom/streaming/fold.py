"""The command log as a stream, with the state of each thread in Spark's state store.

A keyed processor holds what commands can change: the status, revision and times of a thread
(value state), the actions added to it (map state) and commands that came too early (list state).
What a thread was before the stream is either loaded into the store once, or looked up by a join
with the tables in each micro-batch and used where the store doesn't know the thread yet.
The store does versions, recovery and compaction; a query that starts again goes on from
its checkpoint, and the file sink writes each outcome once.

By default the source delivers the log in order, and the commands of a micro-batch are applied in
order of ``seq``.  With ``delay`` commands may come up to that many numbers late: ``seq`` is the
event time, commands wait until the watermark has passed them and are then applied in order.

Every cell of a row and every element of a state costs a conversion or a call on its way to Python, so
a command travels and waits as one JSON array, those of a thread wait in bundles, and outcomes
leave in rows of many, which Spark takes apart.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from recordloom import constants as K
from recordloom.functions.ordered import Chunked
from recordloom.functions.sizing import stable
from recordloom.operators.lifecycle import status_events, thread_errors

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
IDLE_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"
COMMAND = "thread_id string, seq long, at string, kind string, status string, action_id string, description string"
#: What the tables say of a command's thread, and whether they hold its action.
STORED = (
    "stored_status string, stored_revision string, stored_valid boolean, stored_started string, stored_updated string, "
    "stored_completed string, stored_action boolean"
)
OUTCOME = COMMAND + ", before_status string, outcome string, revision int"
#: A command that came after later ones of its thread were applied.
LATE = "LATE_COMMAND"
THREAD = "status string, revision int, valid boolean, started_at string, updated_at string, completed_at string, last_seq long"


def with_store(spark: SparkSession, start: Callable[[], StreamingQuery], idle: bool = True) -> StreamingQuery:
    """Start a query on the state store that processors need; the session's own settings come back.

    Without ``idle`` the query runs no batch without data.  One that counts in processing time would
    otherwise run such batches for ever, as time goes on.
    """
    wanted = {STORE_CONF: STORE, IDLE_CONF: str(idle).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def status_outcome(current: str, target: str | None) -> str:
    if target not in K.THREAD_STATUSES:
        return "INVALID_STATUS"
    if current == target:
        return "SAME_STATUS"
    return "OK" if target in K.THREAD_TRANSITIONS[current] else "INVALID_TRANSITION"


NAMES = tuple(field.strip().split(" ")[0] for field in f"{COMMAND}, {STORED}".split(","))
GIVEN = NAMES[:7]
#: A command beside its thread, all fields as text.
Command = namedtuple("Command", NAMES[1:])  # noqa: PYI024
SHOWN = tuple(field.strip().split(" ")[0] for field in OUTCOME.split(","))[1:]
#: Outcomes of one thread, side by side.
OUTCOMES = "thread_id string, " + ", ".join(
    "{} array<{}>".format(*field.strip().split(" ")) for field in OUTCOME.split(",")[1:]
)
#: Commands of a bundle, and outcomes of a row.
BUNDLE = 1000


def bundles(commands: list[str]) -> list[tuple[str]]:
    """JSON arrays of commands that are JSON themselves."""
    return [(f"[{','.join(commands[low : low + BUNDLE])}]",) for low in range(0, len(commands), BUNDLE)]


def in_order(bundled: list[tuple[str]]) -> list[tuple[int | None, Command]]:
    """(seq, command) of bundles, by seq."""
    read = [Command._make(c) for (bundle,) in bundled for c in json.loads(bundle)]
    numbered = [(None if c.seq is None else int(c.seq), c) for c in read]
    return sorted(numbered, key=lambda n: n[0])


def outcome_rows(thread_id: str | None, outcomes: list[tuple]) -> Iterator[Row]:
    for low in range(0, len(outcomes), BUNDLE):
        columns = zip(*outcomes[low : low + BUNDLE], strict=True)
        yield Row(thread_id=thread_id, **dict(zip(SHOWN, map(list, columns), strict=True)))


def outcome_of(seq: int | None, command: Command, before: str | None, outcome: str, revision: int | None) -> tuple:
    return (seq, *command[1 : len(GIVEN) - 1], before, outcome, revision)


def action_outcome(command: Command, closed: bool, there: bool) -> str:
    if command.kind not in ("ADD_ACTION", "SET_ACTION_STATUS"):
        return "UNKNOWN_COMMAND"
    if command.status not in K.ACTION_STATUSES:
        return "INVALID_STATUS"
    if closed:
        return "CLOSED_THREAD"
    if command.kind == "SET_ACTION_STATUS":
        return "OK" if there else "ACTION_NOT_FOUND"
    if there:
        return "DUPLICATE_ACTION"
    sound = command.action_id and (command.description or "").strip()
    return "OK" if sound else "INVALID_ACTION"


class ThreadProcessor(StatefulProcessor):
    """Applies the commands of one thread; see the module."""

    def __init__(self, delay: int | None) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", THREAD)
        self.stored = handle.getValueState("stored_actions", "action_ids array<string>")
        self.added = handle.getMapState("added_actions", "action_id string", "status string")
        self.held = handle.getListState("held", "commands string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N803
        row = initialState
        self.thread.update((row["status"], row["revision"], row["valid"], row["started_at"], row["updated_at"], row["completed_at"], None))
        if row["action_ids"]:
            self.stored.update((row["action_ids"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N803
        if self.delay is None:
            yield from outcome_rows(key[0], self._apply(in_order(bundles([r[2] for r in rows]))))
            return
        state = self.thread.get()
        last = state[6] if state else None
        late, waiting, first = [], [], None
        for _, seq, command, *_ in rows:
            if last is not None and seq < last:
                late.append(command)
            else:
                waiting.append(command)
                first = seq if first is None else min(first, seq)
        refused = in_order(bundles(late))
        yield from outcome_rows(key[0], [outcome_of(seq, c, None, LATE, state[1]) for seq, c in refused])
        if waiting:
            self.held.appendList(bundles(waiting))
            self.handle.registerTimer(first + self.delay + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N803
        """Apply what the watermark has passed; the rest waits for a timer of its first command."""
        passed = timerValues.getCurrentWatermarkInMs() - self.delay - 1
        held = in_order(self.held.get()) if self.held.exists() else []
        ready = [(seq, c) for seq, c in held if seq <= passed]
        later = held[len(ready) :]
        if not ready:
            return
        yield from outcome_rows(key[0], self._apply(ready))
        if later:
            self.held.put(bundles([json.dumps(c, ensure_ascii=False) for _, c in later]))
            self.handle.registerTimer(later[0][0] + self.delay + 1)
        else:
            self.held.clear()

    def _apply(self, commands: list[tuple[int | None, Command]]) -> list[tuple]:
        if not commands:
            return []
        state = self.thread.get()
        begin = commands[0][1]
        if state is None and begin.stored_valid is not None:
            revision = begin.stored_revision and int(begin.stored_revision)
            times = (begin.stored_started, begin.stored_updated, begin.stored_completed)
            state = (begin.stored_status, revision, begin.stored_valid == "true", *times, None)
        if state is None:
            # without a thread there is nothing that order could change
            return [outcome_of(seq, c, None, "THREAD_NOT_FOUND", None) for seq, c in commands]
        status, revision, valid, started, updated, completed, _ = state
        there: dict[str, bool] | None = None
        added_before = False
        out = []
        for seq, command in commands:
            if not valid:
                out.append(outcome_of(seq, command, None, "INVALID_THREAD", revision))
                continue
            before = None
            if command.kind == "SET_STATUS":
                before, outcome = status, status_outcome(status, command.status)
            else:
                action = command.action_id or ""
                if there is None:
                    known = self.stored.get()
                    there = dict.fromkeys(known[0], True) if known else {}
                    added_before = self.added.exists()
                if action not in there:
                    there[action] = command.stored_action == "true" or (added_before and self.added.containsKey((action,)))
                outcome = action_outcome(command, status in K.CLOSED_STATUSES, there[action])
            if outcome == "OK":
                revision, updated = revision + 1, command.at or updated
                if command.kind == "SET_STATUS":
                    status = command.status
                    started = started or (command.at if status == "IMPLEMENTATION" else None)
                    completed = command.at if status == "COMPLETED" else completed
                elif not there[action]:
                    there[action] = True
                    self.added.updateValue((action,), (command.status,))
            out.append(outcome_of(seq, command, before, outcome, revision))
        self.thread.update((status, revision, valid, started, updated, completed, commands[-1][0]))
        return out

    def close(self) -> None:
        pass


def closing_command(spark: SparkSession, last_seq: int, delay: int) -> DataFrame:
    """A command of no thread that lets the watermark pass ``last_seq``, so that nothing waits any longer."""
    names = [f.strip().split(" ")[0] for f in COMMAND.split(",")]
    row = {"thread_id": "", "seq": last_seq + delay + 1}
    return spark.createDataFrame([tuple(row.get(n) for n in names)], COMMAND)


@dataclass(frozen=True)
class CommandFold:
    """Outcomes and checkpoint of a command stream below a shared folder."""

    spark: SparkSession
    root: str

    def start(
        self,
        commands: DataFrame,
        threads: DataFrame,
        actions: DataFrame,
        delay: int | None = None,
        report: int = 1_000_000,
        loaded: bool = False,
    ) -> StreamingQuery:
        """Run over a command stream until its current end.

        Threads begin as ``threads`` and ``actions`` have them.  What commands need of them is kept once and joined to each micro-batch, which suits a few large
        ones; ``loaded`` puts all threads into the store in the first, and later ones read no table.  With ``delay``, a command is held until one that is
        ``delay`` numbers later was seen.  One that comes after later commands of its thread were applied gets the
        outcome ``LATE_COMMAND`` and changes nothing; beyond ``report`` more numbers Spark drops it and counts it
        in the query's progress (``numRowsDroppedByWatermark``).
        """
        valid = F.col("error").isNull()
        known = thread_errors(threads, actions).select(
            "thread_id", "status", "revision", valid.alias("valid"), "started_at", "updated_at", "completed_at"
        )
        given = commands.select(*GIVEN)
        if loaded:
            none = F.array().cast("array<string>")
            ids = actions.groupBy("thread_id").agg(F.collect_set("action_id").alias("ids"))
            begin = known.join(ids, "thread_id", "left").withColumn("action_ids", F.coalesce("ids", none)).drop("ids")
            fields = [field.strip().split(" ") for field in STORED.split(",")]
            given = given.withColumns({name: F.lit(None).cast(kind) for name, kind in fields})
        else:
            begin = None
            there = actions.select("thread_id", "action_id").distinct().withColumn("stored_action", F.lit(True))
            # a null number would come to Python as a fraction
            texts = known.withColumn("revision", F.col("revision").cast("string")).toDF("thread_id", *NAMES[7:-1])
            # checked once, not in each micro-batch
            texts, there = stable(texts), stable(there)
            given = given.join(texts, "thread_id", "left").join(there, ["thread_id", "action_id"], "left").select(*NAMES)
        if delay is not None:
            # the watermark is delay + report behind the event time, and that is ahead of seq by as much and one
            ahead = F.timestamp_millis(F.col("seq") + F.lit(delay + report + 1))
            given = given.withColumn("event_time", ahead).withWatermark("event_time", f"{delay + report} milliseconds")
        texts = F.array(*[F.col(name).cast("string") for name in NAMES[1:]])
        waits = [] if delay is None else ["event_time"]
        packed = given.select("thread_id", "seq", F.to_json(texts).alias("command"), *waits)
        outcomes = packed.groupBy("thread_id").transformWithState(
            statefulProcessor=ThreadProcessor(delay),
            outputStructType=OUTCOMES,
            outputMode="Append",
            timeMode="None" if delay is None else "EventTime",
            initialState=begin.groupBy("thread_id") if begin is not None else None,
        )
        each = outcomes.select("thread_id", F.explode(F.arrays_zip(*SHOWN)).alias("outcome"))
        writer = (
            each.select("thread_id", "outcome.*").writeStream.format("parquet")
            .option("path", f"{self.root}/outcomes")
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
        )
        return with_store(self.spark, writer.start)

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outcomes")

    def history(self) -> DataFrame:
        """One row for each accepted status change."""
        return status_events(Chunked(self.outcomes().withColumn("chunk", F.lit(0)), "thread_id", "seq", split=False))

    def states(self) -> DataFrame:
        """What the store holds of each thread now: status, revision and times."""
        rows = (
            self.spark.read.format("statestore")
            .option("path", f"{self.root}/checkpoint")
            .option("stateVarName", "thread")
            .load()
        )
        return rows.select("key.thread_id", "value.*").drop("last_seq")

"""Thread lifecycle: checks and the ordered command log.

Commands of one thread act in order.  The state of a thread is one of eight
statuses, so the effect of any run of status commands is a function from eight
statuses to eight statuses and such functions compose: a thread with very many
commands is cut into chunks, every chunk is summarised by its function, and
all chunks are then replayed side by side from their known start.

Actions need no replay.  Closed is final, so an action command sees an open
thread exactly when it comes before the first closing command, and an action
exists from its first valid ADD_ACTION on.

Command columns: thread_id, seq (number, unique), at, kind (SET_STATUS,
ADD_ACTION, SET_ACTION_STATUS), status, action_id, description.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.hot import SALT, spread_over
from recordloom.functions.ordered import MAX_GROUP_ROWS, Chunked, chunk, running
from recordloom.functions.sizing import stable

# --- checks ------------------------------------------------------------------


def _thread_checks() -> tuple[tuple[Column, str], ...]:
    done = F.col("status") == "COMPLETED"
    ended = ~X.absent(F.col("completed_at"))
    return (
        (X.absent(F.col("thread_id")), K.THREAD_NO_ID),
        (X.is_blank(F.col("title")), K.THREAD_NO_TITLE),
        (X.is_blank(F.col("objective")), K.THREAD_NO_OBJECTIVE),
        (F.coalesce(F.col("revision") < 1, F.lit(True)), K.THREAD_BAD_REVISION),
        (X.not_in(F.col("status"), K.THREAD_STATUSES), K.THREAD_BAD_STATUS),
        (X.absent(F.col("created_at")), K.THREAD_NO_CREATED),
        (X.absent(F.col("updated_at")), K.THREAD_NO_UPDATED),
        (ended & ~done, K.THREAD_COMPLETED_EARLY),
        (done & ~ended, K.THREAD_NOT_COMPLETED),
    )


def duplicate_actions(actions: DataFrame) -> DataFrame:
    """Action ids used more than once within a thread."""
    return (
        actions.groupBy("thread_id", "action_id")
        .agg(F.count(F.lit(1)).alias("uses"))
        .filter(F.col("uses") > 1)
    )


def action_faults(actions: DataFrame) -> DataFrame:
    """One row per thread with a faulty action: the first fault in order of ``pos``
    (``first_fault``) and which kinds occur.

    An action is checked for its id, its description and then for an id used
    before it, so an id's second position is the first that repeats it.
    """
    shown = F.coalesce("action_id", F.lit(""))
    blank = X.absent(F.col("action_id"))
    own = actions.filter(blank | X.is_blank(F.col("description"))).select(
        "thread_id",
        "pos",
        F.when(blank, 0).otherwise(1).alias("kind"),
        F.when(blank, K.ACTION_NO_ID)
        .otherwise(F.concat(F.lit(K.ACTION_NO_DESCRIPTION + ": "), shown))
        .alias("message"),
    )
    uses = Window.partitionBy("thread_id", "action_id").orderBy("pos")
    again = (
        actions.filter(~blank)
        .select("thread_id", "action_id", "pos")
        .withColumn("use", F.row_number().over(uses))
        .filter(F.col("use") <= 2)
        .filter(F.col("use") == 2)
        .select(
            "thread_id",
            "pos",
            F.lit(2).alias("kind"),
            F.concat(F.lit(K.ACTION_REPEATED + ": "), shown).alias("message"),
        )
    )
    faults = own.unionByName(again)
    return faults.groupBy("thread_id").agg(
        F.min(F.struct("pos", "kind", "message"))["message"].alias("first_fault"),
        *[
            F.bool_or(F.col("kind") == kind).alias(name)
            for kind, name in enumerate(("without_id", "without_description", "repeated_id"))
        ],
    )


def thread_errors(threads: DataFrame, actions: DataFrame) -> DataFrame:
    """Threads with ``error`` (the first fault, null when valid) and ``errors`` (the
    kinds of all faults).

    The thread itself is checked first, then its actions one after another.
    """
    faults = action_faults(actions)
    checks = _thread_checks() + (
        (F.coalesce("without_id", F.lit(False)), K.ACTION_NO_ID),
        (F.coalesce("without_description", F.lit(False)), K.ACTION_NO_DESCRIPTION),
        (F.coalesce("repeated_id", F.lit(False)), K.ACTION_REPEATED),
    )
    return (
        threads.join(faults, "thread_id", "left")
        .withColumn("error", F.coalesce(X.first_error(*_thread_checks()), "first_fault"))
        .withColumn("errors", X.all_errors(*checks))
        .drop("first_fault", "without_id", "without_description", "repeated_id")
    )


def invalid_threads(threads: DataFrame, actions: DataFrame) -> DataFrame:
    return keep_where(thread_errors(threads, actions), F.col("error").isNotNull())


def thread_invariants(threads: DataFrame) -> DataFrame:
    """Written rules beyond the checks: a thread is not updated before it is created."""
    return threads.filter(F.col("updated_at") < F.col("created_at")).select(
        "thread_id", "created_at", "updated_at"
    )


def transition_error(current: Column, target: Column) -> Column:
    """Why a single status change is not allowed; null when it is."""
    allowed = F.lit(False)
    for origin, targets in K.THREAD_TRANSITIONS.items():
        if targets:
            allowed = allowed | ((current == origin) & target.isin(*targets))
    return X.first_error(
        (X.not_in(target, K.THREAD_STATUSES), "INVALID_STATUS"),
        (current == target, "SAME_STATUS"),
        (~allowed, "INVALID_TRANSITION"),
    )


def illegal_transitions(threads: DataFrame, commands: DataFrame) -> DataFrame:
    """Status commands that the stored status of their thread does not allow."""
    asked = commands.filter(F.col("kind") == "SET_STATUS").select(
        "seq", "thread_id", F.col("status").alias("to_status")
    )
    stored = threads.select("thread_id", F.col("status").alias("from_status"))
    return (
        asked.join(stored, "thread_id")
        .withColumn("error", transition_error(F.col("from_status"), F.col("to_status")))
        .filter(F.col("error").isNotNull())
    )


# --- replay ------------------------------------------------------------------


def _groups(batch: pa.RecordBatch, names: tuple[str, ...]) -> zip:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function of each (thread, chunk): the end status for every start status.

    Rows arrive grouped and in order, so only the current group is held.
    """
    position = {s: i for i, s in enumerate(K.THREAD_STATUSES)}
    enters = {
        t: [t in K.THREAD_TRANSITIONS[s] for s in K.THREAD_STATUSES] for t in K.THREAD_STATUSES
    }
    group, ends = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "thread_id": pa.array([group[0]], pa.string()),
                "chunk": pa.array([group[1]], pa.int32()),
                "ends": pa.array([ends], pa.list_(pa.string())),
            }
        )

    for batch in batches:
        for thread, part, target in _groups(batch, ("thread_id", "chunk", "status")):
            if (thread, part) != group:
                if group is not None:
                    yield row()
                group, ends = (thread, part), list(K.THREAD_STATUSES)
            if target in enters:
                gate = enters[target]
                ends = [target if gate[position[s]] else s for s in ends]
    if group is not None:
        yield row()


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Status before every status command, and whether it was accepted."""
    group, state = None, None
    for batch in batches:
        before, accepted = [], []
        for thread, part, target, start in _groups(
            batch, ("thread_id", "chunk", "status", "start_status")
        ):
            if (thread, part) != group:
                group, state = (thread, part), start
            before.append(state)
            taken = target in K.THREAD_TRANSITIONS.get(state, ())
            accepted.append(taken)
            if taken:
                state = target
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before, pa.string()), pa.array(accepted, pa.bool_())],
            names=[*batch.schema.names, "before_status", "accepted"],
        )


def _start_states(chunked: Chunked, starts: DataFrame) -> DataFrame:
    """Status of each (thread, chunk) before its first command.

    Summaries are one short row per chunk; the few chunks of a thread are
    composed in order.
    """
    sorted_rows = (
        chunked.rows.filter(F.col("kind") == "SET_STATUS")
        .select("thread_id", "chunk", "seq", "status")
        .repartition("thread_id", "chunk")
        .sortWithinPartitions("thread_id", "chunk", "seq")
    )
    functions = sorted_rows.mapInArrow(
        _summarise, "thread_id string, chunk int, ends array<string>"
    )
    names = F.array(*[F.lit(s) for s in K.THREAD_STATUSES])
    per_thread = functions.groupBy("thread_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("parts")
    )
    walked = per_thread.join(starts, "thread_id").select(
        "thread_id",
        F.aggregate(
            "parts",
            F.array(F.struct(F.lit(-1).alias("chunk"), F.col("start_status").alias("end_status"))),
            lambda done, part: F.concat(
                done,
                F.array(
                    F.struct(
                        part["chunk"].alias("chunk"),
                        F.element_at(
                            part["ends"],
                            F.array_position(
                                names, F.element_at(done, -1)["end_status"]
                            ).cast("int"),
                        ).alias("end_status"),
                    )
                ),
            ),
        ).alias("walk"),
    )
    steps = walked.select("thread_id", F.posexplode("walk").alias("step", "w"))
    # The start of a chunk is the end of the one before it in the walk.
    after = Window.partitionBy("thread_id").orderBy("step")
    return (
        steps.select(
            "thread_id",
            F.col("w.chunk").alias("chunk"),
            F.lag("w.end_status").over(after).alias("start_status"),
        )
        .filter(F.col("chunk") >= 0)
    )


def _replay_status(chunked: Chunked, starts: DataFrame) -> DataFrame:
    rows = chunked.rows.filter(F.col("kind") == "SET_STATUS")
    if chunked.split:
        begun = rows.join(_start_states(chunked, starts), ["thread_id", "chunk"])
    else:
        begun = rows.withColumn("start_status", F.col("stored_status"))
    ordered = begun.repartition("thread_id", "chunk").sortWithinPartitions(
        "thread_id", "chunk", "seq"
    )
    schema = P.StructType(
        [
            *ordered.schema.fields,
            P.StructField("before_status", P.StringType()),
            P.StructField("accepted", P.BooleanType()),
        ]
    )
    return ordered.mapInArrow(_replay, schema).drop("start_status")


# --- command log -------------------------------------------------------------


def apply_commands(
    threads: DataFrame,
    actions: DataFrame,
    commands: DataFrame,
    max_rows: int = MAX_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply an ordered command log.

    Returns the new threads, the new actions, one outcome per command, and a
    history row per accepted status change.
    """
    replayed = replay_commands(threads, actions, commands, max_rows)
    # All four results come from the replayed rows: replay once.
    replayed = replayed.with_rows(stable(replayed.rows))
    return (
        threads_after(threads, replayed),
        actions_after(actions, replayed),
        replayed.rows.drop("chunk"),
        status_events(replayed),
    )


def _accepted(replayed: Chunked) -> Chunked:
    return replayed.with_rows(replayed.rows.filter(F.col("outcome") == "OK"))


def replay_commands(
    threads: DataFrame,
    actions: DataFrame,
    commands: DataFrame,
    max_rows: int = MAX_GROUP_ROWS,
) -> Chunked:
    """Outcome of every command and the revision of its thread afterwards."""
    chunked = chunk(commands, "thread_id", "seq", max_rows)
    known = thread_errors(threads, actions).select(
        "thread_id",
        F.col("status").alias("stored_status"),
        F.col("revision").alias("stored_revision"),
        F.col("error").isNull().alias("valid"),
    )
    spread = spread_over(commands, "thread_id")
    rows = spread.salted(chunked.rows, "seq").join(spread.copied(known), ["thread_id", SALT], "left")
    base = (
        F.when(F.col("stored_status").isNull(), F.lit("THREAD_NOT_FOUND"))
        .when(~F.col("valid"), F.lit("INVALID_THREAD"))
    )
    rows = rows.withColumn("base", base)
    live = chunked.with_rows(rows.filter(F.col("base").isNull()))

    # 1. status commands
    starts = known.filter("valid").select("thread_id", F.col("stored_status").alias("start_status"))
    moves = _replay_status(live, starts).withColumn(
        "outcome",
        F.when(F.col("accepted"), F.lit("OK")).otherwise(
            transition_error(F.col("before_status"), F.col("status"))
        ),
    ).drop("accepted")

    # 2. the moment each thread closes
    closing = (
        moves.filter((F.col("outcome") == "OK") & F.col("status").isin(*K.CLOSED_STATUSES))
        .groupBy("thread_id")
        .agg(F.min("seq").alias("closed_seq"))
    )

    # 3. action commands
    steps = live.rows.filter(F.col("kind") != "SET_STATUS").join(
        spread.copied(closing), ["thread_id", SALT], "left"
    )
    closed = F.col("stored_status").isin(*K.CLOSED_STATUSES) | F.coalesce(
        F.col("seq") > F.col("closed_seq"), F.lit(False)
    )
    steps = steps.withColumn("closed", closed)
    adds = (F.col("kind") == "ADD_ACTION") & ~F.col("closed")
    sound = ~X.absent(F.col("action_id")) & ~X.is_blank(F.col("description"))
    begins = (
        steps.filter(adds & sound)
        .groupBy("thread_id", "action_id")
        .agg(F.min("seq").alias("born_seq"))
    )
    present = actions.select("thread_id", "action_id").distinct().withColumn("present", F.lit(True))
    link = ["thread_id", "action_id", SALT]
    steps = steps.join(spread.copied(present), link, "left").join(spread.copied(begins), link, "left")
    there = F.coalesce("present", F.lit(False)) | F.coalesce(
        F.col("born_seq") < F.col("seq"), F.lit(False)
    )
    add = F.col("kind") == "ADD_ACTION"
    step_outcome = X.first_error(
        (X.not_in(F.col("kind"), ("ADD_ACTION", "SET_ACTION_STATUS")), "UNKNOWN_COMMAND"),
        (X.not_in(F.col("status"), K.ACTION_STATUSES), "INVALID_STATUS"),
        (F.col("closed"), "CLOSED_THREAD"),
        (add & there, "DUPLICATE_ACTION"),
        (~add & ~there, "ACTION_NOT_FOUND"),
        (add & ~sound, "INVALID_ACTION"),
    )
    steps = steps.withColumn("outcome", F.coalesce(step_outcome, F.lit("OK")))

    columns = [*commands.columns, "chunk", "stored_revision", "before_status", "outcome"]
    none = F.lit(None).cast("string")
    rejected = (
        rows.filter(F.col("base").isNotNull())
        .withColumn("before_status", none)
        .withColumn("outcome", F.col("base"))
    )
    united = (
        moves.select(*columns)
        .unionByName(steps.withColumn("before_status", none).select(*columns))
        .unionByName(rejected.select(*columns))
    )

    # 4. revisions count the accepted commands
    numbered = running(
        chunked.with_rows(united), counts={"accepted_so_far": F.col("outcome") == "OK"}
    )
    return numbered.with_rows(
        numbered.rows.select(
            *commands.columns,
            "chunk",
            "before_status",
            "outcome",
            (F.col("stored_revision") + F.col("accepted_so_far")).cast("int").alias("revision"),
        )
    )


def threads_after(threads: DataFrame, replayed: Chunked) -> DataFrame:
    """Threads with the accepted commands applied."""
    accepted = _accepted(replayed).rows
    moved = F.col("kind") == "SET_STATUS"
    change = accepted.groupBy("thread_id").agg(
        F.count(F.lit(1)).cast("int").alias("steps"),
        F.max_by("at", "seq").alias("last_at"),
        F.max_by("status", F.when(moved, F.col("seq"))).alias("new_status"),
        F.min_by("at", F.when(moved & (F.col("status") == "IMPLEMENTATION"), F.col("seq"))).alias("begun_at"),
        F.min_by("at", F.when(moved & (F.col("status") == "COMPLETED"), F.col("seq"))).alias("done_at"),
    )
    new = {
        "status": F.coalesce("new_status", "status"),
        "revision": (F.col("revision") + F.coalesce("steps", F.lit(0))).cast("int"),
        "updated_at": F.coalesce("last_at", "updated_at"),
        "started_at": F.coalesce("started_at", "begun_at"),
        "completed_at": F.coalesce("done_at", "completed_at"),
    }
    return threads.join(change, "thread_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in threads.columns]
    )


def actions_after(actions: DataFrame, replayed: Chunked) -> DataFrame:
    """Actions with the accepted commands applied; new ones come last."""
    accepted = _accepted(replayed)
    added = accepted.with_rows(accepted.rows.filter(F.col("kind") == "ADD_ACTION"))
    taken = actions.groupBy("thread_id").agg(F.max("pos").alias("last_pos"))
    placed = running(added, counts={"n": F.lit(True)}).rows.join(taken, "thread_id", "left")
    new = placed.select(
        "thread_id",
        (F.coalesce("last_pos", F.lit(0)) + F.col("n")).cast("int").alias("pos"),
        "action_id",
        "description",
        "status",
        F.lit("{}").alias("metadata"),
    )
    latest = (
        accepted.rows.filter(F.col("kind") == "SET_ACTION_STATUS")
        .groupBy("thread_id", "action_id")
        .agg(F.max_by("status", "seq").alias("new_status"))
    )
    both = actions.select(*new.columns).unionByName(new)
    return both.join(latest, ["thread_id", "action_id"], "left").select(
        *[
            F.coalesce("new_status", "status").alias("status") if c == "status" else F.col(c)
            for c in new.columns
        ]
    )


def status_events(replayed: Chunked) -> DataFrame:
    """One history row per accepted status change."""
    return _accepted(replayed).rows.filter(F.col("kind") == "SET_STATUS").select(
        X.derived_id("event", F.col("thread_id"), F.col("seq")).alias("event_id"),
        "thread_id",
        "revision",
        F.lit("STATUS_CHANGED").alias("event_type"),
        F.col("before_status").alias("before"),
        F.col("status").alias("after"),
        F.col("at").alias("timestamp"),
    )


# --- batch create, update, delete -------------------------------------------


def upsert_threads(
    snapshot: DataFrame, changes: DataFrame, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of CREATE, UPDATE and DELETE rows in order of ``seq``.

    ``changes`` has ``seq``, ``change`` and all columns of ``snapshot``.  A
    create needs the id to be free, the others need it to be taken.  After a
    create the id is taken and after a delete it is free, accepted or not: a
    refused create found it taken, a refused delete found it free.  Returns the
    new snapshot and one outcome per change.
    """
    ids = snapshot.select("thread_id").distinct().withColumn("stored", F.lit(True))
    toggles = F.when(F.col("change") == "CREATE", F.lit(True)).when(
        F.col("change") == "DELETE", F.lit(False)
    )
    chunked = chunk(changes, "thread_id", "seq", max_rows)
    marked = running(chunked, lasts={"_toggled": toggles}, before=True).rows
    rows = marked.join(ids, "thread_id", "left").withColumn(
        "_taken", F.coalesce("_toggled", "stored", F.lit(False))
    )
    create = F.col("change") == "CREATE"
    error = X.first_error(
        (~X.is_valid_id(F.col("thread_id")), "INVALID_ID"),
        (X.not_in(F.col("change"), ("CREATE", "UPDATE", "DELETE")), "UNKNOWN_CHANGE"),
        (create & F.col("_taken"), "ALREADY_EXISTS"),
        (~create & ~F.col("_taken"), "NOT_FOUND"),
    )
    rows = rows.withColumn("outcome", F.coalesce(error, F.lit("OK")))
    payload = [c for c in snapshot.columns if c != "thread_id"]
    last = (
        rows.filter(F.col("outcome") == "OK")
        .groupBy("thread_id")
        .agg(F.max_by(F.struct("change", *payload), "seq").alias("r"))
    )
    kept = snapshot.join(last.select("thread_id"), "thread_id", "left_anti")
    changed = last.filter(F.col("r.change") != "DELETE").select(
        *[F.col(c) if c == "thread_id" else F.col("r." + c).alias(c) for c in snapshot.columns]
    )
    return kept.unionByName(changed), rows.select("seq", "thread_id", "change", "outcome")

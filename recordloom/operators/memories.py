"""Memory store: look-ups, lists, and batches of writes as new snapshots.

A snapshot is never changed in place.  Every batch returns the next snapshot
(kept rows united with changed ones) and one outcome row per command.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.hot import SALT, spread_over
from recordloom.functions.ordered import MAX_GROUP_ROWS, Chunked, chunk
from recordloom.operators.threads import QueryError, page

ID = "information_id"

# --- reads -------------------------------------------------------------------


def lookup(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per key; the memory's columns are null when it is absent."""
    return keys.select(ID).join(memories, ID, "left")


def existing(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that name a stored memory."""
    return keys.join(memories.select(ID), ID, "left_semi")


def invalid_ids(rows: DataFrame) -> DataFrame:
    """Rows whose id cannot name a record."""
    return rows.filter(~X.is_valid_id(F.col(ID)))


def list_memories(
    memories: DataFrame,
    filters: Mapping[str, object] | None = None,
    offset: int = 0,
    limit: int = K.DEFAULT_MEMORY_LIMIT,
) -> DataFrame:
    """A page of memories in file order.

    A filter asks for a metadata key with an equal value.  The keys
    ``revision`` and ``information_id`` also compare the memory's own field, so
    they match only where the metadata repeats it.
    """
    if offset < 0:
        raise QueryError("offset must be >= 0")
    if limit < 1:
        raise QueryError("limit must be >= 1")
    kept = filter_memories(memories, filters or {})
    return page(kept.orderBy(X.file_order(F.col(ID))), limit, offset)


def filter_memories(memories: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    kept = memories
    for key, expected in filters.items():
        wanted = X.comparable(F.lit(X.canonical(expected)))
        if key == "revision":
            kept = kept.filter(X.comparable(X.json_number(F.col("revision"))) == wanted)
        if key == ID:
            kept = kept.filter(X.json_string(F.col(ID)) == X.canonical(expected))
        kept = kept.filter(X.comparable(F.try_element_at("metadata", F.lit(key))) == wanted)
    return kept


# --- store -------------------------------------------------------------------


def store_batch(snapshot: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store new memories in order of ``seq``; the first valid one of an id wins."""
    sound = X.is_valid_id(F.col(ID)) & (F.col("revision") >= 1)
    first = incoming.filter(sound).groupBy(ID).agg(F.min("seq").alias("first_seq"))
    taken = snapshot.select(ID).distinct().withColumn("stored", F.lit(True))
    spread = spread_over(incoming, ID)
    rows = (
        spread.salted(incoming, "seq")
        .join(spread.copied(first), [ID, SALT], "left")
        .join(spread.copied(taken), [ID, SALT], "left")
        .drop(SALT)
    )
    outcome = X.first_error(
        (~X.is_valid_id(F.col(ID)), "INVALID_ID"),
        (F.coalesce(F.col("revision") < 1, F.lit(True)), "INVALID_REVISION"),
        (
            F.col("stored").isNotNull() | (F.col("seq") > F.col("first_seq")),
            "ALREADY_EXISTS",
        ),
    )
    rows = rows.withColumn("outcome", F.coalesce(outcome, F.lit("STORED")))
    new = rows.filter(F.col("outcome") == "STORED").select(*snapshot.columns)
    return snapshot.unionByName(new), rows.select("seq", ID, "revision", "outcome")


# --- optimistic update -------------------------------------------------------


def _rows(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revision each update finds; a sound one that expects it moves it on."""
    group, current = None, None
    for batch in batches:
        found = []
        for key, part, expected, sound, start in _rows(
            batch, ID, "chunk", "previous_revision", "sound", "start_revision"
        ):
            if (key, part) != group:
                group, current = (key, part), start
            found.append(current)
            if sound and expected == current:
                current += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.int32())],
            names=[*batch.schema.names, "found_revision"],
        )


def _chunk_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each revision ends after a chunk, read from its last row back."""

    def out(group: tuple, ends: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                ID: pa.array([group[0]] * len(ends), pa.string()),
                "chunk": pa.array([group[1]] * len(ends), pa.int32()),
                "start": pa.array(list(ends), pa.int32()),
                "end": pa.array(list(ends.values()), pa.int32()),
            }
        )

    group, ends = None, {}
    for batch in batches:
        for key, part, expected in _rows(batch, ID, "chunk", "previous_revision"):
            if (key, part) != group:
                if group is not None:
                    yield out(group, ends)
                group, ends = (key, part), {}
            ends[expected] = ends.get(expected + 1, expected + 1)
    if group is not None:
        yield out(group, ends)


def _walk_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revision at the start of each chunk, from the effects in chunk order."""
    key_now, part_now, current, following = None, None, None, None
    for batch in batches:
        keys, parts, starts = [], [], []
        for key, part, start, end, stored in _rows(
            batch, ID, "chunk", "start", "end", "stored_revision"
        ):
            if key != key_now:
                key_now, part_now, following = key, None, stored
            if part != part_now:
                part_now, current = part, following
                keys.append(key)
                parts.append(part)
                starts.append(current)
            if start == current:
                following = end
        yield pa.RecordBatch.from_pydict(
            {
                ID: pa.array(keys, pa.string()),
                "chunk": pa.array(parts, pa.int32()),
                "start_revision": pa.array(starts, pa.int32()),
            }
        )


def _start_revisions(chunked: Chunked, stored: DataFrame) -> DataFrame:
    """Revision at the start of every chunk of every id.

    A chunk's effect on a revision matters only where that revision can be the
    state at its start: the stored one or the end of an effect.  All other
    effects are dropped before the walk.
    """
    effects = (
        chunked.rows.filter("sound")
        .select(ID, "chunk", "seq", "previous_revision")
        .repartition(ID, "chunk")
        .sortWithinPartitions(ID, "chunk", F.col("seq").desc())
        .mapInArrow(_chunk_effects, f"{ID} string, chunk int, start int, end int")
    )
    reachable = (
        effects.select(ID, F.col("end").alias("start"))
        .unionByName(stored.select(ID, F.col("stored_revision").alias("start")))
        .distinct()
    )
    useful = effects.join(reachable, [ID, "start"], "left_semi")
    every = chunked.rows.select(ID, "chunk").distinct().select(
        ID, "chunk", F.lit(-1).alias("start"), F.lit(-1).alias("end")
    )
    walk = (
        useful.select(ID, "chunk", "start", "end")
        .unionByName(every)
        .join(stored, ID)
        .repartition(ID)
        .sortWithinPartitions(ID, "chunk", "start")
    )
    return walk.mapInArrow(_walk_chunks, f"{ID} string, chunk int, start_revision int")


def update_batch(
    snapshot: DataFrame, updates: DataFrame, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Optimistic updates in order of ``seq``.

    ``updates``: seq, information_id, new_information_id, previous_revision and
    the new values of any snapshot columns.  An update is accepted when it
    expects the revision it finds and keeps the id.
    """
    stored = snapshot.select(ID, F.col("revision").alias("stored_revision"))
    payload = [c for c in updates.columns if c in snapshot.columns and c not in (ID, "revision")]
    chunked = chunk(updates, ID, "seq", max_rows)
    spread = spread_over(updates, ID)
    known = (
        spread.salted(chunked.rows, "seq")
        .join(spread.copied(stored), [ID, SALT], "left")
        .drop(SALT)
        .withColumn("sound", F.coalesce(F.col("new_information_id") == F.col(ID), F.lit(False)))
    )
    live = chunked.with_rows(known.filter(F.col("stored_revision").isNotNull()))
    narrow = live.rows.select(ID, "chunk", "seq", "previous_revision", "sound", "stored_revision")
    if chunked.split:
        begun = narrow.drop("stored_revision").join(
            _start_revisions(live, stored), [ID, "chunk"]
        )
    else:
        begun = narrow.withColumnRenamed("stored_revision", "start_revision")
    ordered = begun.repartition(ID, "chunk").sortWithinPartitions(ID, "chunk", "seq")
    schema = P.StructType([*ordered.schema.fields, P.StructField("found_revision", P.IntegerType())])
    replayed = ordered.mapInArrow(_advance, schema)
    missing = known.filter(F.col("stored_revision").isNull()).select(
        ID, "seq", "previous_revision", "sound", F.lit(None).cast("int").alias("found_revision")
    )
    error = X.first_error(
        (~X.is_valid_id(F.col(ID)), "INVALID_ID"),
        (F.col("found_revision").isNull(), "NOT_FOUND"),
        (
            F.coalesce(F.col("previous_revision") != F.col("found_revision"), F.lit(True)),
            "REVISION_CONFLICT",
        ),
        (~F.col("sound"), "ID_MISMATCH"),
    )
    outcomes = (
        replayed.select(*missing.columns)
        .unionByName(missing)
        .withColumn("outcome", F.coalesce(error, F.lit("UPDATED")))
        .select(
            "seq",
            ID,
            "previous_revision",
            F.when(F.col("outcome") == "UPDATED", F.col("found_revision") + 1).alias("revision"),
            "outcome",
        )
    )
    # Only the last accepted update of an id leaves its values.
    last = (
        outcomes.filter(F.col("outcome") == "UPDATED")
        .groupBy(ID)
        .agg(F.max("seq").alias("seq"), F.max("revision").alias("new_revision"))
    )
    values = updates.select(ID, "seq", F.struct(*payload).alias("new")).join(last, [ID, "seq"])
    joined = snapshot.join(values.drop("seq"), ID, "left")
    changed = F.col("new_revision").isNotNull()

    def column(name: str):
        if name == "revision":
            return F.coalesce("new_revision", "revision").alias(name)
        if name in payload:
            return F.when(changed, F.col("new")[name]).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[column(c) for c in snapshot.columns]), outcomes


# --- two-phase delete --------------------------------------------------------


def request_deletes(
    snapshot: DataFrame, commands: DataFrame, pending: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ask for deletes; the latest accepted request of an id replaces older ones.

    Returns the delete requests on file and one outcome per command.
    """
    stored = snapshot.select(ID, F.col("revision").alias("stored_revision"))
    rows = commands.join(stored, ID, "left")
    error = X.first_error(
        (~X.is_valid_id(F.col(ID)), "INVALID_ID"),
        (F.col("stored_revision").isNull(), "NOT_FOUND"),
        (
            F.coalesce(F.col("stored_revision") != F.col("revision"), F.lit(True)),
            "REVISION_CONFLICT",
        ),
    )
    rows = rows.withColumn("outcome", F.coalesce(error, F.lit("PENDING_DELETE")))
    fields = ["requested_by", "reason", "revision", "operation_id"]
    latest = (
        rows.filter(F.col("outcome") == "PENDING_DELETE")
        .groupBy(ID)
        .agg(F.max_by(F.struct(*fields), "seq").alias("r"))
        .select(ID, "r.*", F.lit("PENDING_DELETE").alias("status"))
    )
    if pending is not None:
        kept = pending.join(latest.select(ID), ID, "left_anti")
        latest = latest.unionByName(kept)
    return latest, rows.select("seq", ID, "operation_id", "outcome")


def decide_deletes(
    snapshot: DataFrame, requests: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approve or cancel requested deletes in order of ``seq``.

    A decision needs the request and its operation id; the request's current
    status does not matter, so a cancelled one may still be approved.  Returns
    the new snapshot, the requests with their last status, and the outcomes.
    """
    asked = requests.select(ID, F.col("operation_id").alias("asked_operation"))
    rows = decisions.join(asked, ID, "left")
    error = X.first_error(
        (~X.is_valid_id(F.col(ID)), "INVALID_ID"),
        (X.not_in(F.col("decision"), ("APPROVE", "CANCEL")), "UNKNOWN_DECISION"),
        (F.col("asked_operation").isNull(), "REQUEST_NOT_FOUND"),
        (
            F.coalesce(F.col("asked_operation") != F.col("operation_id"), F.lit(True)),
            "OPERATION_CONFLICT",
        ),
    )
    done = F.when(F.col("decision") == "APPROVE", F.lit("DELETED")).otherwise(F.lit("CANCELLED"))
    rows = rows.withColumn("outcome", F.coalesce(error, done))
    effects = (
        rows.filter(F.col("outcome").isin("DELETED", "CANCELLED"))
        .groupBy(ID)
        .agg(
            F.max_by("outcome", "seq").alias("last_status"),
            F.bool_or(F.col("outcome") == "DELETED").alias("deleted"),
        )
    )
    left = snapshot.join(effects.filter("deleted").select(ID), ID, "left_anti")
    decided = requests.join(effects.select(ID, "last_status"), ID, "left").select(
        *[
            F.coalesce("last_status", "status").alias("status") if c == "status" else F.col(c)
            for c in requests.columns
        ]
    )
    return left, decided, rows.select("seq", ID, "operation_id", "decision", "outcome")

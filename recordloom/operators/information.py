"""Information records: structural checks, ingest, manual updates, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.hot import SALT, spread_over
from recordloom.functions.ordered import MAX_GROUP_ROWS, chunk, running
from recordloom.functions.sizing import stable

# --- structural checks -------------------------------------------------------


def missing_fields(present: dict[str, Column]) -> Column:
    """Sorted names of required fields that are not present."""
    return F.array_sort(
        F.array_compact(
            F.array(*[F.when(~present[n], F.lit(n)) for n in K.INFORMATION_FIELDS])
        )
    )


def structure_errors(
    missing: Column, kind: Column, epistemic: Column, operational: Column, identity: Column
) -> Column:
    """Messages of the structural checks; empty values skip the domain checks."""

    def outside(value: Column, domain: tuple[str, ...]) -> Column:
        return ~X.absent(value) & ~value.isin(*domain)

    return X.all_errors(
        (F.size(missing) > 0, F.concat(F.lit(K.FIELDS_MISSING), F.array_join(missing, ", "))),
        (outside(kind, K.INFORMATION_TYPES), F.concat(F.lit(K.TYPE_INVALID), kind)),
        (
            outside(epistemic, K.EPISTEMIC_STATUSES),
            F.concat(F.lit(K.EPISTEMIC_INVALID), epistemic),
        ),
        (
            outside(operational, K.OPERATIONAL_STATES),
            F.concat(F.lit(K.OPERATIONAL_INVALID), operational),
        ),
        (X.absent(identity), K.ID_EMPTY),
    )


def record_errors() -> Column:
    """Structural errors of a row of the information table; a null field is a
    missing one.  Relations and triggers live in child tables and are never
    missing."""
    columns = {
        "id": F.col("id"),
        "revision": F.col("revision"),
        "type": F.col("type"),
        "epistemic_status": F.col("epistemic_status"),
        "operational_state": F.col("operational_state"),
        "confidence": F.col("confidence"),
        "importance": F.col("importance"),
        "context": F.col("context"),
        "provenance": F.col("provenance"),
        "evidence": F.col("evidence"),
        "time": F.col("time"),
        "retention": F.col("retention"),
    }
    present = {n: columns[n].isNotNull() if n in columns else F.lit(True) for n in K.INFORMATION_FIELDS}
    return structure_errors(
        missing_fields(present),
        columns["type"],
        columns["epistemic_status"],
        columns["operational_state"],
        columns["id"],
    )


def text_states(texts: DataFrame) -> DataFrame:
    """What the checks and the plan decisions need to know of record texts.

    ``texts`` has path and text.  Columns: record_id (from the path), id, type,
    epistemic_status, operational_state, missing, errors, flat_revision,
    structured_number.  A text without front matter has the single error
    ``front matter absent``.
    """
    framed = texts.withColumn("_front", X.front_lines(F.col("text")))
    keyed = framed.select(
        "path",
        "text",
        "_front",
        F.regexp_extract("path", r"([^/]*)\.md\z", 1).alias("record_id"),
        *[X.field(F.col("_front"), n).alias(n) for n in ("id", "type", "epistemic_status", "operational_state")],
        X.field(F.col("_front"), "revision").alias("flat_revision"),
        F.array_except(
            F.array(*[F.lit(n) for n in sorted(K.INFORMATION_FIELDS)]),
            F.coalesce(X.field_names(F.col("_front")), F.array().cast("array<string>")),
        ).alias("missing"),
    )
    missing = F.col("missing")
    number = F.regexp_extract("text", r"(?md)^revision:\s*\n\s+number:\s*(\d+)", 1)
    errors = F.when(
        F.col("_front").isNull(), F.array(F.lit(K.FRONT_MISSING))
    ).otherwise(
        structure_errors(
            missing,
            F.col("type"),
            F.col("epistemic_status"),
            F.col("operational_state"),
            F.col("id"),
        )
    )
    return keyed.select(
        "path",
        "record_id",
        "id",
        "type",
        "epistemic_status",
        "operational_state",
        "flat_revision",
        "missing",
        errors.alias("errors"),
        F.when(number != "", number).alias("structured_number"),
    )


def invalid_information(texts: DataFrame) -> DataFrame:
    """Record texts that fail the structural checks."""
    return keep_where(text_states(texts), F.size("errors") > 0).select("path", "id", "errors")


def missing_field_counts(texts: DataFrame) -> DataFrame:
    """How many records lack each required field."""
    return (
        text_states(texts)
        .select(F.explode("missing").alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("records"))
    )


# --- ingest ------------------------------------------------------------------


def ingest_information(incoming: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New statements as records with defaults.

    ``incoming``: id, type, mode, project, source_type, source, content.
    Returns records, CREATED events, reviews (decisions ask for one) and
    rejects.
    """
    shaped = incoming.select(
        "id",
        F.upper("type").alias("type"),
        F.upper("mode").alias("mode"),
        "project",
        F.upper("source_type").alias("source_type"),
        "source",
        "content",
    ).withColumn(
        "error",
        F.when(
            X.not_in(F.col("type"), K.INFORMATION_TYPES),
            F.concat(F.lit(K.TYPE_INVALID), F.coalesce("type", F.lit(""))),
        ),
    )
    none = F.lit(None).cast("string")
    kept = shaped.filter(F.col("error").isNull())
    records = kept.select(
        "id",
        F.struct(
            F.lit(1).alias("number"),
            F.lit(False).alias("is_revision"),
            F.lit(None).cast("int").alias("previous_revision"),
        ).alias("revision"),
        F.lit(False).alias("structured_revision"),
        "type",
        F.lit("UNVERIFIED").alias("epistemic_status"),
        F.lit("ACTIVE").alias("operational_state"),
        F.lit("LOW").alias("confidence"),
        F.lit("NORMAL").alias("importance"),
        F.struct("mode", "project", F.array(F.lit("GENERAL")).alias("domain")).alias("context"),
        F.struct("source_type", "source").alias("provenance"),
        F.struct(
            F.array().cast("array<string>").alias("supporting"),
            F.array().cast("array<string>").alias("contradicting"),
        ).alias("evidence"),
        F.struct(
            F.lit(now).alias("created_at"),
            *[none.alias(n) for n in K.TIME_FIELDS if n != "created_at"],
        ).alias("time"),
        F.lit("NORMAL").alias("retention"),
        "content",
    )
    events = records.select(
        X.derived_id("event", F.col("id"), F.lit("CREATED")).alias("event_id"),
        F.col("id").alias("information_id"),
        F.lit(1).alias("revision"),
        F.lit("CREATED").alias("event_type"),
        none.alias("before"),
        state_text(F.col("epistemic_status"), F.col("operational_state")).alias("after"),
        F.lit("NEW_INFORMATION").alias("cause_type"),
        F.lit(K.CREATED_DESCRIPTION).alias("description"),
        F.lit(now).alias("timestamp"),
    )
    asked = records.filter(F.col("type") == "DECISION").select(
        X.derived_id("review", F.col("id")).alias("review_id"),
        F.col("id").alias("information_id"),
        F.lit("PENDING_REVIEW").alias("status"),
        F.lit(K.DECISION_REVIEW_REASON).alias("reason"),
        F.lit(now).alias("created_at"),
    )
    rejects = shaped.filter(F.col("error").isNotNull()).select("id", "type", "error")
    return records, events, asked, rejects


def state_text(epistemic: Column, operational: Column) -> Column:
    """The two states of a record as one history value."""
    return X.json_object(
        {"epistemic_status": X.json_string(epistemic), "operational_state": X.json_string(operational)}
    )


# --- manual updates ----------------------------------------------------------

_MANUAL = ("epistemic_status", "operational_state", "confidence", "importance")
_CHECKED = {"epistemic_status": K.EPISTEMIC_STATUSES, "operational_state": K.OPERATIONAL_STATES}


def manual_updates(
    information: DataFrame, updates: DataFrame, now: str, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply field changes in order of ``seq``.

    ``updates``: seq, id, the four changeable fields (null or empty keeps the
    old value) and reason.  There is no transition rule.  The two states must
    end up in their domains, so where a stored one is empty, updates are
    refused until one supplies it.  Returns information, events and outcomes.
    """
    given = {n: F.when(~X.absent(F.col("u_" + n)), F.col("u_" + n)) for n in _MANUAL}
    stored = information.select(
        "id",
        *[F.col(n).alias("s_" + n) for n in _MANUAL],
        F.col("revision.number").alias("s_revision"),
        F.col("structured_revision").alias("s_structured"),
        (F.size(record_errors()) == 0).alias("s_valid"),
    )
    chunked = chunk(updates, "id", "seq", max_rows)
    spread = spread_over(updates, "id")
    asked = chunked.rows.select("id", "seq", "chunk", "reason", *[F.col(n).alias("u_" + n) for n in _MANUAL])
    rows = spread.salted(asked, "seq").join(spread.copied(stored), ["id", SALT], "left")

    sound = F.lit(True)
    complete = F.lit(True)
    for name, domain in _CHECKED.items():
        sound = sound & (given[name].isNull() | given[name].isin(*domain))
        complete = complete & (~X.absent(F.col("s_" + name)) | given[name].isNotNull())
    usable = F.coalesce(F.col("s_valid") & ~F.col("s_structured"), F.lit(False))
    opening = (
        rows.filter(usable & sound & complete).groupBy("id").agg(F.min("seq").alias("open_seq"))
    )
    rows = rows.join(spread.copied(opening), ["id", SALT], "left").drop(SALT)

    def refused(name: str) -> Column:
        domain = _CHECKED[name]
        bad = given[name].isNotNull() & ~given[name].isin(*domain)
        unset = given[name].isNull() & X.absent(F.col("s_" + name))
        waiting = F.coalesce(F.col("seq") < F.col("open_seq"), F.lit(True))
        return bad | (unset & waiting)

    error = X.first_error(
        (F.col("s_valid").isNull(), "NOT_FOUND"),
        (~F.col("s_valid"), "INVALID_INFORMATION"),
        (F.col("s_structured"), "INVALID_REVISION"),
        (refused("epistemic_status"), "INVALID_EPISTEMIC_STATUS"),
        (refused("operational_state"), "INVALID_OPERATIONAL_STATE"),
    )
    rows = rows.withColumn("outcome", F.coalesce(error, F.lit("UPDATED")))
    accepted = F.col("outcome") == "UPDATED"
    after = running(
        chunked.with_rows(rows),
        counts={"steps": accepted},
        lasts={"a_" + n: F.when(accepted, given[n]) for n in _MANUAL},
    )
    both = running(
        after, lasts={"b_" + n: F.when(accepted, given[n]) for n in _MANUAL}, before=True
    ).rows
    both = stable(both)
    done = both.filter(accepted)

    def value(prefix: str, name: str) -> Column:
        return F.coalesce(prefix + name, "s_" + name)

    new_revision = (F.col("s_revision") + F.col("steps")).cast("int")
    events = done.select(
        X.derived_id("event", F.col("id"), F.col("seq")).alias("event_id"),
        F.col("id").alias("information_id"),
        new_revision.alias("revision"),
        F.lit("UPDATED").alias("event_type"),
        *[value("b_", n).alias("before_" + n) for n in _MANUAL],
        *[value("a_", n).alias("after_" + n) for n in _MANUAL],
        F.lit("MANUAL_ACTION").alias("cause_type"),
        F.col("reason").alias("description"),
        F.lit(now).alias("timestamp"),
    )
    outcomes = both.select("seq", "id", "outcome", F.when(accepted, new_revision).alias("revision"))

    latest = done.groupBy("id").agg(
        F.max("steps").cast("int").alias("n_steps"),
        *[F.max_by("a_" + n, "seq").alias("n_" + n) for n in _MANUAL],
    )
    new = {n: F.coalesce("n_" + n, n) for n in _MANUAL}
    new["revision"] = F.when(
        F.col("n_steps").isNotNull(),
        F.struct(
            (F.col("revision.number") + F.col("n_steps")).alias("number"),
            F.col("revision.is_revision").alias("is_revision"),
            F.col("revision.previous_revision").alias("previous_revision"),
        ),
    ).otherwise(F.col("revision"))
    updated = information.join(latest, "id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in information.columns]
    )
    return updated, events, outcomes


# --- reviews -----------------------------------------------------------------


def pending_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("status") == "PENDING_REVIEW")


def resolve_reviews(
    reviews: DataFrame, information: DataFrame, decisions: DataFrame, now: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Human decisions on reviews, in order of ``seq``.

    A decision confirms, refutes or marks as conflicted an information that is
    still unverified, so the first acceptable decision per information wins.
    Returns information, events, reviews and outcomes.
    """
    d = decisions.select(
        "seq", "review_id", F.upper("decision").alias("decision"), F.col("reason").alias("d_reason")
    )
    asked = reviews.select("review_id", "information_id", F.col("status").alias("r_status"))
    state = information.select(
        F.col("id").alias("information_id"),
        F.col("epistemic_status").alias("i_epistemic"),
        F.col("operational_state").alias("i_operational"),
        F.col("revision.number").alias("i_revision"),
        F.col("structured_revision").alias("i_structured"),
        (F.size(record_errors()) == 0).alias("i_valid"),
    )
    often = spread_over(d, "review_id")
    rows = often.salted(d, "seq").join(often.copied(asked), ["review_id", SALT], "left").drop(SALT)
    spread = spread_over(reviews, "information_id")
    rows = spread.salted(rows, "seq").join(spread.copied(state), ["information_id", SALT], "left").drop(SALT)
    checks = (
        (X.not_in(F.col("decision"), K.REVIEW_DECISIONS), "INVALID_DECISION"),
        (F.col("r_status").isNull(), "REVIEW_NOT_FOUND"),
        (F.col("r_status") != "PENDING_REVIEW", "REVIEW_NOT_PENDING"),
        (X.absent(F.col("information_id")), "INFORMATION_ID_MISSING"),
        (F.col("i_valid").isNull(), "INFORMATION_NOT_FOUND"),
        (~F.col("i_valid"), "INFORMATION_INVALID"),
        (X.not_in(F.col("i_epistemic"), ("UNVERIFIED",)), "NOT_UNVERIFIED"),
        (F.col("i_structured"), "INVALID_REVISION"),
        # The update refuses an operational state outside its domain, an empty one too.
        (X.not_in(F.col("i_operational"), K.OPERATIONAL_STATES), "INVALID_OPERATIONAL_STATE"),
    )
    rows = stable(rows.withColumn("first", X.first_error(*checks)))
    winners = (
        rows.filter(F.col("first").isNull())
        .groupBy("information_id")
        .agg(F.min("seq").alias("win_seq"))
    )
    closed = (
        rows.filter(F.col("first").isNull())
        .join(winners, "information_id")
        .filter(F.col("seq") == F.col("win_seq"))
        .select("review_id", F.col("seq").alias("closed_seq"))
    )
    rows = rows.join(winners, "information_id", "left").join(closed, "review_id", "left")
    # Later decisions meet a resolved review, or an information that moved on.
    outcome = F.coalesce(
        F.when(
            F.col("first").isNull() & (F.col("seq") > F.col("closed_seq")),
            F.lit("REVIEW_NOT_PENDING"),
        ),
        F.col("first"),
        F.when(F.col("seq") > F.col("win_seq"), F.lit("NOT_UNVERIFIED")),
        F.lit("RESOLVED"),
    )
    rows = rows.withColumn("outcome", outcome)
    done = rows.filter(F.col("outcome") == "RESOLVED").withColumn(
        "event_id", X.derived_id("event", F.col("review_id"), F.col("seq"))
    )
    events = done.select(
        "event_id",
        "information_id",
        (F.col("i_revision") + 1).cast("int").alias("revision"),
        F.lit("REVIEW_RESOLVED").alias("event_type"),
        state_text(F.col("i_epistemic"), F.col("i_operational")).alias("before"),
        state_text(F.col("decision"), F.col("i_operational")).alias("after"),
        F.lit("MANUAL_ACTION").alias("cause_type"),
        F.col("d_reason").alias("description"),
        F.lit(now).alias("timestamp"),
    )
    change = done.select(
        F.col("information_id").alias("id"), F.col("decision").alias("n_epistemic")
    )
    new = {
        "epistemic_status": F.coalesce("n_epistemic", "epistemic_status"),
        "revision": F.when(
            F.col("n_epistemic").isNotNull(),
            F.struct(
                (F.col("revision.number") + 1).alias("number"),
                F.col("revision.is_revision").alias("is_revision"),
                F.col("revision.previous_revision").alias("previous_revision"),
            ),
        ).otherwise(F.col("revision")),
    }
    updated = information.join(change, "id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in information.columns]
    )
    resolution = done.select(
        "review_id",
        F.col("decision").alias("n_decision"),
        F.col("event_id").alias("n_event"),
    )
    is_done = F.col("n_decision").isNotNull()
    resolved = reviews.join(resolution, "review_id", "left").select(
        *[
            F.when(is_done, F.lit("RESOLVED")).otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.col(c)
            for c in reviews.columns
            if c not in ("decision", "resolved_at", "resolver", "resolution_event_id")
        ],
        F.col("n_decision").alias("decision"),
        F.when(is_done, F.lit(now)).alias("resolved_at"),
        F.when(is_done, F.lit("human")).alias("resolver"),
        F.col("n_event").alias("resolution_event_id"),
    )
    return updated, events, resolved, rows.select("seq", "review_id", "information_id", "decision", "outcome")

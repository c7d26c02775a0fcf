"""Typed relations between information records.

Relations are a child table (source_id, pos, type, target_id).  Proposals add
rows to it; the target is never touched and no status changes by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.hot import SALT, spread_over
from recordloom.functions.ordered import MAX_GROUP_ROWS, chunk, running
from recordloom.functions.sizing import stable

LINK = ("source_id", "type", "target_id")


def relation_checks(proposals: DataFrame, information: DataFrame) -> DataFrame:
    """Errors and warnings of every proposal (seq, source_id, type, target_id, review)."""
    source = information.select(
        F.col("id").alias("source_id"),
        F.col("epistemic_status").alias("source_status"),
        F.col("revision.number").alias("source_revision"),
        F.col("structured_revision").alias("source_structured"),
        F.lit(True).alias("source_found"),
    )
    target = information.select(
        F.col("id").alias("target_id"),
        F.col("epistemic_status").alias("target_status"),
        F.lit(True).alias("target_found"),
    )
    # Both ends may be hot: a record that proposes, or is proposed to, very often.
    from_hot = spread_over(proposals, "source_id")
    to_hot = spread_over(proposals, "target_id")
    rows = from_hot.salted(proposals, "seq").join(from_hot.copied(source), ["source_id", SALT], "left").drop(SALT)
    rows = to_hot.salted(rows, "seq").join(to_hot.copied(target), ["target_id", SALT], "left").drop(SALT)

    def shown(name: str):
        return F.coalesce(name, F.lit("None"))

    bad_type = X.not_in(F.col("type"), K.RELATION_TYPES)
    found = F.col("target_found").isNotNull()
    # A bad type ends the checks; an unknown target ends them before the states.
    errors = (
        F.when(F.col("source_found").isNull(), F.array(F.lit(K.RELATION_SOURCE_MISSING)))
        .when(bad_type, F.array(F.concat(F.lit(K.RELATION_BAD_TYPE), shown("type"))))
        .otherwise(
            X.all_errors(
                (X.absent(F.col("target_id")), K.RELATION_NO_TARGET_ID),
                (
                    F.coalesce(F.col("source_id") == F.col("target_id"), F.lit(False)),
                    K.RELATION_REFLEXIVE,
                ),
                (~found, F.concat(F.lit(K.RELATION_TARGET_MISSING), shown("target_id"))),
                (
                    found & X.not_in(F.col("source_status"), K.EPISTEMIC_STATUSES),
                    F.concat(F.lit(K.RELATION_BAD_SOURCE_STATE), shown("source_status")),
                ),
                (
                    found & X.not_in(F.col("target_status"), K.EPISTEMIC_STATUSES),
                    F.concat(F.lit(K.RELATION_BAD_TARGET_STATE), shown("target_status")),
                ),
            )
        )
    )
    w = K.RELATION_WARNINGS
    supersedes = F.col("type") == "SUPERSEDES"
    before, after = w["SUPERSEDES_FROM"].split("{}")
    warnings = F.when(
        ~bad_type & found & F.col("source_found").isNotNull(),
        X.all_errors(
            (
                (F.col("type") == "CONTRADICTS") & (F.col("source_status") == "SUPERSEDED"),
                w["CONTRADICTS_FROM_SUPERSEDED"],
            ),
            (
                supersedes & F.col("source_status").isin("REFUTED", "SUPERSEDED"),
                F.concat(F.lit(before), F.col("source_status"), F.lit(after)),
            ),
            (supersedes & (F.col("target_status") == "SUPERSEDED"), w["SUPERSEDES_TO_SUPERSEDED"]),
            (supersedes & (F.col("target_status") == "CONFIRMED"), w["SUPERSEDES_TO_CONFIRMED"]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return rows.select(
        *proposals.columns,
        "source_revision",
        "source_structured",
        errors.alias("errors"),
        warnings.alias("warnings"),
    )


def apply_relations(
    proposals: DataFrame,
    information: DataFrame,
    relations: DataFrame,
    now: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Add the proposals that pass the checks, in order of ``seq``.

    Each accepted one raises the revision of its source by one.  Returns
    information, relations, events, reviews and outcomes.
    """
    link = list(LINK)
    chunked = chunk(proposals, "source_id", "seq", max_rows)
    checked = relation_checks(chunked.rows, information)
    stored = relations.select(*link).distinct().withColumn("stored", F.lit(True))
    able = (F.size("errors") == 0) & ~F.col("source_structured")
    first = checked.filter(able).groupBy(*link).agg(F.min("seq").alias("first_seq"))
    rows = checked.join(stored, link, "left").join(first, link, "left")
    error = X.first_error(
        (F.size("errors") > 0, "REFUSED"),
        (F.coalesce("source_structured", F.lit(True)), "REVISION_ABSENT"),
        (F.col("stored").isNotNull() | (F.col("seq") > F.col("first_seq")), "ALREADY_PRESENT"),
    )
    outcomes = stable(rows.withColumn("outcome", F.coalesce(error, F.lit("ADDED"))))
    passed = chunked.with_rows(keep_where(outcomes, F.col("outcome") == "ADDED"))
    added = running(passed, counts={"n": F.lit(True)}).rows.withColumn("revision", (F.col("source_revision") + F.col("n")).cast("int"))

    reviewed = F.col("review") & F.col("type").isin(*K.REVIEWED_RELATION_TYPES)
    added = added.withColumn(
        "review_id", F.when(reviewed, X.derived_id("review", *[F.col(c) for c in link]))
    )
    events = added.select(
        X.derived_id("event", *[F.col(c) for c in link]).alias("event_id"),
        F.col("source_id").alias("information_id"),
        "revision",
        F.lit("RELATION_ADDED").alias("event_type"),
        (F.col("revision") - 1).alias("before_revision"),
        F.concat(F.lit("Relation "), "type", F.lit(" ajoutée vers "), "target_id", F.lit(".")).alias("description"),
        "type",
        "target_id",
        "review_id",
        F.lit(now).alias("timestamp"),
    )
    reviews = added.filter(reviewed).select(
        "review_id",
        F.lit("PENDING_REVIEW").alias("status"),
        F.lit("RELATION_REVIEW").alias("review_type"),
        F.col("source_id").alias("information_id"),
        F.col("target_id").alias("target_information_id"),
        F.col("type").alias("relation_type"),
        F.lit(now).alias("created_at"),
    )
    last = relations.groupBy("source_id").agg(F.max("pos").alias("last_pos"))
    new = added.join(last, "source_id", "left").select(
        "source_id",
        (F.coalesce("last_pos", F.lit(-1)) + F.col("n")).cast("int").alias("pos"),
        "type",
        "target_id",
    )
    counts = added.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    revision = F.when(
        F.col("n").isNotNull(),
        F.struct(
            (F.col("revision.number") + F.col("n")).alias("number"),
            F.col("revision.is_revision").alias("is_revision"),
            F.col("revision.previous_revision").alias("previous_revision"),
        ),
    ).otherwise(F.col("revision"))
    updated = information.join(counts, "id", "left").select(
        *[revision.alias(c) if c == "revision" else F.col(c) for c in information.columns]
    )
    return (
        updated,
        relations.select("source_id", "pos", "type", "target_id").unionByName(new),
        events,
        reviews,
        outcomes.select("seq", *link, "outcome"),
    )

"""Routing: from a classified record to a memory plan.

A plan is kept in two forms: columns, which the next steps work on, and its
canonical JSON, from which operation ids are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.plans.classify import by_status, classify
from recordloom.sources.corpora import front_matter_json, revision_parts


def normalised_revisions(texts: DataFrame) -> DataFrame:
    """Revision of every record text as number, flag and previous number."""
    front, _ = X.split_front(F.col("text"))
    rows = texts.select("path", front_matter_json(front)["json"].alias("metadata"))
    number, flag, previous = revision_parts(F.try_parse_json("metadata"))
    return keep_where(rows, F.col("metadata").isNotNull()).select(
        "path",
        number.try_cast("int").alias("number"),
        flag.alias("is_revision"),
        previous.try_cast("int").alias("previous_revision"),
    )


def route(texts: DataFrame) -> DataFrame:
    """Memory plans of record texts (path, text).

    Records that cannot be classified or read carry an ``error`` and no plan.
    """
    front, body = X.split_front(F.col("text"))
    # Python gets the front matter alone; the result is pinned by the select.
    read = texts.select("path", "text", front_matter_json(front).alias("_y"))
    rows = classify(read)
    v = F.try_parse_json("_y.json")
    rows = rows.select(
        "*",
        front.alias("front"),
        F.ltrim(body, F.lit("\n")).alias("content"),
        v.alias("_v"),
        by_status("YES", include_working=False).alias("confirmed"),
        by_status("POSSIBLE").alias("possible"),
        by_status("NO").alias("rejected"),
    )
    number, flag, previous = revision_parts(F.col("_v"))
    rows = rows.select(
        "*", number.alias("number_json"), flag.alias("is_revision"), previous.alias("previous_json")
    )
    index = F.size("confirmed") > 0
    rows = rows.select(
        "*",
        X.to_json(
            X.sorted_struct(
                {
                    "number": F.try_parse_json("number_json"),
                    "is_revision": F.col("is_revision"),
                    "previous_revision": F.try_parse_json("previous_json"),
                }
            )
        ).alias("revision_json"),
        F.to_json(F.struct("confirmed", "possible", "rejected")).alias("mechanisms_json"),
        (~F.col("is_revision")).alias("store_required"),
        F.col("is_revision").alias("update_required"),
        index.alias("index_required"),
        F.lit(False).alias("ignore_required"),
        F.lit(K.STORE_REASON).alias("store_reason"),
        F.when(F.col("is_revision"), F.lit(K.UPDATE_YES_REASON)).otherwise(F.lit(K.UPDATE_NO_REASON)).alias("update_reason"),
        F.when(index, F.lit(K.INDEX_YES_REASON)).otherwise(F.lit(K.INDEX_NO_REASON)).alias("index_reason"),
        F.lit(K.IGNORE_REASON).alias("ignore_reason"),
    )
    error = F.coalesce(F.col("_y.error"), F.col("error"))
    return rows.select(
        "path",
        F.col("id").alias("information_id"),
        "confirmed",
        "possible",
        "rejected",
        "number_json",
        "is_revision",
        "previous_json",
        "revision_json",
        "mechanisms_json",
        *[f"{o}_{p}" for o in ("store", "update", "index", "ignore") for p in ("required", "reason")],
        F.when(error.isNull(), _plan_json()).alias("plan"),
        _has_exponent(F.col("_v")).alias("hash_caution"),
        error.alias("error"),
    )


def _has_exponent(v: Column) -> Column:
    """Whether a number is written with an exponent.

    Such numbers have more than one spelling in use, so a digest of the plan may
    differ from one made elsewhere; text that looks like one only adds caution.
    """
    return F.coalesce(F.to_json(v).rlike(r"[\[:,]-?\d+(\.\d+)?E-?\d+"), F.lit(False))


def _plan_json() -> Column:
    v = F.col("_v")

    def member(name: str, default: str = "null") -> Column:
        return F.coalesce(
            F.try_variant_get(v, f"$.{name}", "variant"), F.parse_json(F.lit(default))
        )

    record = {
        "identity": X.sorted_struct(
            {"id": F.col("id"), "revision": F.try_parse_json("revision_json")}
        ),
        "classification": X.sorted_struct(
            {
                "type": F.col("type"),
                "epistemic_status": F.coalesce("epistemic_status", F.lit("UNKNOWN")),
                "operational_state": F.coalesce("operational_state", F.lit("UNKNOWN")),
                "confidence": member("confidence"),
                "importance": member("importance"),
            }
        ),
        **{n: member(n, "{}") for n in ("context", "provenance", "evidence", "time")},
        **{n: member(n, "[]") for n in ("relations", "triggers")},
        "retention": member("retention"),
        "content": F.col("content"),
        "source": X.sorted_struct(
            {"path": F.col("path"), "front_matter": F.col("front"), "content": F.col("content")}
        ),
    }
    verdicts = {
        m: X.sorted_struct(
            {p: F.col(f"mechanisms.{m}.{p}") for p in ("status", "reason")}
        )
        for m in K.MECHANISMS
    }
    operations = {
        o: X.sorted_struct({p: F.col(f"{o.lower()}_{p}") for p in ("required", "reason")})
        for o in K.PLAN_OPERATIONS
    }
    return X.to_json(
        X.sorted_struct(
            {
                "schema_version": F.lit(K.PLAN_SCHEMA),
                "information": X.sorted_struct(record),
                "classification": X.sorted_struct(verdicts),
                "mechanisms": F.struct("confirmed", "possible", "rejected"),
                "operations": X.sorted_struct(operations),
                "safety": X.sorted_struct({n: F.lit(False) for n in K.PLAN_SAFETY_FLAGS}),
            }
        )
    )

"""Decisions on execution plans and their application.

``decide`` compares plans with the operation ledger and the persistent records.
``apply_plans`` carries the allowed ones out as set operations.  Plans act in
order of ``seq``.  A record is written from its one working text, so after the
first write of an id its persistent state is the working state: a later plan of
the same id is decided against that instead of the stored state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.sizing import stable
from recordloom.operators.information import state_text, text_states

_STATE = ("exists", "valid", "same_id", "revision", "structured", "epistemic", "operational")

# Results of plans that were carried out, and so are in the ledger.
EXECUTED = ("STORE", "UPDATE", "INDEX", "INDEX_REFUSED")


def idempotency(plans: DataFrame, operations: DataFrame) -> DataFrame:
    """State of every plan in the ledger: NEW, ALREADY_EXECUTED or CONFLICT.

    The ledger counts once for each operation, however often it holds it; an
    operation recorded under several hashes conflicts with every plan.
    """
    marked = F.coalesce(F.concat(F.lit("="), "execution_plan_hash"), F.lit(""))
    ledger = operations.groupBy("operation_id").agg(
        F.min("execution_plan_hash").alias("stored_hash"),
        (F.min(marked) == F.max(marked)).alias("single"),
    )
    state = (
        F.when(F.col("single").isNull(), F.lit("NEW"))
        .when(
            F.col("single") & F.col("stored_hash").eqNullSafe(F.col("execution_plan_hash")),
            F.lit("ALREADY_EXECUTED"),
        )
        .otherwise(F.lit("CONFLICT"))
    )
    return plans.join(ledger, "operation_id", "left").withColumn("idempotency", state).drop("single")


def _persistent_columns(texts: DataFrame, prefix: str) -> DataFrame:
    """State of record texts under a column prefix, keyed by information_id."""
    s = text_states(texts)
    return s.select(
        F.col("record_id").alias("information_id"),
        F.lit(True).alias(prefix + "exists"),
        (F.size("errors") == 0).alias(prefix + "valid"),
        (F.col("id") == F.col("record_id")).alias(prefix + "same_id"),
        F.coalesce("structured_number", "flat_revision").alias(prefix + "revision"),
        F.col("structured_number").try_cast("int").alias(prefix + "structured"),
        F.col("epistemic_status").alias(prefix + "epistemic"),
        F.col("operational_state").alias(prefix + "operational"),
    )


def _decision(state: Column, exists: Column, revision: Column) -> Column:
    """Key of the decision table; the order of the rules matters."""
    update, store = F.col("update_required"), F.col("store_required")
    index, ignore = F.col("index_required"), F.col("ignore_required")
    previous = F.col("previous_json") != "null"
    number = _bare(F.col("number_json"))
    partial = update & exists & F.coalesce(revision == number, F.lit(False)) & previous
    return (
        F.when(state == "CONFLICT", F.lit("CONFLICT"))
        .when(state == "ALREADY_EXECUTED", F.lit("ALREADY_EXECUTED"))
        .when(partial, F.lit("PARTIAL"))
        .when(ignore & (store | update | index), F.lit("IGNORE_CONTRADICTION"))
        .when(ignore, F.lit("IGNORE_ONLY"))
        .when(update & ~previous, F.lit("UPDATE_NO_PREVIOUS"))
        .when(update & ~exists, F.lit("UPDATE_ABSENT"))
        .when(update, F.lit("UPDATE_ALLOWED"))
        .when(store & exists, F.lit("STORE_EXISTS"))
        .when(store, F.lit("STORE_ALLOWED"))
        .when(index, F.lit("INDEX_ALLOWED"))
        .otherwise(F.lit("NOTHING"))
    )


def _bare(json: Column) -> Column:
    """A JSON number or text without quotes."""
    return F.regexp_replace(json, r'\A"|"\z', "")


_RESULTS = {
    "CONFLICT": "BLOCK",
    "ALREADY_EXECUTED": "NO-OP",
    "PARTIAL": "ALLOW",
    "IGNORE_CONTRADICTION": "BLOCK",
    "IGNORE_ONLY": "NO-OP",
    "UPDATE_NO_PREVIOUS": "BLOCK",
    "UPDATE_ABSENT": "BLOCK",
    "UPDATE_ALLOWED": "ALLOW",
    "STORE_EXISTS": "BLOCK",
    "STORE_ALLOWED": "ALLOW",
    "INDEX_ALLOWED": "ALLOW",
    "NOTHING": "NO-OP",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def decide(plans: DataFrame, operations: DataFrame, persistent: DataFrame) -> DataFrame:
    """Decision on every plan against the ledger and the persistent record texts.

    Adds idempotency, decision (ALLOW, BLOCK, NO-OP), decision_reason and the
    columns of the persistent state (``p_…``).
    """
    states = _persistent_columns(persistent, "p_")
    rows = idempotency(plans, operations).join(states, "information_id", "left")
    rows = rows.withColumn("p_exists", F.coalesce("p_exists", F.lit(False)))
    rows = rows.withColumn(
        "rule", _decision(F.col("idempotency"), F.col("p_exists"), F.col("p_revision"))
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("rule", "idempotency")],
        F.when(F.col("rule") == "PARTIAL", F.lit("PARTIAL"))
        .otherwise(F.col("idempotency"))
        .alias("idempotency"),
        "rule",
        _lookup(F.col("rule"), _RESULTS).alias("decision"),
        _lookup(F.col("rule"), K.DECISION_REASONS).alias("decision_reason"),
    )


def _execution(rule: Column, p: str) -> Column:
    return X.let(rule, lambda known: _execution_of(known, p))


def _execution_of(rule: Column, p: str) -> Column:
    """What carrying out an allowed plan leads to, given a persistent state.

    A code: STORE, UPDATE, INDEX, INDEX_REFUSED, the reason of a refusal, or
    the decision itself where nothing is to be done.
    """

    def state(name: str) -> Column:
        return F.col(p + name)

    def no(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    number = F.col("number_json").try_cast("int")
    previous = F.col("previous_json").try_cast("int")
    store = X.first_error(
        (state("exists"), "STORE_EXISTS"),
        (F.col("w_exists").isNull(), "SOURCE_ABSENT"),
        (no(F.col("w_valid")), "SOURCE_INVALID"),
        (no(F.col("w_same_id")), "SOURCE_ID_DIFFERS"),
    )
    update = F.when(
        rule != "PARTIAL",
        X.first_error(
            (F.col("w_exists").isNull(), "SOURCE_ABSENT"),
            (~state("exists"), "PERSISTENT_ABSENT"),
            (no(F.col("w_valid")), "SOURCE_INVALID"),
            (no(F.col("w_same_id")), "SOURCE_ID_DIFFERS"),
            (F.col("w_structured").isNull(), "SOURCE_REVISION_ABSENT"),
            (no(F.col("w_structured") == number), "SOURCE_REVISION_DIFFERS"),
            (no(state("valid")), "PERSISTENT_INVALID"),
            (no(state("same_id")), "PERSISTENT_ID_DIFFERS"),
            (state("structured").isNull(), "PERSISTENT_REVISION_INVALID"),
            (no(state("structured") == previous), "PERSISTENT_REVISION_DIFFERS"),
        ),
    ).otherwise(F.when(no(state("valid")), F.lit("PERSISTENT_INVALID")))
    indexed = (
        F.when(~F.col("index_required"), F.lit("UPDATE"))
        .when(F.size("confirmed") > 0, F.lit("INDEX"))
        .otherwise(F.lit("INDEX_REFUSED"))
    )
    allowed = _lookup(rule, _RESULTS) == "ALLOW"
    return (
        F.when(~allowed, rule)
        .when(F.col("store_required"), F.coalesce(store, F.lit("STORE")))
        .when(F.col("update_required"), F.coalesce(update, indexed))
        .otherwise(rule)
    )


def apply_plans(
    decided: DataFrame, working: DataFrame, persistent: DataFrame, now: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Carry out decided plans (with ``seq``) in order.

    ``working`` and ``persistent`` are record texts (path, text).  Returns the
    new persistent texts, events, ledger rows and one outcome per plan.
    """
    rows = decided.join(_persistent_columns(working, "w_"), "information_id", "left")
    # The record texts are read and compared once; what follows works on the kept states.
    rows = stable(rows.withColumn("code", _execution(F.col("rule"), "p_")))
    is_write = F.col("code").isin("STORE") | (
        F.col("code").isin("UPDATE", "INDEX", "INDEX_REFUSED") & (F.col("rule") != "PARTIAL")
    )
    first = keep_where(rows, is_write).groupBy("information_id").agg(F.min("seq").alias("write_seq"))
    rows = rows.join(first, "information_id", "left")

    # Plans after the first write of their id meet the working state.
    later = F.coalesce(F.col("seq") > F.col("write_seq"), F.lit(False))
    base = F.when(F.col("idempotency") == "PARTIAL", F.lit("NEW")).otherwise(F.col("idempotency"))
    after = _decision(base, F.lit(True), F.col("w_revision"))
    rows = rows.withColumn("rule", F.when(later, after).otherwise(F.col("rule")))
    rows = rows.withColumn(
        "code", F.when(later, _execution(F.col("rule"), "w_")).otherwise(F.col("code"))
    )

    # An operation executed earlier in the batch is in the ledger for the rest.
    done = (
        keep_where(rows, F.col("code").isin(*EXECUTED))
        .groupBy("operation_id")
        .agg(F.min("seq").alias("done_seq"), F.min_by("execution_plan_hash", "seq").alias("done_hash"))
    )
    rows = rows.join(done, "operation_id", "left")
    repeated = F.coalesce(F.col("seq") > F.col("done_seq"), F.lit(False))
    again = F.when(
        F.col("done_hash") == F.col("execution_plan_hash"), F.lit("ALREADY_EXECUTED")
    ).otherwise(F.lit("CONFLICT"))
    rows = rows.withColumn("code", F.when(repeated, again).otherwise(F.col("code")))
    executed = F.col("code").isin(*EXECUTED)
    result = (
        F.when(F.col("code") == "INDEX_REFUSED", F.lit("BLOCK"))
        .when(executed, F.col("code"))
        .otherwise(F.coalesce(_lookup(F.col("code"), _RESULTS), F.lit("BLOCK")))
    )
    rows = rows.withColumn("result", result)

    written = keep_where(rows, executed & (F.col("seq") == F.col("write_seq"))).select("information_id")
    named = F.regexp_extract("path", r"([^/]*)\.md\z", 1)
    new_texts = (
        working.withColumn("information_id", named)
        .join(written, "information_id", "left_semi")
        .select(F.concat(F.lit("persistent/"), "information_id", F.lit(".md")).alias("path"), "text")
    )
    kept = (
        persistent.withColumn("information_id", named)
        .join(written, "information_id", "left_anti")
        .select("path", "text")
    )

    finished = keep_where(rows, executed)
    stored = F.col("code") == "STORE"
    fresh = F.col("rule") != "PARTIAL"
    number = F.col("number_json").try_cast("int")
    events = finished.select(
        X.derived_id("event", F.col("operation_id")).alias("event_id"),
        "information_id",
        number.alias("revision"),
        F.when(stored, F.lit("STORED")).otherwise(F.lit("UPDATED")).alias("event_type"),
        F.lit(None).cast("string").alias("before"),
        F.when(fresh | later, state_text(F.col("w_epistemic"), F.col("w_operational")))
        .otherwise(state_text(F.col("p_epistemic"), F.col("p_operational")))
        .alias("after"),
        F.when(stored, F.lit("MEMORY_OPERATION")).otherwise(F.lit("NEW_INFORMATION")).alias("cause_type"),
        F.when(stored, F.lit(K.STORED_DESCRIPTION)).otherwise(F.lit(K.UPDATED_DESCRIPTION)).alias("description"),
        F.col("operation_id").alias("caused_by_operation"),
        F.lit(now).alias("timestamp"),
    )
    ledger = finished.select(
        "operation_id",
        "execution_plan_hash",
        "information_id",
        F.when(stored, F.lit("STORE")).otherwise(F.lit("UPDATE")).alias("result"),
        F.lit("EXECUTED").alias("status"),
        F.lit(now).alias("timestamp"),
    )
    outcomes = rows.select("seq", "operation_id", "information_id", "result", "code")
    return kept.unionByName(new_texts), events, ledger, outcomes


def index_outcomes(outcomes: DataFrame) -> DataFrame:
    """Plans whose index step was reached, and whether it is ready."""
    return outcomes.filter(F.col("code").isin("INDEX", "INDEX_REFUSED", "INDEX_ALLOWED")).select(
        "seq",
        "information_id",
        F.when(F.col("code") == "INDEX", F.lit("READY"))
        .when(F.col("code") == "INDEX_REFUSED", F.lit("REFUSED"))
        .otherwise(F.lit("ALLOWED"))
        .alias("index_status"),
    )

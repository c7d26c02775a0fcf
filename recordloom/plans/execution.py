"""Execution plans: checks of stored plans, prepared operations, operation ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where

# --- checks of plan documents ------------------------------------------------


def _is_object(v: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))


def _at(path: str) -> Column:
    return F.try_variant_get(F.col("_v"), "$." + path, "variant")


def _quoted(v: Column) -> Column:
    """A value as messages show it: text in single quotes, None when absent."""
    rendered = F.to_json(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (rendered == "null"), F.lit("None"))
        .when(rendered.startswith('"'), F.concat(F.lit("'"), text, F.lit("'")))
        .otherwise(rendered)
    )


def _has_keys(path: str, names: tuple[str, ...]) -> Column:
    """Which of the names an object has."""
    keys = F.coalesce(
        F.json_object_keys(F.to_json(_at(path))), F.array().cast("array<string>")
    )
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.array_contains(keys, n))


def _text_at(path: str) -> Column:
    return F.try_variant_get(F.col("_v"), "$." + path, "string")


def _is_text(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(path)), F.lit("")) == "STRING"


def plan_errors(documents: DataFrame) -> DataFrame:
    """First error of every memory plan document (plan_id, document)."""
    rows = documents.withColumn("_v", F.try_parse_json("document"))
    info = "memory_plan.information"
    missing = _has_keys(info, K.PLAN_INFORMATION_FIELDS)
    identity = F.to_json(_at(info + ".identity.id"))
    checks: list[tuple[Column, Column | str]] = [
        (F.col("_v").isNull(), "Memory Plan JSON invalide"),
        (~_is_object(F.col("_v")), "Memory Plan invalide : objet JSON attendu."),
        (_at("memory_plan").isNull(), "Champ memory_plan absent."),
        (~_is_object(_at("memory_plan")), "memory_plan doit être un objet."),
        (
            ~(_is_text("memory_plan.schema_version") & (_text_at("memory_plan.schema_version") == K.PLAN_SCHEMA)),
            F.concat(
                F.lit("Schema non supporté : "),
                _quoted(_at("memory_plan.schema_version")),
                F.lit(f". Version attendue : {K.PLAN_SCHEMA}."),
            ),
        ),
        (~_is_object(_at(info)), "Champ information absent ou invalide."),
        (
            F.size(missing) > 0,
            F.concat(
                F.lit("Information incomplète. Champs manquants : "), F.array_join(missing, ", ")
            ),
        ),
        (~_is_object(_at(info + ".identity")), "information.identity invalide."),
        (
            F.coalesce(
                identity.isin("null", '""', "0", "false", "[]", "{}"), F.lit(True)
            ),
            "information.identity.id absent.",
        ),
        (~_is_object(_at(info + ".identity.revision")), "information.identity.revision invalide."),
        (
            F.size(_has_keys(info + ".identity.revision", ("number",))) > 0,
            "information.identity.revision.number absent.",
        ),
        (~_is_object(_at(info + ".classification")), "information.classification invalide."),
        (~_is_object(_at("memory_plan.operations")), "Champ operations absent ou invalide."),
    ]
    for operation in K.PLAN_OPERATIONS:
        path = f"memory_plan.operations.{operation}"
        checks += [
            (
                F.size(_has_keys("memory_plan.operations", (operation,))) > 0,
                f"Opération {operation} absente.",
            ),
            (~_is_object(_at(path)), f"Opération {operation} invalide."),
            (
                F.size(_has_keys(path, ("required",))) > 0,
                f"Opération {operation} : champ required absent.",
            ),
            (
                F.size(_has_keys(path, ("reason",))) > 0,
                f"Opération {operation} : champ reason absent.",
            ),
        ]
    return rows.withColumn("error", X.first_error(*_safe(checks))).drop("_v")


def execution_plan_errors(documents: DataFrame) -> DataFrame:
    """First error of every execution plan document (plan_id, document)."""
    rows = documents.withColumn("_v", F.try_parse_json("document"))
    top = "execution_plan"

    def filled(path: str) -> Column:
        return _is_text(path) & (_text_at(path) != "")

    checks: list[tuple[Column, Column | str]] = [
        (F.col("_v").isNull(), "Execution Plan JSON invalide"),
        (~_is_object(F.col("_v")), "Execution Plan invalide : objet JSON attendu."),
        (~_is_object(_at(top)), "Champ execution_plan absent ou invalide."),
        (
            ~(_is_text(top + ".schema_version") & (_text_at(top + ".schema_version") == K.EXECUTION_SCHEMA)),
            F.concat(
                F.lit("Execution Plan schema non supporté : "),
                _quoted(_at(top + ".schema_version")),
                F.lit(f". Version attendue : {K.EXECUTION_SCHEMA}."),
            ),
        ),
        (~filled(top + ".operation_id"), "Execution Plan : operation_id absent ou invalide."),
        (~_is_object(_at(top + ".input")), "Execution Plan : input absent ou invalide."),
        (
            ~filled(top + ".input.information_id"),
            "Execution Plan : information_id absent ou invalide.",
        ),
        (
            ~_is_object(_at(top + ".input.revision")),
            "Execution Plan : revision absente ou invalide.",
        ),
        (
            ~_is_object(_at(top + ".operations")),
            "Execution Plan : operations absentes ou invalides.",
        ),
    ]
    checks += [
        (
            F.size(_has_keys(top + ".operations", (o,))) > 0,
            f"Execution Plan : opération {o} absente.",
        )
        for o in K.PLAN_OPERATIONS
    ]
    return rows.withColumn("error", X.first_error(*_safe(checks))).drop("_v")


def _safe(checks: list[tuple[Column, Column | str]]) -> list[tuple[Column, Column | str]]:
    """An undecidable check (a missing member) counts as failed."""
    return [(F.coalesce(bad, F.lit(True)), text) for bad, text in checks]


def plan_rejects(documents: DataFrame) -> DataFrame:
    return keep_where(plan_errors(documents), F.col("error").isNotNull()).select("plan_id", "error")


def execution_plan_rejects(documents: DataFrame) -> DataFrame:
    checked = execution_plan_errors(documents)
    return keep_where(checked, F.col("error").isNotNull()).select("plan_id", "error")


def read_plans(documents: DataFrame) -> DataFrame:
    """Plan columns of valid memory plan documents, as ``route`` produces them."""
    valid = keep_where(plan_errors(documents), F.col("error").isNull())
    rows = valid.withColumn("_v", F.try_parse_json("document"))
    info = "memory_plan.information"
    rev = info + ".identity.revision"

    def rendered(path: str, default: str = "null") -> Column:
        return F.coalesce(X.small_escapes(F.to_json(_at(path))), F.lit(default))

    def truth(path: str) -> Column:
        return ~rendered(path).isin("false", "null", "0", "0.0", '""', "[]", "{}")

    columns = []
    for o in K.PLAN_OPERATIONS:
        path = f"memory_plan.operations.{o}"
        columns.append(truth(path + ".required").alias(o.lower() + "_required"))
        columns.append(_text_at(path + ".reason").alias(o.lower() + "_reason"))

    def names(kind: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.memory_plan.mechanisms.{kind}", "array<string>")

    return rows.select(
        "plan_id",
        _text_at(info + ".source.path").alias("path"),
        _text_at(info + ".identity.id").alias("information_id"),
        names("confirmed").alias("confirmed"),
        names("possible").alias("possible"),
        names("rejected").alias("rejected"),
        rendered(rev + ".number").alias("number_json"),
        (rendered(rev + ".is_revision") == "true").alias("is_revision"),
        rendered(rev + ".previous_revision").alias("previous_json"),
        rendered(rev).alias("revision_json"),
        rendered("memory_plan.mechanisms", "{}").alias("mechanisms_json"),
        *columns,
        rendered("memory_plan").alias("plan"),
    )


# --- operations --------------------------------------------------------------


def prepare_operations(plans: DataFrame) -> DataFrame:
    """Status and reason of the four operations of every plan."""
    no_previous = F.col("previous_json") == "null"
    statuses = {
        "store": F.lit("READY"),
        "update": F.when(~F.col("is_revision") | no_previous, F.lit("BLOCKED")).otherwise(
            F.lit("READY")
        ),
        "index": F.lit("PENDING"),
        "ignore": F.lit("IGNORED"),
    }
    update_reason = (
        F.when(~F.col("update_required"), F.col("update_reason"))
        .when(~F.col("is_revision"), F.lit(K.UPDATE_WITHOUT_FLAG))
        .when(no_previous, F.lit(K.UPDATE_WITHOUT_PREVIOUS))
        .otherwise(F.col("update_reason"))
    )
    return plans.select(
        *[c for c in plans.columns if c != "update_reason"],
        update_reason.alias("update_reason"),
        *[
            F.when(F.col(n + "_required"), status)
            .otherwise(F.lit("NOT_REQUESTED"))
            .alias(n + "_status")
            for n, status in statuses.items()
        ],
    )


def is_contradictory() -> Column:
    return F.col("ignore_required") & (
        F.col("store_required") | F.col("update_required") | F.col("index_required")
    )


def contradictory_plans(plans: DataFrame) -> DataFrame:
    """Plans that ask to ignore a record and to do something with it."""
    return keep_where(plans, is_contradictory())


def with_operation_id(plans: DataFrame) -> DataFrame:
    """Operation id: digest of the plan's canonical JSON."""
    return plans.withColumn("operation_id", F.concat(F.lit("op-"), X.sha256(F.col("plan"))))


def execution_plans(plans: DataFrame) -> DataFrame:
    """Execution plans of consistent memory plans, with canonical JSON and its hash."""
    ready = with_operation_id(prepare_operations(keep_where(plans, ~is_contradictory())))
    operations = {
        o: X.sorted_struct({p: F.col(f"{o.lower()}_{p}") for p in ("required", "status", "reason")})
        for o in K.PLAN_OPERATIONS
    }
    execution = X.sorted_struct(
        {
            "schema_version": F.lit(K.EXECUTION_SCHEMA),
            "operation_id": F.col("operation_id"),
            "executor": X.sorted_struct(
                {
                    "component": F.lit(K.EXECUTOR_NAME),
                    "version": F.lit(K.EXECUTION_SCHEMA),
                    "mode": F.lit(K.EXECUTOR_MODE),
                }
            ),
            "input": X.sorted_struct(
                {
                    "memory_plan_schema": F.lit(K.PLAN_SCHEMA),
                    "information_id": F.col("information_id"),
                    "revision": F.try_parse_json("revision_json"),
                    "source_path": F.col("path"),
                    "mechanisms": F.try_parse_json("mechanisms_json"),
                }
            ),
            "operations": X.sorted_struct(operations),
            "safety": X.sorted_struct({n: F.lit(False) for n in K.EXECUTION_SAFETY_FLAGS}),
        }
    )
    # The content is in the id by now; later steps carry the short form only.
    return (
        ready.drop("plan")
        .withColumn("execution", X.to_json(execution))
        .withColumn("execution_plan_hash", X.sha256(F.col("execution")))
    )

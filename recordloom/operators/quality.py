"""Semantic quality report over record texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X


def semantic_report(texts: DataFrame) -> DataFrame:
    """Errors and warnings per record text (path, text).

    Keys are read from the lines before the first heading.  Relation types are
    checked only in an indented block, and only the first source type counts.
    """
    text = F.col("text")
    # everything before the first line that starts with "# "
    head = F.substring_index(F.concat(F.lit("\n"), text), "\n# ", 1)
    framed = texts.withColumn("_head", head)

    def value(name: str):
        return F.regexp_replace(X.field(F.col("_head"), name), r'\A"+|"+\z', "")

    def present(name: str):
        return F.col("_head").rlike(rf"(?md)^{name}:")

    block = F.regexp_extract(text, r"(?mds)^relations:\s*\n(.*?)(?=^\S|\z)", 1)
    framed = framed.select(
        "path",
        "text",
        "_head",
        value("epistemic_status").alias("_epistemic"),
        value("operational_state").alias("_operational"),
        F.regexp_extract_all(block, F.lit(r"type:\s*([A-Z_]+)"), F.lit(1)).alias("_types"),
        F.regexp_extract(text, r"source_type:\s*([A-Z_]+)", 1).alias("_source"),
    )
    checks = [(~present(n), f"champ absent: {n}") for n in K.REPORT_FIELDS]
    for name, column, domain in (
        ("epistemic_status", F.col("_epistemic"), K.EPISTEMIC_STATUSES),
        ("operational_state", F.col("_operational"), K.OPERATIONAL_STATES),
    ):
        checks.append(
            (
                column.isNotNull() & ~column.isin(*domain),
                F.concat(F.lit(f"{name} invalide: "), column),
            )
        )
    checks += [
        (~F.contains(text, F.lit("provenance:")), "bloc provenance absent"),
        (~F.contains(text, F.lit("relations:")), "bloc relations absent"),
    ]
    wrong = F.transform(
        F.filter("_types", lambda t: ~t.isin(*K.RELATION_TYPES)),
        lambda t: F.concat(F.lit("relation invalide: "), t),
    )
    source = F.array_compact(
        F.array(
            F.when(
                (F.col("_source") != "") & ~F.col("_source").isin(*K.SOURCE_TYPES),
                F.concat(F.lit("source_type invalide: "), "_source"),
            )
        )
    )
    warnings = X.all_errors(
        (~F.contains(text, F.lit("time:")), "bloc time absent"),
        *[
            (text.rlike(rf"(?md)^{n}:\s*$"), f"{n} présent mais non renseigné")
            for n in K.TIME_FIELDS
        ],
    )
    return framed.select(
        "path",
        F.concat(X.all_errors(*checks), wrong, source).alias("errors"),
        warnings.alias("warnings"),
    )


def error_counts(report: DataFrame) -> DataFrame:
    """How many records have each error."""
    return (
        report.select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("records"))
    )

"""Mechanism classification of information records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where


def classify(texts: DataFrame) -> DataFrame:
    """Status and reason of the six mechanisms for every record text.

    Columns: path, id, type, epistemic_status, operational_state (as written),
    ``mechanisms`` (struct per mechanism of status and reason) and ``error``.
    """
    front, _ = X.split_front(F.col("text"))
    rows = texts.withColumn("_front", front)
    names = ("id", "type", "epistemic_status", "operational_state")
    rows = rows.select(
        *texts.columns, *[X.field(F.col("_front"), n).alias(n) for n in names], "_front"
    )
    error = X.first_error(
        (F.col("_front").isNull(), "front matter absent"),
        (F.col("id").isNull(), "champ id absent"),
        (F.col("type").isNull(), "champ type absent"),
    )
    return rows.select(
        *texts.columns,
        *names,
        mechanisms(F.col("type"), F.col("epistemic_status"), F.col("text")).alias("mechanisms"),
        error.alias("error"),
    )


def mechanisms(kind: Column, epistemic: Column, text: Column) -> Column:
    kind = F.upper(F.coalesce(kind, F.lit("")))
    epistemic = F.upper(F.coalesce(epistemic, F.lit("")))

    def verdict(status: str, reason: Column | str) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    before, after = K.EPISODIC_YES_REASON.split("{}")
    semantic = kind.isin(*K.SEMANTIC_TYPES)
    return F.struct(
        verdict("YES", K.WORKING_REASON).alias("WORKING"),
        F.when(
            kind.isin(*K.EPISODIC_TYPES),
            verdict("YES", F.concat(F.lit(before), kind, F.lit(after))),
        )
        .otherwise(verdict("POSSIBLE", K.EPISODIC_POSSIBLE_REASON))
        .alias("EPISODIC"),
        F.when(semantic & (epistemic == "CONFIRMED"), verdict("POSSIBLE", K.SEMANTIC_CONFIRMED_REASON))
        .when(semantic, verdict("POSSIBLE", K.SEMANTIC_UNCONFIRMED_REASON))
        .otherwise(verdict("POSSIBLE", K.SEMANTIC_OTHER_REASON))
        .alias("SEMANTIC"),
        F.when(text.rlike("(?i)" + K.ASSOCIATIVE_MARKER), verdict("YES", K.ASSOCIATIVE_YES_REASON))
        .otherwise(verdict("POSSIBLE", K.ASSOCIATIVE_POSSIBLE_REASON))
        .alias("ASSOCIATIVE"),
        F.when(kind == "PROCEDURE", verdict("YES", K.PROCEDURAL_YES_REASON))
        .otherwise(verdict("NO", K.PROCEDURAL_NO_REASON))
        .alias("PROCEDURAL"),
        verdict("NO", K.PROSPECTIVE_REASON).alias("PROSPECTIVE"),
    )


def mechanism_rows(classified: DataFrame) -> DataFrame:
    """Classification in long form: one row per record and mechanism."""
    listed = F.array(
        *[
            F.struct(
                F.lit(m).alias("mechanism"),
                F.col(f"mechanisms.{m}.status").alias("status"),
                F.col(f"mechanisms.{m}.reason").alias("reason"),
            )
            for m in K.MECHANISMS
        ]
    )
    return keep_where(classified, F.col("error").isNull()).select("id", F.inline(listed))


def by_status(status: str, include_working: bool = True) -> Column:
    """Mechanisms with a status, in their fixed order."""
    names = [m for m in K.MECHANISMS if include_working or m != "WORKING"]
    return F.array_compact(
        F.array(*[F.when(F.col(f"mechanisms.{m}.status") == status, F.lit(m)) for m in names])
    )

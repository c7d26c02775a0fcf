"""Exact duplicates by a heavy-hitter split, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.sizing import stable
from recordloom.llm.common import fresh

#: Frequent digests looked for, and counters a sketch keeps for them.
HEAVY, TRACKED = 256, 1024
#: Groups in which the tasks' sketches are merged before the last merge.
MERGES = 64


def digest_of(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def frequent(rows: DataFrame, column: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` values of a column, those with many rows among them.

    The frequent-items sketch is a Misra-Gries summary: ``tracked`` counters, lowered
    together when a new value finds none free.  Tasks build one each and these are
    merged, so any value with more than a few rows in ``tracked`` is found.
    """
    parts = (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("sketch"))
        .groupBy(F.lit(0).alias("all"))  # no group and so no sketch for an empty table
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    )
    return parts.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("t")).select(
        F.col("t.item").alias(column)
    )


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; a null counts as empty.  Of equal texts the row with
    the largest id stays.  Frequent digests found by :func:`frequent` are counted exactly;
    these winners (at most ``HEAVY`` rows) are broadcast and settle their rows where they
    lie.  Only the remaining digests, none of which is frequent, are shuffled.

    Rows repeated with the same id and text are members of their own and all bear the
    kept id; null ids lose against any other and keep each other; an empty table gives
    no rows; other columns are not read.
    """
    rows = stable(docs.select(F.col(id_column), digest_of(text_column).alias("text_sha256")))
    candidates = stable(frequent(rows, "text_sha256"))
    winners = (
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(id_column).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    hot = rows.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = rows.join(F.broadcast(candidates), "text_sha256", "left_anti").select(
        "*",
        F.max(id_column).over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    return hot.unionByName(rest).select(
        id_column,
        "keep_id",
        "group_size",
        F.col(id_column).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; equal id and text stay once."""
    mark = fresh(docs, "_text_sha256")
    kept = duplicate_groups(docs, id_column, text_column).filter("kept")
    kept = kept.select(F.col(id_column).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    marked = docs.withColumn(mark, digest_of(text_column))
    same = marked[id_column].eqNullSafe(kept["_kept_id"]) & (marked[mark] == kept["_kept_sha"])
    return marked.join(kept, same, "left_semi").dropDuplicates([id_column, mark]).drop(mark)

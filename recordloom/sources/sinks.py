"""Table sinks: logs that a rerun leaves as they are, and versioned snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unknown(rows: DataFrame, path: str, key: str) -> DataFrame:
    """One row for each key that the table at ``path`` doesn't hold yet.

    Of several rows with one key the least is taken, so a retried task agrees.
    """
    others = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    once = once.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in rows.columns])
    try:
        stored = rows.sparkSession.read.parquet(path).select(key)
    except AnalysisException:  # nothing written so far
        return once
    return once.join(stored, key, "left_anti")


def append_operations(operations: DataFrame, path: str) -> None:
    """Add the operations that the ledger doesn't hold; one row per operation."""
    _unknown(operations, path, "operation_id").write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add the events that the history doesn't hold, partitioned by day.

    Rows of a day are spread over tasks by event id, so a busy day is no single
    task, and a task writes one file per day it holds.
    """
    dated = events.withColumn("day", F.substring("timestamp", 1, 10))
    _unknown(dated, path, "event_id").write.mode("append").partitionBy("day").parquet(path)


def write_snapshot(table: DataFrame, path: str, version: int) -> str:
    """Write a new snapshot version next to the older ones."""
    target = f"{path}/version={version:010d}"
    table.write.mode("overwrite").parquet(target)
    return target

"""Operation plans as a stream: repeats dropped, conflicts reported.

The state of an operation is the hash it was first planned with, which stays for good, and the
hashes that were reported of late, which expire.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from recordloom.plans.decisions import idempotency
from recordloom.streaming.fold import with_store

JUDGED = "seq long, operation_id string, execution_plan_hash string, idempotency string"


def mark() -> Column:
    """A text for each hash and one for none."""
    return F.coalesce(F.concat(F.lit("="), "execution_plan_hash"), F.lit(""))


class OperationProcessor(StatefulProcessor):
    """Judges the plans of one operation.

    ``known`` is the :func:`mark` of its first plan's hash or of the ledger's, null if the ledger has several, and
    never expires, so a conflict is found however late it comes.  ``reported`` has an entry for each hash
    that was reported, which expires ``ttl`` milliseconds later; until then its repeats are dropped.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "mark string")
        self.reported = handle.getMapState("reported", "mark string", "seq long", self.ttl)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N803
        self.known.update((initialState["mark"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N803
        new = not self.known.exists()
        known = None if new else self.known.get()[0]
        seen: dict[str, bool] = {}
        for row in sorted(rows, key=lambda r: r["seq"]):
            planned = row["mark"]
            if planned not in seen:
                seen[planned] = self.reported.containsKey((planned,))
            if seen[planned]:
                continue
            if new:
                found, known, new = "NEW", planned, False
                self.known.update((planned,))
            else:
                found = "ALREADY_EXECUTED" if planned == known else "CONFLICT"
            seen[planned] = True
            self.reported.updateValue((planned,), (row["seq"],))
            yield Row(seq=row["seq"], operation_id=key[0], execution_plan_hash=row["execution_plan_hash"], idempotency=found)

    def close(self) -> None:
        pass


def judge_batch(plans: DataFrame, ledger: DataFrame) -> DataFrame:
    """Idempotency state of a micro-batch against the ledger and itself.

    The first plan of an unknown operation is NEW; later ones of the batch
    repeat it or conflict with it.
    """
    known = idempotency(plans, ledger).drop("stored_hash")
    first = plans.groupBy("operation_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("execution_plan_hash", "seq").alias("first_hash"),
    )
    repeated = (F.col("idempotency") == "NEW") & (F.col("seq") > F.col("first_seq"))
    same = F.col("first_hash") == F.col("execution_plan_hash")
    return (
        known.join(first, "operation_id")
        .withColumn(
            "idempotency",
            F.when(repeated & same, F.lit("ALREADY_EXECUTED"))
            .when(repeated, F.lit("CONFLICT"))
            .otherwise(F.col("idempotency")),
        )
        .drop("first_seq", "first_hash")
    )


def dedupe_stream(
    spark: SparkSession,
    plans: DataFrame,
    ledger: DataFrame,
    root: str,
    checkpoint: str,
    ttl_hours: float = 24,
) -> StreamingQuery:
    """Judge a stream of plans (seq, operation_id, execution_plan_hash); results go to files below ``root``.

    ``ledger`` are the operations known at the start.  Of an operation unknown so far the first plan is NEW.  Any other repeats
    the known hash or conflicts with it.  Exact repeats of a reported plan are dropped for ``ttl_hours``.
    """
    marked = ledger.groupBy("operation_id").agg(F.min(mark()).alias("mark"), F.max(mark()).alias("other"))
    known = marked.select("operation_id", F.when(F.col("mark") == F.col("other"), F.col("mark")).alias("mark"))
    judged = (
        plans.select("seq", "operation_id", "execution_plan_hash", mark().alias("mark"))
        .groupBy("operation_id")
        .transformWithState(
            statefulProcessor=OperationProcessor(max(1, int(ttl_hours * 3_600_000))),
            outputStructType=JUDGED,
            outputMode="Append",
            timeMode="ProcessingTime",
            initialState=known.groupBy("operation_id"),
        )
    )
    writer = (
        judged.writeStream.format("parquet")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return with_store(spark, writer.start, idle=False)

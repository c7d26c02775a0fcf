"""Snapshots on disk of which a batch rewrites only the parts that it touches.

A snapshot is a Parquet table partitioned by a hash of the key and, inside each
part, bucketed by the key.  A batch reads and replaces the parts that its keys
fall into (dynamic partition overwrite); all other files stay.  The table is
bucketed, so its rows are joined where they lie: a batch shuffles itself, never
the snapshot.

Deleted rows stay in their part as marked rows until the table is created anew,
as a part without rows would not be replaced.  A merge carries whole rows, so
one that was cut off halfway is finished by running it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from recordloom.functions.sizing import stable
from recordloom.operators import memories as M

PART, GONE = "_part", "_deleted"


class StoredSnapshot:
    """One row for each value of ``key``; rows without a key can't be stored."""

    def __init__(self, spark: SparkSession, name: str, key: str, parts: int) -> None:
        self.spark, self.name, self.key, self.parts = spark, name, key, parts

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, key: str, parts: int = 64, buckets: int = 8, name: str | None = None
    ) -> StoredSnapshot:
        """Write ``rows`` as a new snapshot below ``path``.

        ``parts`` times ``buckets`` is the number of files; a part is what a batch
        rewrites at least, so more parts suit small batches, and ``buckets`` is the
        number of tasks that a merge runs in.
        """
        spark = rows.sparkSession
        made = cls(spark, name or f"snapshot_{uuid.uuid4().hex}", key, parts)
        (
            rows.filter(F.col(key).isNotNull())
            .withColumn(GONE, F.lit(False))
            .withColumn(PART, made._part())
            .repartition(buckets, key)
            .write.partitionBy(PART)
            .bucketBy(buckets, key)
            .sortBy(key)
            .option("path", path)
            .option("partitionOverwriteMode", "dynamic")
            .saveAsTable(made.name)
        )
        return made

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _table(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """All rows of the snapshot."""
        return self._table().filter(~F.col(GONE)).drop(GONE, PART)

    def lookup(self, value: object) -> DataFrame:
        """The row of one key, from one part and, in it, one bucket."""
        kind = self._table().schema[self.key].dataType
        part = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.key)).select(self._part()).first()[0]
        rows = self._table().filter((F.col(PART) == part) & (F.col(self.key) == F.lit(value).cast(kind)))
        return rows.filter(~F.col(GONE)).drop(GONE, PART)

    def touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the parts that these keys fall into, at most ``parts`` of them."""
        found = keys.filter(F.col(self.key).isNotNull()).select(self._part().alias(PART)).distinct()
        return sorted(r[0] for r in found.collect())

    def near(self, keys: DataFrame) -> DataFrame:
        """All rows of the parts that these keys fall into: what a batch has to know of the snapshot."""
        return self._table().filter(F.col(PART).isin(self.touched(keys)) & ~F.col(GONE)).drop(GONE, PART)

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None) -> list[int]:
        """Replace or add the rows of ``changes`` and delete the keys of ``deleted``; returns the parts rewritten.

        Keys are unique in each of the two, and a key in both is deleted.  Extra columns
        are ignored, as are keys to delete that the snapshot doesn't hold.
        """
        columns = [c for c in self._table().columns if c not in (PART, GONE)]
        rows = changes.filter(F.col(self.key).isNotNull()).select(*columns, F.lit(False).alias(GONE))
        if deleted is not None:
            gone = deleted.filter(F.col(self.key).isNotNull()).select(self.key).distinct()
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._fields(columns) if f.name != self.key]
            rows = rows.join(gone, self.key, "left_anti").unionByName(gone.select(self.key, *nothing, F.lit(True).alias(GONE)))
        rows = stable(rows)
        parts = self.touched(rows)
        if not parts:
            return []
        self._merged(rows, parts).write.mode("overwrite").insertInto(self.name)
        return parts

    def _merged(self, rows: DataFrame, parts: list[int]) -> DataFrame:
        """The new rows of these parts, in the table's order of columns."""
        columns = self._table().columns
        new = rows.select(self.key, F.struct(*[c for c in rows.columns if c != self.key]).alias("_new"))
        old = self._table().filter(F.col(PART).isin(parts)).drop(PART)
        met = old.withColumn("_old", F.lit(True)).join(new, self.key, "full_outer")
        # a deleted row keeps its key alone; one that was never stored leaves no mark
        known = met.filter(F.col("_old").isNotNull() | ~F.col("_new")[GONE])

        def column(name: str) -> Column:
            if name == PART:
                return self._part().alias(PART)
            if name == self.key:
                return F.col(name)
            return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col(name)).alias(name)

        return known.select(*[column(c) for c in columns])

    def _fields(self, columns: list[str]) -> list[P.StructField]:
        schema = self._table().schema
        return [schema[c] for c in columns]


def store_memories(stored: StoredSnapshot, incoming: DataFrame) -> DataFrame:
    """Store new memories (see ``memories.store_batch``) in the parts they fall into; returns the outcomes."""
    keys = incoming.select(M.ID)
    near = stored.near(keys)
    after, outcomes = M.store_batch(near, incoming)
    outcomes = stable(outcomes)
    won = outcomes.filter(F.col("outcome") == "STORED").select(M.ID)
    stored.merge(after.join(won, M.ID, "left_semi"))
    return outcomes


def update_memories(stored: StoredSnapshot, updates: DataFrame) -> DataFrame:
    """Optimistic updates (see ``memories.update_batch``) of the parts they fall into; returns the outcomes."""
    after, outcomes = M.update_batch(stored.near(updates.select(M.ID)), updates)
    outcomes = stable(outcomes)
    changed = outcomes.filter(F.col("outcome") == "UPDATED").select(M.ID).distinct()
    stored.merge(after.join(changed, M.ID, "left_semi"))
    return outcomes


def delete_memories(stored: StoredSnapshot, requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide deletes (see ``memories.decide_deletes``); returns the requests with their last status and the outcomes."""
    _, decided, outcomes = M.decide_deletes(stored.near(decisions.select(M.ID)), requests, decisions)
    outcomes = stable(outcomes)
    approved = outcomes.filter(F.col("outcome") == "DELETED").select(M.ID)
    nothing = stored.read().limit(0)
    stored.merge(nothing, approved)
    return decided, outcomes

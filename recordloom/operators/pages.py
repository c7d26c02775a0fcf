"""Deep pages of sorted threads from a table that knows the rank of each row.

Skipping to a late page of a query sorts all rows for each page.  Here threads are sorted once,
dealt to ranges of the order and written with their place in the range; a small table has the
number of rows, the first and the last key of each range.  A page then reads the one or
two ranges that hold it, and so does a cursor that goes on after a given row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.operators.threads import check_page, sort_key

#: Rows of a range.
RANGE_ROWS = 1_000_000
KEY, PLACE, RANGE = "sort_key", "place", "range"


@dataclass(frozen=True)
class RankIndex:
    """Sorted threads below a folder: rows by range, and the ranges."""

    spark: SparkSession
    path: str
    descending: bool

    @staticmethod
    def write(threads: DataFrame, path: str, sort_by: str = "updated_at", sort_order: str = "DESC") -> RankIndex:
        """Sort once.  Ties keep file order in both directions, as in unindexed pages."""
        descending = sort_order == "DESC"
        keyed = threads.withColumn(KEY, sort_key(sort_by))
        order = [F.col(KEY).desc() if descending else F.col(KEY).asc(), X.file_order(F.col("thread_id"))]
        ranges = max(1, math.ceil(threads.count() / RANGE_ROWS))
        dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()
        # the number of a row holds that of its task and its place there
        placed = dealt.withColumn(RANGE, F.spark_partition_id()).withColumn(PLACE, number.bitwiseAND((1 << 33) - 1))
        placed.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
        rows = threads.sparkSession.read.parquet(f"{path}/rows")
        ends = F.struct(PLACE, KEY, X.file_order(F.col("thread_id")).alias("file"))
        counted = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), F.max(ends).alias("last"))
        counted.select(RANGE, "n", F.col(f"last.{KEY}").alias(KEY), "last.file").write.mode("overwrite").parquet(f"{path}/ranges")
        return RankIndex(threads.sparkSession, path, descending)

    def _rows(self, ranges: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col(RANGE).isin(ranges))

    def _ranges(self) -> list[tuple[int, int]]:
        """(range, rows) in order: one pair for each ``RANGE_ROWS`` rows of the table."""
        rows = self.spark.read.parquet(f"{self.path}/ranges").select(RANGE, "n")
        return sorted((r[0], r[1]) for r in rows.collect())

    def size(self) -> int:
        return sum(n for _, n in self._ranges())

    def page(self, limit: int = K.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        """The threads of ranks ``offset`` to ``offset + limit``, with their ``rank`` from 0."""
        check_page(limit, offset)
        wanted, before = {}, 0
        for number, n in self._ranges():
            if before < offset + limit and offset < before + n:
                wanted[number] = before
            before += n
        start = F.lit(0).cast("long")
        for number, first in wanted.items():  # one or two of them, more only for ranges shorter than a page
            start = F.when(F.col(RANGE) == number, F.lit(first).cast("long")).otherwise(start)
        ranked = self._rows(list(wanted)).withColumn("rank", start + F.col(PLACE))
        return ranked.filter((F.col("rank") >= offset) & (F.col("rank") < offset + limit)).drop(KEY, PLACE, RANGE).orderBy("rank")

    def after(self, key: object, thread_id: str, limit: int = K.DEFAULT_LIMIT) -> DataFrame:
        """The ``limit`` threads that follow the row with this sort key and id, which needn't exist any more."""
        check_page(limit, 0)

        def later(column: Column, file: Column) -> Column:
            given, name = F.lit(key), F.lit(thread_id + ".md")
            # nulls come first in ascending order and last in descending order
            if key is None:
                beyond = F.lit(False) if self.descending else column.isNotNull()
            elif self.descending:
                beyond = column.isNull() | (column < given)
            else:
                beyond = column > given
            return F.coalesce(beyond, F.lit(False)) | (column.eqNullSafe(given) & (file > name))

        ranges = self.spark.read.parquet(f"{self.path}/ranges").filter(later(F.col(KEY), F.col("file")))
        first, rows = [], 0
        for number, n in sorted((r[0], r[1]) for r in ranges.select(RANGE, "n").collect()):
            first.append(number)
            # the first range may lie before the cursor but for its last row
            rows += n if len(first) > 1 else 1
            if rows >= limit:
                break
        left = self._rows(first).filter(later(F.col(KEY), X.file_order(F.col("thread_id"))))
        return left.orderBy(RANGE, PLACE).limit(limit).drop(KEY, PLACE, RANGE)

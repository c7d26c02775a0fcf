"""Ordered work inside groups that may be very large.

A window over a key puts all rows of the key into one task.  A hot key (one
with more than ``max_rows`` rows) is therefore cut into chunks of consecutive
rows first; work inside a chunk runs in parallel and a short per-chunk summary
carries the result over to the next chunk.  Keys below the bound form a single
chunk and need no summary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.sizing import stable

MAX_GROUP_ROWS = 1_000_000


@dataclass(frozen=True)
class Chunked:
    """Rows with a ``chunk`` number that grows with the order inside each key."""

    rows: DataFrame
    key: str
    order: str
    split: bool

    def with_rows(self, rows: DataFrame) -> Chunked:
        return Chunked(rows, self.key, self.order, self.split)


def chunk(df: DataFrame, key: str, order: str, max_rows: int = MAX_GROUP_ROWS) -> Chunked:
    """Number consecutive chunks of every key by the numeric column ``order``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    largest = counts.agg(F.max("_rows")).first()[0] or 0
    if largest <= max_rows:
        return Chunked(df.withColumn("chunk", F.lit(0)), key, order, split=False)

    parts = math.ceil(largest / max_rows)
    marks = [i / parts for i in range(1, parts)]
    hot = counts.filter(F.col("_rows") > max_rows)
    bounds = (
        df.select(key, order)
        .join(hot.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.percentile_approx(order, marks, max(10_000, 20 * parts)).alias("_bounds"))
    )
    # The marks are approximate and may differ between two evaluations, so one
    # evaluation is kept for every use of the chunks.
    bounds = stable(bounds)
    rows = (
        df.join(bounds, key, "left")
        .withColumn(
            "chunk",
            F.coalesce(
                F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(0)
            ),
        )
        # size(null) is -1 where legacy sizing is on
        .withColumn("chunk", F.when(F.col("_bounds").isNull(), 0).otherwise(F.col("chunk")))
        .drop("_bounds")
    )
    return Chunked(rows, key, order, split=True)


def running(
    chunked: Chunked,
    counts: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: bool = False,
) -> Chunked:
    """Add running values per key, with or (``before``) without the current row.

    ``counts`` count the rows where a condition holds, ``lasts`` keep the last
    non-null value.
    """
    counts, lasts = counts or {}, lasts or {}
    key, order = chunked.key, chunked.order
    inside = (
        Window.partitionBy(key, "chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    zero = F.lit(0).cast("long")
    source = chunked.rows
    if chunked.split:
        # Rows already grouped by the key alone would satisfy the window below,
        # with the hot key still in one task: spread the chunks explicitly.
        source = source.repartition(key, "chunk")
    flag = {n: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long") for n, c in counts.items()}
    rows = source.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), zero).alias(n) for n, c in flag.items()],
        *[F.last(c, ignorenulls=True).over(inside).alias(n) for n, c in lasts.items()],
    )
    if not chunked.split:
        return chunked.with_rows(rows)

    totals = chunked.rows.groupBy(key, "chunk").agg(
        *[F.sum(c).alias("_c_" + n) for n, c in flag.items()],
        *[
            F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias("_l_" + n)
            for n, c in lasts.items()
        ],
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        key,
        "chunk",
        *[F.sum("_c_" + n).over(earlier).alias("_c_" + n) for n in counts],
        *[F.last("_l_" + n, ignorenulls=True).over(earlier).alias("_l_" + n) for n in lasts],
    )
    joined = rows.join(carry, [key, "chunk"], "left")
    for n in counts:
        joined = joined.withColumn(n, F.col(n) + F.coalesce(F.col("_c_" + n), zero))
    for n in lasts:
        joined = joined.withColumn(n, F.coalesce(F.col(n), F.col("_l_" + n)))
    return chunked.with_rows(
        joined.drop(*["_c_" + n for n in counts], *["_l_" + n for n in lasts])
    )

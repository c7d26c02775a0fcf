"""Joins on keys of which a few may hold a large share of all rows.

An ordinary join puts all rows of a key into one task.  Keys with more than a
bound of rows are listed (fewer than ``HOT_SHARE`` can exist, so the list is
broadcast); their rows are spread over salts and the one row of the other side
is copied to each salt.  Several joins on the same key share the salt, so rows
that are partitioned by it once stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key has more than 1 / HOT_SHARE of all rows, and more than HOT_ROWS.
HOT_SHARE = 200
HOT_ROWS = 100_000
SALT = "_salt"


@dataclass(frozen=True)
class Spread:
    """The hot values of a key column and the salts that each of them gets."""

    hot: DataFrame
    key: str

    def salted(self, rows: DataFrame, *by: str) -> DataFrame:
        """Add the salt to the rows of the large side, from a hash of ``by``.

        Rows without a key match nothing and are spread as well.
        """
        spread = F.xxhash64(*by)
        salts = F.when(F.col(self.key).isNull(), F.lit(HOT_SHARE)).otherwise(F.coalesce("_salts", F.lit(1)))
        return (
            rows.join(F.broadcast(self.hot), self.key, "left")
            .withColumn(SALT, F.pmod(spread, salts).cast("int"))
            .drop("_salts")
        )

    def copied(self, rows: DataFrame) -> DataFrame:
        """Copy the rows of the small side (few for each key) to every salt."""
        every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        return (
            rows.join(F.broadcast(self.hot), self.key, "left")
            .withColumn(SALT, F.explode(every))
            .drop("_salts")
        )


def spread_over(rows: DataFrame, key: str, hot_rows: int | None = None) -> Spread:
    """Find the hot values of ``key``; counts are combined before they are shuffled."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"))
    bound = F.greatest(F.lit(float(HOT_ROWS if hot_rows is None else hot_rows)), F.col("_total") / HOT_SHARE)
    hot = (
        counts.crossJoin(F.broadcast(total))  # one row
        .filter(F.col(key).isNotNull() & (F.col("_rows") > bound))
        .select(key, F.ceil(F.col("_rows") / bound).cast("int").alias("_salts"))
    )
    return Spread(hot, key)

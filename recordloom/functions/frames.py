"""Frame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are expensive to compute.

    A plain filter is pushed below the projection that computes its columns,
    which copies their expressions into the filter, once per reference.  The
    row mark is not deterministic, so a filter that also reads it stays above
    and every expression is evaluated once.
    """
    marked = df.select("*", F.monotonically_increasing_id().alias("_mark"))
    return marked.filter(condition & (F.col("_mark") >= 0)).drop("_mark")


def last_key_wins(df: DataFrame) -> DataFrame:
    """The same frame, with a session that keeps the last of repeated keys in a JSON object.

    By default parsing refuses such an object, where readers of the record format take
    its last value.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df

"""Best rows per key when a key may have very many candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def best_rows(
    df: DataFrame,
    key: str,
    order: list[Column],
    spread: str,
    bound: Column | int,
    salts: int = SALTS,
) -> DataFrame:
    """The first ``bound`` rows of every key, numbered in ``row``.

    Candidates of one key are first cut down inside ``salts`` slices (chosen by
    the hash of the column ``spread``), so a hot key is sorted by many tasks and
    only the survivors meet in one.  A literal bound also lets Spark drop rows
    before the first shuffle.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    first = Window.partitionBy(key, "_slice").orderBy(*order)
    survivors = sliced.withColumn("_row", F.row_number().over(first)).filter(
        F.col("_row") <= bound
    )
    final = Window.partitionBy(key).orderBy(*order)
    return (
        survivors.withColumn("row", F.row_number().over(final))
        .filter(F.col("row") <= bound)
        .drop("_slice", "_row")
    )

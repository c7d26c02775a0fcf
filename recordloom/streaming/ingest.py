"""Incremental corpus ingest: new record files become table rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.sources.corpora import parse_information, parse_memories, parse_threads

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "threads": parse_threads,
    "memories": parse_memories,
    "information": parse_information,
}


def text_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 10_000, separator: str | None = None
) -> DataFrame:
    """Record files of a folder as they arrive.

    One record to a file, or with ``separator`` any number of records in text files.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if separator is None:
        files = source.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    else:
        files = source.option("pathGlobFilter", "*.txt").option("lineSep", separator).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest_stream(
    spark: SparkSession,
    kind: str,
    path: str,
    target: str,
    checkpoint: str,
    files_per_trigger: int = 10_000,
    separator: str | None = None,
) -> StreamingQuery:
    """Parse arriving files with the batch parser.

    Every micro-batch writes its own folder below ``target`` and
    ``target``_rejects, so a replayed batch replaces itself.
    """
    parse = PARSERS[kind]

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = parse(batch).persist()
        good = parsed.filter(F.col("parse_error").isNull()).drop("parse_error")
        bad = parsed.filter(F.col("parse_error").isNotNull()).select("path", "parse_error")
        good.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{target}_rejects/epoch={epoch}")
        parsed.unpersist()

    return (
        text_stream(spark, path, files_per_trigger, separator)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

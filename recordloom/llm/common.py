"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.sizing import ensure_checkpoint_dir, stable

__all__ = ["attach", "connected", "fresh", "read", "stable", "text_batches", "work_folder"]

#: Texts in a batch for Python.
TEXT_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one row in HOT_SHARE is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder, named but not made, below the cluster's shared folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in docs.columns:
        name = "_" + name
    return name


def text_batches(docs: DataFrame) -> DataFrame:
    """The same frame, with a session that hands whole texts to Python in small batches.

    Spark counts rows, not bytes, in a batch; its default number suits narrow rows.  A
    number set by the user stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) == 10_000:
        conf.set(name, str(TEXT_ROWS))
    return docs


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def attach(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``left`` with the one row that ``right`` has for each key.

    ``counts`` has columns key and ``n``, the key's rows in ``left``; ``total`` is their
    sum.  A key with more than ``total / HOT_SHARE`` rows is split: there are fewer than
    ``HOT_SHARE`` of these, so their list is broadcast, rows of ``left`` are spread over
    salts by a hash of all their columns, and the row of ``right`` is copied to each
    salt.  No task then gets more than ``total / HOT_SHARE`` rows of a key whose rows
    differ.  Each side is read once, ``counts`` twice.
    """
    share = max(1.0, total / HOT_SHARE)
    hot = counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = left.join(hot, key, "left").withColumn("_salt", spread).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted.join(copied, [key, "_salt"]).drop("_salt")


def bits_of(values: np.ndarray) -> np.ndarray:
    """One row of 64 bits, lowest first, for each unsigned 64-bit number."""
    octets = np.ascontiguousarray(values, dtype="<u8").view("u1").reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little")


def batches(rows: dict[str, pa.Array | list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_pydict(rows, schema=schema).to_batches(max_chunksize=size)


#: Links of one node that a task takes in one piece.
HUB_LINKS = 1_000_000


def _relinked(edges: DataFrame, ends: DataFrame, key: str, total: int, hubs: bool) -> DataFrame:
    """Edges with the smallest node ``low`` that their ``key`` end is linked to, or itself."""
    lows = ends.groupBy(key).agg(F.least(F.col(key), F.min("end")).alias("low"))
    if not hubs:
        return edges.join(lows, key)
    return attach(edges, lows, key, stable(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n"))), total)


def connected(links: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, component).

    ``links`` has long columns ``a`` and ``b``; the component is the smallest node
    reachable.  Large-star and small-star steps alternate until nothing changes; each
    step writes at most twice as many rows as there are links.  Minima are combined
    before shuffling.  While a node has more than ``HUB_LINKS`` links, its rows are
    spread by :func:`attach`.
    """
    links = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, seen = stable(links.distinct()), None
    while True:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mark = (
            ends.groupBy("a")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
            .agg(F.sum("n"), F.bit_xor("x"), F.max("n"))
            .first()
        )
        if mark == seen or not mark[0]:
            break
        seen, total, hubs = mark, mark[0], mark[2] > HUB_LINKS
        both = ends.select(F.col("a").alias("b"), F.col("b").alias("end"))
        large = _relinked(edges, both, "b", total, hubs).select("a", F.col("low").alias("b")).filter("a <> b").distinct()
        large = stable(large) if hubs else large
        small = _relinked(large, large.select("a", F.col("b").alias("end")), "a", total, hubs)
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))
        edges = stable(small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b").distinct())
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("component").alias("node"), "component").distinct()
    return pairs.unionByName(roots)

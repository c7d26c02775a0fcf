"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import stable

#: Hash tables; axes of the second, shortened rotation; buckets probed in each table.
TABLES, SECOND, PROBES = 16, 8, 56
#: Signed axes of each rotation that are combined into probes.
AXES = (48, 16)
#: Rows of a bucket that meet a probe in one task; a larger bucket is split over salts.
BUCKET_ROWS = 4096
#: Distances computed at once, and rows of results held before they are cut to the best.
PAIRS, HELD = 1 << 18, 1 << 18
SEED = 90_210


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    x, size, half = x.copy(), x.shape[1], 1
    while half < size:
        view = x.reshape(len(x), size // (2 * half), 2, half)
        low, high = view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]
        view[:, :, 0], view[:, :, 1] = low, high
        half *= 2
    return x / np.sqrt(size)


def rotated(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    size = 1 << max(1, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng((SEED, table, part, size))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size=size))
    return x if part == 0 else x[:, :SECOND]


def nearest_axes(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row, nearest first, and their loss."""
    both = np.concatenate([x, -x], axis=1)
    order = np.argsort(-both, axis=1, kind="stable")[:, : min(count, both.shape[1])]
    value = np.take_along_axis(both, order, axis=1)
    return order, (value[:, :1] - value) ** 2


def bucket_codes(unit: np.ndarray, table: int) -> np.ndarray:
    first, _ = nearest_axes(rotated(unit, table, 0), 1)
    second, _ = nearest_axes(rotated(unit, table, 1), 1)
    return first[:, 0] * (2 * SECOND) + second[:, 0]


def probe_codes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The buckets whose pair of axes loses least, shape (rows, probes)."""
    first, lost = nearest_axes(rotated(unit, table, 0), AXES[0])
    second, more = nearest_axes(rotated(unit, table, 1), AXES[1])
    loss = (lost[:, :, None] + more[:, None, :]).reshape(len(unit), -1)
    codes = (first[:, :, None] * (2 * SECOND) + second[:, None, :]).reshape(len(unit), -1)
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(codes, order, axis=1)


def usable(vector: str) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a batch."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[offsets[at][:, None] + np.arange(size)[None, :]]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ROWS = "bucket long, query boolean, id long, vector array<double>"


def _hashing(probes: int | None, tables: int, counts: object = None):  # noqa: ANN202
    """A mapInArrow function from (id, vector) to rows for buckets.

    Without ``probes`` each row goes to its own bucket in every table; ``counts`` maps a
    bucket to its salts, to one of which an indexed row goes and to all a query does.
    """

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for at, x in _matrix(part.column(1)):
                unit, size = _unit(x), x.shape[1]
                for table in range(tables):
                    found = bucket_codes(unit, table)[:, None] if probes is None else probe_codes(unit, table, probes)
                    rows = np.repeat(np.arange(len(at)), found.shape[1])
                    code = ((size * tables + table) << 32) | found.ravel().astype(np.int64)
                    yield from _bucket_rows(code, rows, ids[at], x, probes is not None, counts)

    return apply


def _bucket_rows(code, rows, ids, x, query, counts) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    salts = None
    if counts is not None:
        salts = np.array([counts.value.get(c, 1) for c in code.tolist()], dtype=np.int64)
    if salts is not None and query:
        ends = np.cumsum(salts)
        salt = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - salts, salts)
        code, rows = np.repeat(code, salts), np.repeat(rows, salts)
    elif salts is not None:
        salt = (ids[rows] * 2_654_435_761 % (1 << 31)) % salts
    else:
        salt = 0
    code = code * 1024 + salt if salts is not None else code
    step = max(1, (1 << 20) // x.shape[1])
    for start in range(0, len(code), step):
        some = rows[start : start + step]
        offsets = np.arange(len(some) + 1, dtype=np.int32) * x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(code[start : start + step]),
                pa.array(np.full(len(some), query)),
                pa.array(ids[some]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[some].ravel())),
            ],
            ["bucket", "query", "id", "vector"],
        )


class _Best:
    """The ``k`` nearest rows found so far for each query."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0

    def add(self, query: np.ndarray, row: np.ndarray, distance: np.ndarray) -> None:
        self.parts.append((query, row, distance))
        self.size += len(query)
        if self.size > HELD:
            self.cut()

    def cut(self) -> None:
        if not self.parts:
            return
        query, row, distance = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.lexsort([row, distance, query])
        query, row, distance = query[order], row[order], distance[order]
        new = np.concatenate([[True], (query[1:] != query[:-1]) | (row[1:] != row[:-1])])
        query, row, distance = query[new], row[new], distance[new]
        begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        keep = rank < self.k
        self.parts = [(query[keep], row[keep], distance[keep])]
        self.size = int(keep.sum())


def _ranking(k: int):  # noqa: ANN202
    """A mapInArrow function over rows sorted by bucket, queries first, to the best pairs."""

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bucket = _Best(k), None
        queries: list[tuple[np.ndarray, np.ndarray]] = []
        for part in parts:
            codes = part.column(0).to_numpy()
            asks = part.column(1).to_numpy(zero_copy_only=False)
            ids = part.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (asks[1:] != asks[:-1])]))
            ends = np.append(starts[1:], len(codes))
            offsets = part.column(3).offsets.to_numpy()
            flat = part.column(3).values.to_numpy()
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                if codes[start] != bucket:
                    bucket, queries = codes[start], []
                x = flat[offsets[start] : offsets[end]].reshape(end - start, -1)
                if asks[start]:
                    queries.append((ids[start:end], x))
                    continue
                for names, ask in queries:
                    step = max(1, PAIRS // (x.size or 1))
                    for low in range(0, len(names), step):
                        some = ask[low : low + step]
                        distance = np.sqrt(((some[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
                        if distance.shape[1] > k:
                            at = np.argpartition(distance, k - 1, axis=1)[:, :k]
                            limit = np.take_along_axis(distance, at, axis=1).max(axis=1)
                            q, r = np.nonzero(distance <= limit[:, None])  # all rows that tie with the last
                        else:
                            q, r = np.indices(distance.shape).reshape(2, -1)
                        best.add(names[low : low + step][q], ids[start:end][r], distance[q, r])
        best.cut()
        for query, row, distance in best.parts:
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(row), pa.array(distance)], ["query_id", "first_id", "score"])

    return apply


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row.

    ``queries`` marks the rows that ask; candidates are all rows but the query's own.
    Vectors are hashed by the nearest signed axis of two fast pseudo-rotations in each
    table; the query's ``probes`` likeliest buckets of every table give the candidates,
    ranked by their exact Euclidean distance on the original vectors, ties to the
    smaller id.  A query that finds fewer than ``k`` rows asks all buckets of one table,
    which is exact.

    Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a
    result can show of them.  A bucket above ``BUCKET_ROWS`` is split over salts and its
    queries go to each.  A task keeps the ``k`` best of a query over all its buckets, so
    that tasks x queries x k rows meet for the last ranking.  Null, zero or non-finite
    vectors take no part, nor do null ids; vectors of different length never meet;
    rows with the same id are one vector each, of which the nearest counts.
    """
    vectors = rows.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), queries.alias("asks")
    ).filter(F.col("id").isNotNull())
    vectors = vectors.withColumn("vector", F.when(usable("vector"), F.col("vector").cast("array<double>")))
    vectors = vectors.filter(F.col("vector").isNotNull())
    vectors = vectors.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))  # -0.0 is 0.0
    same = Window.partitionBy("vector").orderBy("id")
    copies = stable(
        vectors.select("id", "vector").distinct().withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    )
    # the smallest id of equal vectors stands for them
    named = copies.groupBy("vector").agg(F.min("id").alias("first_id"), F.sort_array(F.collect_list("id")).alias("ids"))
    named = stable(named)
    distinct = named.select(F.struct("first_id", F.size("vector").alias("size")).alias("key"), "vector", "ids")
    distinct = distinct.select(F.col("key.first_id").alias("id"), "vector", "ids")
    asking = stable(
        vectors.filter("asks").select("id", "vector").distinct()
    )

    own = distinct.select("id", "vector").mapInArrow(_codes_only(tables), "bucket long")
    counted = own.groupBy("bucket").count().filter(F.col("count") > BUCKET_ROWS)
    # fewer buckets than tables x rows / BUCKET_ROWS, and than there are axes
    salts = {r[0]: min(1023, -(-r[1] // BUCKET_ROWS)) for r in counted.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(salts)

    def search(asked: DataFrame, held: DataFrame) -> DataFrame:
        met = asked.unionByName(held).repartition("bucket").sortWithinPartitions("bucket", F.desc("query"))
        found = met.mapInArrow(_ranking(k + 1), "query_id long, first_id long, score double")
        near = found.groupBy("query_id", "first_id").agg(F.min("score").alias("score"))
        shown = near.join(distinct.select(F.col("id").alias("first_id"), "ids"), "first_id")
        each = shown.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
        each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    index = distinct.select("id", "vector").mapInArrow(_hashing(None, tables, shared), ROWS)
    probing = asking.mapInArrow(_hashing(probes, tables, shared), ROWS)
    result = stable(search(probing, index))
    ample = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    short = stable(asking.join(ample, asking["id"] == ample["query_id"], "left_anti"))
    if short.isEmpty():
        return result.select("query_id", "rank", "vec_id", "score")
    first = distinct.select("id", "vector").mapInArrow(_hashing(None, 1, None), ROWS)
    spread = 64
    first = first.withColumn("bucket", F.col("bucket") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)))
    sizes = first.select("bucket").distinct()
    # every bucket of the one table: those of another vector length are left by its shape
    all_of = short.select("id", "vector", F.size("vector").cast("long").alias("size"))
    asked = all_of.join(
        sizes.select("bucket", F.shiftright((F.col("bucket") / spread).cast("long"), 32).alias("size")), "size"
    ).select("bucket", F.lit(True).alias("query"), "id", "vector")
    exact = search(asked, first)
    kept = result.join(short, result["query_id"] == short["id"], "left_anti")
    return kept.select("query_id", "rank", "vec_id", "score").unionByName(
        exact.select("query_id", "rank", "vec_id", "score")
    )


def _codes_only(tables: int):  # noqa: ANN202
    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, x in _matrix(part.column(1)):
                unit, size = _unit(x), x.shape[1]
                for table in range(tables):
                    code = ((size * tables + table) << 32) | bucket_codes(unit, table).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(code)], ["bucket"])

    return apply

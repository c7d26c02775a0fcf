"""Exact top-k by inner product, pruned by segment statistics at several resolutions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import stable

#: Components are multiplied by this and cut down to whole numbers.
SCALE = 256.0
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (1, 4, 16)
#: Bytes of vectors that a task holds as one slice, and of queries that meet it at once.
SLICE_BYTES, GROUP_BYTES = 1 << 23, 1 << 23
#: Queries and rows of a slice that are compared as one block.
QUERIES, ROWS = 64, 2048
#: Bytes of vectors that give each query its first bound, and rows at most.
SEED_BYTES, SEED_ROWS = 1 << 22, 4096
#: Bounds are raised by this share of both lengths, well above what rounding can take away.
SLACK = 1e-9
#: Below this, sums of products are exact in double precision.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def whole_numbers(vector: str, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null unless all are finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(scale))
    good = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # a floor of doubles that is a double: Spark's is a long
    floored = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0))
    return F.when(good, floored)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, both times the root of the segment's length.

    The inner product of two rows of statistics is no less than that of the vectors: in each segment the product is
    length * (mean * mean) plus that of the parts off the mean, at most length * (deviation * deviation).
    With both lengths this is the lower bound of the distance between the vectors, as squared
    distance = length² + length² - 2 * product.
    """
    bounds = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    sizes = np.diff(bounds)
    if not len(sizes):
        return np.zeros((len(x), 0))
    mean = np.add.reduceat(x, bounds[:-1], axis=1) / sizes
    off = x - np.repeat(mean, sizes, axis=1)
    deviation = np.sqrt(np.add.reduceat(off * off, bounds[:-1], axis=1) / sizes)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([sizes, sizes]))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles if they are exact, else Python's integers."""
    limit = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if limit < EXACT:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries).dot(whole(rows).T) if queries.size and rows.size else np.zeros((len(queries), len(rows)))


def bound_of(score: float | int) -> float:
    """A double that is no more than the score."""
    if isinstance(score, float):
        return score
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -math.inf


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(score, id) of the ``k`` highest scores, ties to smaller ids, each id once."""
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    else:
        order = np.lexsort([ids, -scores]).tolist()
    found: dict[int, tuple] = {}
    for i in order:
        found.setdefault(int(ids[i]), (scores[i] if scores.dtype == object else float(scores[i]), int(ids[i])))
        if len(found) == k:
            break
    return list(found.values())


class Slice:
    """Rows of one length with their statistics, and the search for the best of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...] = LEVELS) -> None:
        coarse = statistics(x, 1)
        # rows of like statistics lie together, so that a block of them is dropped as a whole
        order = np.lexsort([ids, *coarse.T])
        self.ids, self.x = ids[order], x[order]
        self.levels = [s for s in levels if s < x.shape[1]]
        self.length = np.linalg.norm(self.x, axis=1)
        starts = range(0, len(self.x), ROWS)
        self.features = [[statistics(self.x[a : a + ROWS], s) for s in self.levels] for a in starts]
        # pairs that were left before each level and before the exact products
        self.left = np.zeros(len(self.levels) + 1, dtype=np.int64)

    def best(self, names: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple]]]:
        """(query number, its ``k`` best of :func:`first_of`); its own id and scores below ``least`` left out.

        A block of queries meets a block of rows.  At each resolution, coarse to fine, a pair whose bound is below
        the query's k-th best score so far drops out, and a row that no query of the block still needs is left
        behind.  What survives is multiplied exactly.
        """
        order = np.lexsort([names, *statistics(queries, 1).T])
        for low in range(0, len(order), QUERIES):
            some = order[low : low + QUERIES]
            asked, bound = queries[some], least[some].copy()
            own = [statistics(asked, s) for s in self.levels]
            slack = SLACK * np.linalg.norm(asked, axis=1)
            held: list[list[tuple]] = [[] for _ in some]
            for block, start in enumerate(range(0, len(self.x), ROWS)):
                at = np.arange(start, min(start + ROWS, len(self.x)))
                alive = names[some][:, None] != self.ids[at][None, :]
                for level, features in enumerate(self.features[block]):
                    self.left[level] += int(alive.sum())
                    upper = own[level] @ features[at - start].T + slack[:, None] * self.length[at][None, :]
                    alive &= ~(upper < bound[:, None])  # sums that overflow drop nothing
                    needed = alive.any(axis=0)
                    at, alive = at[needed], alive[:, needed]
                self.left[-1] += int(alive.sum())
                if not len(at):
                    continue
                exact = products(asked, self.x[at])
                alive &= exact >= bound[:, None]
                for q in np.flatnonzero(alive.any(axis=1)).tolist():
                    rows = np.flatnonzero(alive[q])
                    older = held[q]
                    scores = np.concatenate([np.array([s for s, _ in older], dtype=exact.dtype), exact[q][rows]])
                    ids = np.concatenate([np.array([i for _, i in older], dtype=np.int64), self.ids[at[rows]]])
                    held[q] = first_of(scores, ids, k)
                    if len(held[q]) == k:
                        bound[q] = max(bound[q], bound_of(held[q][-1][0]))
            yield from zip(some.tolist(), held, strict=True)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b].copy() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _seeding(k: int, seeds):  # noqa: ANN001, ANN202
    """A mapInArrow function that adds the k-th best score over the seeds to (id, vector)."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("least", pa.float64())])

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, vectors, least = part.column(0), _vectors(part.column(1)), []
            for name, vector in zip(ids.to_pylist(), vectors, strict=True):
                known, x = seeds.value.get(len(vector), (np.zeros(0, dtype=np.int64), np.zeros((0, len(vector)))))
                other = known != name
                best = first_of(products(vector[None, :], x[other])[0], known[other], k)
                least.append(bound_of(best[-1][0]) if len(best) == k else -math.inf)
            yield pa.RecordBatch.from_arrays([ids, part.column(1).cast(schema.field("vector").type), pa.array(least)], schema=schema)

    return apply


def _searching(k: int):  # noqa: ANN202
    """A mapInArrow function over rows sorted by cell, a cell's rows before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answers(rows: list[tuple], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows or not asked:
            return
        ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
        names, queries, least = np.array([r[0] for r in asked]), np.stack([r[1] for r in asked]), np.array([r[2] for r in asked])
        with np.errstate(all="ignore"):
            out = [
                (int(names[q]), i, max(-LONG - 1, min(LONG, int(score))))
                for q, best in Slice(ids, x).best(names, queries, least, k)
                for score, i in best
            ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, asked = None, [], []
        for part in parts:
            cells, ids, least = (part.column(i).to_pylist() for i in (0, 1, 2))
            for c, i, bound, vector in zip(cells, ids, least, _vectors(part.column(3)), strict=True):
                if c != cell:
                    yield from answers(rows, asked)
                    cell, rows, asked = c, [], []
                if bound is None:
                    rows.append((i, vector))
                else:
                    asked.append((i, vector, bound))
        yield from answers(rows, asked)

    return apply


def top_products(
    rows: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for each query row, exactly.

    ``queries`` marks the rows that ask; candidates are all rows but the query's own.  Vectors are
    multiplied by ``scale`` and cut down to whole numbers; scores are products of those, ties go
    to the smaller id.

    Rows are dealt to slices and queries to groups, both of bounded bytes; a cell is one of each.  Inside a cell :class:`Slice`
    drops pairs by the bounds of :func:`statistics`.  Each query starts with a bound of its own, its k-th best
    score over at most ``SEED_ROWS`` rows of smallest hash; these only save work.  How much is saved is up to the vectors: those
    whose segments hardly differ in mean and deviation are nearly all multiplied.  What leaves the cells is
    slices x queries x k rows.

    Of equal vectors the ``k + 1`` smallest ids take part, which is all that a result can show of them.  Null vectors and those
    with null or non-finite components (also after scaling) take no part, nor do null ids; vectors of different length never
    meet; of rows with the same id the best counts; empty vectors score 0; a score beyond 64 bits becomes the last
    number on its side.  An empty table gives no rows; other columns aren't read.
    """
    vectors = rows.select(
        F.col(id_column).cast("long").alias("id"), whole_numbers(vector_column, scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    vectors = stable(vectors.groupBy("id", "vector").agg(F.max("asks").alias("asks")))
    same = Window.partitionBy("vector").orderBy("id")
    held = vectors.select("id", "vector", F.row_number().over(same).alias("place")).filter(F.col("place") <= k + 1).drop("place")
    held = stable(held)
    octets = F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))
    count, size = held.agg(F.count(F.lit(1)), octets).first()
    asked_size = vectors.filter("asks").agg(octets).first()[0]
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, math.ceil(size / SLICE_BYTES), min(parallel, math.ceil(count / ROWS)))
    groups = max(1, math.ceil(asked_size / GROUP_BYTES))

    widest = held.agg(F.max(F.size("vector"))).first()[0] or 1
    few = held.orderBy(F.xxhash64("id")).limit(max(1, min(SEED_ROWS, SEED_BYTES // (8 * max(1, widest))))).collect()
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(r["vector"]) for r in few}:
        some = [r for r in few if len(r["vector"]) == length]
        seeds[length] = np.array([r["id"] for r in some]), np.array([r["vector"] for r in some], dtype=float).reshape(len(some), length)
    shared = rows.sparkSession.sparkContext.broadcast(seeds)

    asking = vectors.filter("asks").select("id", "vector").mapInArrow(_seeding(k, shared), "id long, vector array<double>, least double")

    def cell(slice_number: Column, group: Column) -> Column:
        return ((F.size("vector").cast("long") * slices + slice_number) * groups + group).alias("cell")

    def part(salt: int, count: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    members = held.withColumn("group", every(groups)).select(
        cell(part(1, slices), F.col("group")), "id", F.lit(None).cast("double").alias("least"), "vector"
    )
    asks = asking.withColumn("slice", every(slices)).select(cell(F.col("slice"), part(2, groups)), "id", "least", "vector")
    met = members.unionByName(asks).repartition("cell").sortWithinPartitions("cell", F.col("least").isNotNull())
    found = met.mapInArrow(_searching(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""SimHash near duplicates by the general pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import WORD, attach, bits_of, connected, fresh, stable, text_batches

BITS = 64
PARTS, WIDTH = 4, 16
#: Rows of one bucket that a task compares with a probe; a larger bucket is split.
BUCKET_ROWS = 4096
#: Shingles whose votes are counted at a time.
VOTES = 65_536
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
PER_BATCH = 512


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a whole text, repeats included."""
    found = re.findall(WORD, (text or "").translate(LOWER))
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, last, VOTES):
        stop = min(last, start + VOTES)
        shingles = map(" ".join, zip(*(found[start + k : stop + k] for k in range(words)), strict=False))
        if len(found) < words:
            shingles = [" ".join(found)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
        votes += bits_of(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; the 64 bits are kept in a signed long."""
    rows = text_batches(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = np.array([fingerprint(t.as_py()) for t in part.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fingerprint"])

    return rows.mapInArrow(apply, "doc_id long, fingerprint long")


def correlated_parts(marks: DataFrame) -> list[list[int]]:
    """Deal the 64 bits to ``PARTS`` parts of ``WIDTH`` bits, correlated ones together.

    The joint counts of all pairs of bits are sums over all fingerprints; only the
    64 x 64 totals reach the driver.  Each part starts with the strongest pair left and
    takes the bit with the largest summed correlation to its members until it is full.
    """

    def joint(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for part in parts:
            bits = np.ones((part.num_rows, BITS + 1), dtype=np.float32)
            bits[:, :BITS] = bits_of(part.column(0).to_numpy(zero_copy_only=False))
            total += bits.T @ bits
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "n"])

    sums = marks.select("fingerprint").mapInArrow(joint, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros((BITS + 1) ** 2)
    for cell, n in sums.collect():  # at most 65 x 65 rows
        total[cell] = n
    total = total.reshape(BITS + 1, BITS + 1)
    rows = max(total[BITS, BITS], 1.0)
    mean = total[BITS, :BITS] / rows
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs(total[:BITS, :BITS] / rows - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0.0)
    left, dealt = list(range(BITS)), []
    for _ in range(PARTS):
        inside = like[np.ix_(left, left)]
        first = int(np.argmax(inside)) // len(left) if len(left) > WIDTH else 0
        part = [left.pop(first)]
        while len(part) < WIDTH:
            part.append(left.pop(int(np.argmax(like[np.ix_(part, left)].sum(axis=0)))))
        dealt.append(sorted(part))
    return dealt


def part_values(marks: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The value of every part of every fingerprint, shape (rows, parts)."""
    bits = bits_of(marks).astype(np.int64)
    return np.stack([bits[:, p] @ (1 << np.arange(len(p))) for p in parts], axis=1)


def ball_sums(counts: np.ndarray, radius: int) -> np.ndarray:
    """For every value the rows within each distance -1, 0 .. radius of it."""
    width = int(np.log2(counts.size))
    values = np.arange(counts.size)
    shells = [counts.astype(float)]
    for r in range(1, radius + 1):
        near = sum(shells[-1][values ^ (1 << i)] for i in range(width))
        if r > 1:
            near = near - (width - r + 2) * shells[-2]
        shells.append(near / r)
    return np.concatenate([np.zeros((1, counts.size)), np.cumsum(shells, axis=0)])


def allocate(cost: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds per part with sum ``budget`` and the least summed cost, for each row.

    ``cost`` has shape (parts, thresholds from -1 on, rows).  Dynamic programming over
    the parts and the sum spent so far, each threshold counted from 0.
    """
    parts, levels, rows = cost.shape
    goal = budget + parts
    best = np.full((parts + 1, goal + 1, rows), np.inf)
    best[0, 0] = 0.0
    choice = np.zeros((parts, goal + 1, rows), dtype=np.int8)
    for p in range(parts):
        for spent in range(goal + 1):
            for level in range(min(levels - 1, spent) + 1):
                value = best[p, spent - level] + cost[p, level]
                better = value < best[p + 1, spent]
                best[p + 1, spent][better] = value[better]
                choice[p, spent][better] = level
    out, left, at = np.zeros((rows, parts), dtype=np.int8), np.full(rows, goal), np.arange(rows)
    for p in reversed(range(parts)):
        out[:, p] = choice[p, left, at] - 1
        left = left - choice[p, left, at]
    return out


def flips(radius: int, width: int = WIDTH) -> list[np.ndarray]:
    """Masks that change 0, 1 .. radius bits, by that number."""
    values = np.arange(1 << width)
    ones = np.bitwise_count(values)
    return [values[ones == r] for r in range(radius + 1)]


def links(marks: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (x, y) of different fingerprints that differ in ``distance`` bits or fewer.

    ``marks`` holds each fingerprint once.  If thresholds of a fingerprint's parts sum to
    ``distance - PARTS + 1``, any fingerprint near enough is within the threshold in some
    part; -1 leaves a part out.  Each fingerprint's thresholds are those with the fewest
    expected candidates and probes, by exact counts of all part values (a table of fixed
    size, ``PARTS`` x 2^``WIDTH``).  Buckets above ``BUCKET_ROWS`` are split over salts,
    and candidates are verified on all bits.  Only the smaller of two is probed for.
    """
    spark = marks.sparkSession
    parts = correlated_parts(marks)
    counted = {"schema": "part int, value int, n long"}

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 1 << WIDTH), dtype=np.int64)
        for row in rows:
            values = part_values(row.column(0).to_numpy(zero_copy_only=False), parts)
            for p in range(PARTS):
                total[p] += np.bincount(values[:, p], minlength=1 << WIDTH)
        part, value = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype("i4")), pa.array(value.astype("i4")), pa.array(total[part, value])],
            ["part", "value", "n"],
        )

    tallied = marks.select("fingerprint").mapInArrow(tally, counted["schema"])
    counts = np.zeros((PARTS, 1 << WIDTH), dtype=np.int64)
    table = tallied.groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    counts[table["part"].to_numpy(), table["value"].to_numpy()] = table["n"].to_numpy()
    salts = np.maximum(1, -(-counts // BUCKET_ROWS))
    budget = distance - PARTS + 1
    masks = flips(max(0, budget + PARTS - 1))
    costs = np.stack([ball_sums(c, len(masks) - 1) for c in counts])
    probes = np.concatenate([[0], np.cumsum([len(m) for m in masks])])
    shared = spark.sparkContext.broadcast(((costs + probes[None, :, None]).astype(np.float32), salts))

    def columns(key: list[np.ndarray]) -> pa.RecordBatch:
        part, value, salt, mark = (np.concatenate(k) for k in zip(*key, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array((part << WIDTH | value).astype("i4")), pa.array(salt.astype("i4")), pa.array(mark.astype("u8").view("i8"))],
            ["bucket", "salt", "mark"],
        )

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for row in rows:
            marks = np.ascontiguousarray(row.column(0).to_numpy(zero_copy_only=False)).view("u8")
            for start in range(0, len(marks), PER_BATCH):
                yield marks[start : start + PER_BATCH]

    def index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, salts = shared.value
        for some in pieces(rows):
            values = part_values(some, parts)
            yield columns(
                [
                    (np.full(len(some), p), values[:, p], (some % salts[p, values[:, p]].astype("u8")).astype("i8"), some)
                    for p in range(PARTS)
                ]
            )

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, salts = shared.value
        for some in pieces(rows):
            values = part_values(some, parts)
            chosen = allocate(np.stack([cost[p][:, values[:, p]] for p in range(PARTS)]), budget)
            out = []
            for p in range(PARTS):
                for r, mask in enumerate(masks):
                    near = chosen[:, p] >= r
                    at = (values[near, p][:, None] ^ mask[None, :]).ravel()
                    mark = np.repeat(some[near], len(mask))
                    held = counts_of(salts[p], at)
                    at, mark, held = at[held > 0], mark[held > 0], held[held > 0]
                    ends = np.cumsum(held)
                    salt = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - held, held)
                    out.append((np.full(len(salt), p), np.repeat(at, held), salt, np.repeat(mark, held)))
            yield columns(out)

    def counts_of(salts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return salts[at]

    schema = "bucket int, salt int, mark long"
    held = marks.select("fingerprint").mapInArrow(index, schema).withColumnRenamed("mark", "y")
    asked = marks.select("fingerprint").mapInArrow(probe, schema).withColumnRenamed("mark", "x")
    pairs = asked.join(held, ["bucket", "salt"]).filter(
        (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    )
    return pairs.select("x", "y").distinct()


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = 3) -> DataFrame:
    """For every row: id, ``fingerprint`` (a signed long) and ``component_id``.

    Texts are lower-cased (A-Z), cut into words and 3-word shingles; a text with fewer
    words is one shingle, one without words has fingerprint zero and links like any
    other; null counts as empty.  Documents link when their fingerprints differ in
    ``distance`` bits or fewer, copies in none; the component is the smallest id that
    can be reached.  Copies meet as one fingerprint, so a group of any size costs one
    node.  Repeated ids belong to every group of their texts, rows with a null id get
    the group's smallest id (null if there is none); extra columns are not read.
    """
    rows = stable(fingerprints(docs, id_column, text_column))
    marks = stable(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    near = stable(links(marks, distance))
    linked = marks.join(
        stable(connected(near.select(F.col("x").alias("a"), F.col("y").alias("b")))).withColumnRenamed("node", "fingerprint"),
        "fingerprint",
        "left",
    ).withColumn("component", F.coalesce("component", "fingerprint"))
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "component").select("fingerprint", "component_id")
    found = attach(rows, named, "fingerprint", marks, rows.count())
    return found.select(F.col("doc_id").alias(id_column), "fingerprint", "component_id")


def near_deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row of each group that bears the group's smallest id, with all its columns.

    Rows of a group that repeat that id are one document and stay as they are; rows with
    a null id can't be told apart and stay too.  An id that stands on rows of several
    groups stays on those of the group that it names; only then are fingerprints asked
    for again, to tell its rows apart.
    """
    groups = stable(near_groups(docs, id_column, text_column).withColumn("away", F.col("component_id") != F.col(id_column)))
    gone = groups.filter("away").select(F.col(id_column).alias("_gone_id"), F.col("fingerprint").alias("_gone_mark")).distinct()
    torn = groups.groupBy(id_column).agg(F.min("away").alias("all"), F.max("away").alias("some")).filter("some and not all")
    if torn.isEmpty():
        return docs.join(gone.select("_gone_id").distinct(), docs[id_column] == F.col("_gone_id"), "left_anti")
    mark = fresh(docs, "_mark")

    @F.pandas_udf("long")
    def marked(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    rows = text_batches(docs).withColumn(mark, marked(F.coalesce(F.col(text_column), F.lit(""))))
    same = (F.col(id_column).cast("long") == F.col("_gone_id")) & (F.col(mark) == F.col("_gone_mark"))
    return rows.join(gone, same, "left_anti").drop(mark)

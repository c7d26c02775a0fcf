"""An inverted index over memories and a top-k search that stops early.

Records are numbered in file order, and for each word and block of consecutive records the
index lists those that hold it.  A term of a query matches every word that contains it, so its
postings are those of all such words.

The weight of a term is how often the query names it, and a record scores the weights of
its terms.  The weights of the terms that a block holds are thus the block's best score, and a
batch is answered in three steps:

1. The postings of the batch's terms, and no others, are opened and joined to one list for each term
   and block.
2. Each query is counted in the blocks of its highest best scores.  The ``limit``-th best record
   found there, its score and number, is the query's threshold.
3. Of the other blocks those are counted whose best score reaches the threshold.  Inside a block,
   too, counting ends when the terms that are left can't lift any record to it.

Ties go to the earlier record, also in the bounds, so results are those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions.ranking import best_rows
from recordloom.functions.sizing import fits, spread, stable
from recordloom.operators.memories import ID

#: Records of a block, as a power of two.
BLOCK_BITS = 10
#: Folders of postings that words are dealt to.
BUCKETS = 256
#: Blocks that give a query its threshold.
FIRST_BLOCKS = 2
#: Queries that meet a block in one task.
QUERY_GROUP = 4096
GRAM = 3
#: Lists of postings in a batch.
OUT_ROWS = 10_000
#: Places that are opened at a time, or those of one word more.
OPEN_PLACES = 1 << 20


def bucket_of(run: str) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TermIndex:
    """records (doc, id), vocabulary (run), postings (bucket, run, block, places).

    A doc is its block, shifted by ``BLOCK_BITS``, and its place there.
    """

    records: DataFrame
    vocabulary: DataFrame
    postings: DataFrame

    def write(self, path: str) -> None:
        """Postings lie in a folder for each bucket, sorted by word, so a search opens few of them."""
        self.records.write.mode("overwrite").parquet(f"{path}/records")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        rows = self.postings.repartition("bucket", F.shiftright("block", 12)).sortWithinPartitions("bucket", "run", "block")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")

    @staticmethod
    def read(spark: SparkSession, path: str) -> TermIndex:
        return TermIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("records", "vocabulary", "postings")])

    def opened(self, runs: DataFrame) -> DataFrame:
        """Postings of the buckets that hold any of ``runs`` (run)."""
        # no more numbers than there are buckets
        buckets = [r[0] for r in runs.select(bucket_of("run").alias("bucket")).distinct().collect()]
        return self.postings.filter(F.col("bucket").isin(buckets))


def _by_block(
    grouped: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply ``grouped`` to the rows of each block, from rows sorted by block, their first column."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for whole in grouped(block, parts) if parts else ():
                for low in range(0, whole.num_rows, rows):
                    yield whole.slice(low, rows)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            lows = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()] if len(blocks) else []
            for low, high in zip(lows, [*lows[1:], len(blocks)], strict=False):
                if blocks[low] != block:
                    yield from done()
                    block, parts = int(blocks[low]), []
                parts.append(batch.slice(low, high - low))
        yield from done()

    return apply


def _posting(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(run, block, places) from rows (block, place, runs) sorted by block, in batches of ``rows``."""

    def posted(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = pa.concat_arrays([p.column(2).cast(pa.list_(pa.string())) for p in parts])
        places = pa.concat_arrays([p.column(1) for p in parts]).to_numpy()
        coded = runs.flatten().dictionary_encode()
        bits = places.max().item().bit_length()
        # the word, then the place; a record of several rows may hold a word in each
        pairs = coded.indices.to_numpy().astype(np.int64) << bits | places[pc.list_parent_indices(runs).to_numpy()]
        pairs = np.unique(pairs)
        ends = np.searchsorted(pairs, np.arange(1, len(coded.dictionary) + 1, dtype=np.int64) << bits)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
        blocks = pa.array(np.full(len(lists), block, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([coded.dictionary, blocks, lists], ["run", "block", "places"])

    return _by_block(posted, rows)


def _listing(rows: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term_id, block, places) from rows (block, term_ids, places) sorted by block, in batches of ``rows``."""

    def listed(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.concat_arrays([p.column(1) for p in parts])
        places = pa.concat_arrays([p.column(2) for p in parts])
        flat, sizes = places.flatten().to_numpy(), pc.list_value_length(places).to_numpy()
        lows = np.cumsum(sizes) - sizes
        ids, holder = terms.flatten().to_numpy(), pc.list_parent_indices(terms).to_numpy()
        order = np.argsort(ids, kind="stable")
        names, number = np.unique(ids[order], return_inverse=True)
        holder = holder[order]
        # as many terms at a time as there are lists in a batch
        for first in range(0, len(names), rows):
            a, b = np.searchsorted(number, [first, first + rows])
            held = np.zeros((min(rows, len(names) - first), 1 << bits), dtype=bool)
            spans, row = sizes[holder[a:b]], number[a:b] - first
            slabs = np.flatnonzero(np.diff(np.cumsum(spans) // OPEN_PLACES, prepend=-1)).tolist()
            for low, high in zip(slabs, [*slabs[1:], b - a], strict=True):
                some = spans[low:high]
                starts = np.repeat(lows[holder[a + low : a + high]] - np.cumsum(some) + some, some)
                held[np.repeat(row[low:high], some), flat[starts + np.arange(len(starts))]] = True
            offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(held)[1].astype(np.int32)))
            blocks = pa.array(np.full(len(held), block, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names[first : first + rows]), blocks, lists], ["term_id", "block", "places"])

    return _by_block(listed, rows)


def build_index(memories: DataFrame, haystack: Column, word: str) -> TermIndex:
    """Index memories by the distinct runs of ``word`` in ``haystack``.

    Numbers grow with the file name.  A list of postings is no longer than a block, so a word
    of all records is many rows.  Rows that share an id are one record; those without one are left out.
    What is shuffled is a record's words together; they are taken apart where their block is whole.
    """
    named = memories.select(ID).filter(F.col(ID).isNotNull()).distinct().orderBy(X.file_order(F.col(ID)))
    records = stable(named.select(F.monotonically_increasing_id().alias("doc"), ID))
    runs = F.regexp_extract_all(haystack, F.lit(f"({word})"), F.lit(1))
    words = spread(memories).select(ID, F.array_distinct(runs).alias("runs"))
    held = words.join(records, ID).select(
        F.shiftright("doc", BLOCK_BITS).alias("block"),
        F.col("doc").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("place"),
        "runs",
    )
    met = held.repartition("block").sortWithinPartitions("block")
    postings = met.mapInArrow(_posting(OUT_ROWS), "run string, block long, places array<int>")
    postings = stable(postings.select(bucket_of("run").alias("bucket"), "run", "block", "places"))
    return TermIndex(records, stable(postings.select("run").distinct()), postings)


def runs_with_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(run, term_id) for every distinct run that contains the term."""
    sized = terms.withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    # at most GRAM numbers
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect() if r[0])
    keyed = sized.select("term", "term_id", F.substring("term", F.lit(1), F.col("size")).alias("gram"))

    def grams(size: int) -> Column:
        last = F.length("run") - size + 1
        return F.when(
            last >= 1,
            F.transform(
                F.sequence(F.lit(1), last), lambda i: F.substring("run", i, F.lit(size))
            ),
        ).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.concat(*[grams(n) for n in sizes or [GRAM]]))
    return (
        vocabulary.select("run", F.explode(pieces).alias("gram"))
        .join(F.broadcast(keyed) if fits(keyed) else keyed, "gram")
        .filter(F.contains("run", F.col("term")))
        .select("run", "term_id")
    )


def _counting(limit: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best records of each query in each block, from rows sorted by block, lists before queries."""

    def best(places: dict[int, np.ndarray], terms: list[int], weights: list[int], least: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        # the rarest term first: the others are the fewer to open
        held = sorted((len(places[t]), t, w) for t, w in zip(terms, weights, strict=True) if t in places)
        left = sum(w for *_, w in held)
        counts = np.zeros(1 << bits, dtype=np.int64)
        for _, term, weight in held:
            if counts.max() + left < least:
                return counts[:0], counts[:0]
            counts[places[term]] += weight
            left -= weight
        found = np.flatnonzero(counts > 0)
        found = found[(counts[found] > least) | ((counts[found] == least) & (found <= last))]
        if len(found) > limit:
            found = found[np.lexsort([found, -counts[found]])[:limit]]
        return found, counts[found]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places = None, {}
        for batch in batches:
            groups, blocks, names, weights, least, last = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: list[tuple] = []
            for row, key in enumerate(zip(groups, blocks, strict=True)):
                if key != block:
                    block, places = key, {}
                some = flat[offsets[row] : offsets[row + 1]]
                if weights[row] is None:
                    places[names[row]] = some.copy()
                    continue
                found, counts = best(places, some.tolist(), weights[row], least[row], last[row])
                first = key[1] << bits
                out.extend((names[row], first + p, c) for p, c in zip(found.tolist(), counts.tolist(), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "doc", "matches"])

    return count


def _counted(lists: DataFrame, pairs: DataFrame, groups: int, limit: int) -> DataFrame:
    """(query, doc, matches): the best of each pair of a query and a block.

    ``lists`` are (term_id, block, places), ``pairs`` are (query, block, terms, weights, least, last_doc).  A record
    counts that beats ``least`` or equals it and isn't after ``last_doc``.
    """
    group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("group")
    last = F.coalesce(F.col("last_doc") - F.shiftleft("block", BLOCK_BITS), F.lit(1 << BLOCK_BITS))
    asked = pairs.select(
        group, "block", F.col("query").alias("name"), F.col("terms").alias("ids"), "weights", F.coalesce("least", F.lit(0)).alias("least"), last.alias("last")
    )
    cells = asked.select("group", "block").distinct()
    none = F.lit(None)
    held = lists.join(cells, "block").select(
        "group",
        "block",
        F.col("term_id").alias("name"),
        F.col("places").cast("array<long>").alias("ids"),
        none.cast("array<long>").alias("weights"),
        none.cast("long").alias("least"),
        none.cast("long").alias("last"),
    )
    met = held.unionByName(asked).repartition("group", "block")
    met = met.sortWithinPartitions("group", "block", F.col("weights").isNotNull())
    return met.mapInArrow(_counting(limit, BLOCK_BITS), "query long, doc long, matches long")


def search_index(index: TermIndex, weights: DataFrame, limit: int) -> DataFrame:
    """(query, doc, matches, row): the ``limit`` best records of each query, from (query, term, weight).

    Queries are numbers.  What is sorted for a query is no more than ``limit`` records of each block that
    is counted for it.
    """
    terms = stable(weights.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    matched = stable(runs_with_terms(index.vocabulary, terms))
    # the terms of a run stay together until its block is whole
    wanted = matched.groupBy("run").agg(F.collect_set("term_id").alias("term_ids"))
    met = index.opened(matched).join(F.broadcast(wanted) if fits(wanted) else wanted, "run")
    met = met.select("block", "term_ids", "places").repartition("block").sortWithinPartitions("block")
    lists = stable(met.mapInArrow(_listing(OUT_ROWS, BLOCK_BITS), "term_id long, block long, places array<int>"))
    numbered = stable(weights.join(terms, "term").select("query", "term_id", "weight"))
    listed = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    asked = numbered.groupBy("query").agg(listed.alias("t")).select(
        "query", F.col("t.term_id").alias("terms"), F.col("t.weight").alias("weights")
    )
    asked = stable(asked)
    groups = max(1, math.ceil(asked.count() / QUERY_GROUP))
    # the best score that each block can give to each query
    bounds = stable(
        numbered.join(lists.select("term_id", "block"), "term_id").groupBy("query", "block").agg(F.sum("weight").alias("most"))
    )
    first = best_rows(bounds, "query", [F.desc("most"), F.col("block")], spread="block", bound=FIRST_BLOCKS)
    first = stable(first.select("query", "block"))
    none = F.lit(None).cast("long")
    pairs = first.join(asked, "query").select("*", none.alias("least"), none.alias("last_doc"))
    begun = stable(_counted(lists, pairs, groups, limit))
    order = [F.col("matches").desc(), F.col("doc")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    last = begun.withColumn("row", place).filter(F.col("row") == limit)
    last = last.select("query", F.col("matches").alias("least"), F.col("doc").alias("last_doc"))

    tie = (F.col("most") == F.col("least")) & (F.shiftleft("block", BLOCK_BITS) <= F.col("last_doc"))
    reaches = F.col("least").isNull() | (F.col("most") > F.col("least")) | tie
    others = bounds.join(first, ["query", "block"], "left_anti").join(last, "query", "left").filter(reaches)
    rest = _counted(lists, others.drop("most").join(asked, "query"), groups, limit)
    return best_rows(begun.unionByName(rest), "query", order, spread="doc", bound=limit)

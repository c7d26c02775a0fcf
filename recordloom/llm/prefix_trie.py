"""The trie of conversation prefixes, from whole sequences that are collapsed first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import WORD, attach, stable

#: A conversation begins with turns of the first one of its FAMILY, fewer than HEADS of them.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that one task adds up.
CHUNK = 1 << 16
#: Ids that are joined to one text before they are digested.
LISTED = 1 << 12
NODE = ("depth", "a", "b")


def turns(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, place, digest, words): the turns of each conversation, numbered from 0 in order.

    Order is that of ``turn``, nulls first; turns that share a number are ordered by the digest of
    role and text.  Rows are dealt out by ranges of the whole order, so that a conversation
    with very many turns lies in several tasks; only how many of its turns come before a
    task, one number for each task, is handed on.
    """
    role, text = F.coalesce(role_column, F.lit("")), F.coalesce(text_column, F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    read = stable(
        rows.filter(F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("long").alias("conv_id"),
            F.col(turn_column).alias("turn"),
            F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        )
    )
    order = ["turn", "digest", "tie"]
    dealt = read.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order)
    dealt = stable(dealt.withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each task that goes on with a conversation of an earlier one
    earlier = counts.select("conv_id", "part", F.sum("n").over(before).alias("earlier")).filter("earlier is not null")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    return dealt.withColumn("row", F.row_number().over(inside)).join(F.broadcast(earlier), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("row") - 1 + F.coalesce("earlier", F.lit(0))).alias("place"), "digest", "words"
    )


def rebuilt(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns after the first ones were taken from another.

    Of conversation c the first h turns, h being its checksum modulo ``heads``, are replaced by
    those of conversation c - c % ``family``, as far as that has any.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    counts = stable(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    convs = counts.select("conv_id", first.alias("base"), head.alias("head"))
    sources = own.filter((F.col("conv_id") == first) & (F.col("place") < heads - 1))
    taken = convs.filter("head > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(0), F.col("head").cast("int") - 1)).alias("place"))
    sources = sources.select(F.col("conv_id").alias("base"), F.col("place").cast("int").alias("place"), "digest", "words")
    borrowed = taken.join(sources, ["base", "place"]).select("conv_id", F.col("place").cast("long").alias("place"), "digest", "words")
    kept = own.filter(F.col("place") >= head).withColumn("base", first)
    by_base = counts.groupBy(first.alias("base")).agg(F.sum("n").alias("n"))
    lengths = by_base.select("base").join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("has")), "base", "left")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = attach(kept, lengths.select("base", F.coalesce("has", F.lit(0)).alias("has")), "base", by_base, total)
    moved = F.col("place") - head + F.least(head, F.col("has"))
    return counts.select("conv_id"), kept.select("conv_id", moved.alias("place"), "digest", "words").unionByName(borrowed)


def _lanes() -> list[Column]:
    """Two numbers for a turn at its place: a prefix is named by the exclusive or of all of its."""
    return [F.xxhash64(F.lit(lane), "place", "digest").alias(name) for name, lane in (("a", 11), ("b", 23))]


def running(rows: DataFrame, key: str, place: str, columns: list[str], split: bool, back: bool = False) -> DataFrame:
    """Columns replaced by their exclusive or up to each place or, ``back``, by their sum from it on.

    Keys are cut into chunks of ``CHUNK`` places.  If any has several (``split``), one total of
    each chunk is carried over to the next ones.
    """
    add = F.sum if back else F.bit_xor
    rows = rows.withColumn("chunk", F.floor(F.col(place) / CHUNK))
    order = F.col(place).desc() if back else F.col(place)
    inside = Window.partitionBy(key, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    others = [c for c in rows.columns if c not in columns]
    found = rows.select(*others, *[add(c).over(inside).alias(c) for c in columns])
    if not split:
        return found.drop("chunk")
    totals = rows.groupBy(key, "chunk").agg(*[add(c).alias(f"{c}_before") for c in columns])
    earlier = Window.partitionBy(key).orderBy(F.col("chunk").desc() if back else F.col("chunk"))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "chunk", *[add(f"{c}_before").over(earlier).alias(f"{c}_before") for c in columns])
    zero = F.lit(0).cast("long")
    joined = found.join(carried, [key, "chunk"], "left")
    for c in columns:
        more = F.coalesce(f"{c}_before", zero)
        joined = joined.withColumn(c, F.col(c) + more if back else F.col(c).bitwiseXOR(more))
    return joined.drop("chunk", *[f"{c}_before" for c in columns])


def collapsed(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences, and the end list of each as rows.

    ``convs`` are all conversations, also those without a turn, ``rows`` their turns.  Sequences are
    (depth, a, b, conv_id, weight) with their smallest conversation; ends are (depth, a, b, conv_id).
    """
    marked = rows.select("conv_id", *_lanes())
    named = marked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    zero = F.lit(0).cast("long")
    ends = stable(convs.join(named, "conv_id", "left").select(*[F.coalesce(c, zero).alias(c) for c in NODE], "conv_id"))
    sequences = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    return stable(sequences), ends


def prefixes(sequences: DataFrame, ends: DataFrame, rows: DataFrame) -> tuple[DataFrame, bool]:
    """Every prefix of every sequence, the root included, and whether any is longer than a chunk.

    (conv_id, depth, a, b, words, up_a, up_b, weight): conv_id is that of the sequence, words those of the last turn,
    ``up_a`` and ``up_b`` name the parent.
    """
    longest, total = ends.agg(F.max("depth"), F.sum("depth")).first()
    chosen = sequences.select("conv_id", "weight")
    # of copies only the smallest conversation is taken apart; a very long one is spread
    one = attach(rows, chosen, "conv_id", ends.select("conv_id", F.col("depth").alias("n")), total or 0)
    one = one.select("conv_id", "place", "weight", "words", *_lanes())
    one = one.withColumn("turn_a", F.col("a")).withColumn("turn_b", F.col("b"))
    split = (longest or 0) > CHUNK
    deep = running(one, "conv_id", "place", ["a", "b"], split).select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        "a",
        "b",
        "words",
        F.col("a").bitwiseXOR(F.col("turn_a")).alias("up_a"),
        F.col("b").bitwiseXOR(F.col("turn_b")).alias("up_b"),
        "weight",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = chosen.select(
        "conv_id", *[zero.alias(c) for c in (*NODE, "words")], none.alias("up_a"), none.alias("up_b"), "weight"
    )
    return stable(deep.unionByName(root)), split


def _listing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation to texts of joined ids."""
    node, ids, rows = None, [], []
    for part in parts:
        for *key, conv in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if ids and (key != node or len(ids) == LISTED):
                rows.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = key
            ids.append(conv)
        if rows:
            yield _batch(rows, "first", "ids")
            rows = []
    if ids:
        yield _batch([(*node, ids[0], ",".join(map(str, ids)))], "first", "ids")


def _digesting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by node and first id to one digest for each node."""
    node, sha, rows = None, None, []
    for part in parts:
        for *key, _, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if key != node:
                if sha is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if rows:
            yield _batch(rows, "ends_sha256")
            rows = []
    if sha is not None:
        yield _batch([(*node, sha.hexdigest())], "ends_sha256")


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    """Rows of a node's three numbers and more; the last column is a text."""
    columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:-1]]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*NODE, *names])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the node's conversation ids in ascending order.

    Ids are sorted and joined in ranges, in many tasks also for one node; a digest has to read a
    node's list in order, so one task does, holding ``LISTED`` ids of it at a time.
    """
    long = "depth long, a long, b long"
    sorted_ids = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    texts = sorted_ids.mapInArrow(_listing, f"{long}, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digesting, f"{long}, ends_sha256 string")


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each distinct beginning of a conversation, from (conv_id) and (conv_id, place, digest, words).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    Identical conversations collapse to one weighted sequence with an end list.  Sequences that
    are proper prefixes of others drop out by an anti-join; those that stay are leaves.
    Weighted prefixes are aggregated to nodes.  A node's own saving is put on the one
    sequence that is named by its smallest member, and sums from each place to the sequence's end,
    added up over all sequences through a node, are the subtree's: no pair of
    ancestor and descendant is made, so work grows with the turns.

    Prefixes are told apart by 128 bits of place-stamped hashes of SHA-256 digests, joined by exclusive or.
    A table without conversations has no nodes; null ids are no conversations; null roles and texts
    count as empty; rows that repeat are turns of their own; other columns aren't read.
    """
    sequences, ends = collapsed(convs, rows)
    every, split = prefixes(sequences, ends, rows)
    nodes = stable(
        every.groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.max("words").alias("words"),
            F.max("up_a").alias("up_a"),
            F.max("up_b").alias("up_b"),
        )
    )
    proper = every.join(
        sequences.select("conv_id", F.col("depth").alias("length")).withColumn("depth", F.col("length")), ["conv_id", "depth"], "left"
    ).filter("length is null").select(*NODE).distinct()
    leaves = sequences.join(proper, list(NODE), "left_anti").select("conv_id", "depth", F.lit(1).cast("long").alias("leaf"))
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    zero = F.lit(0).cast("long")
    valued = (
        every.select("conv_id", *NODE)
        .join(own, ["conv_id", "depth"], "left")
        .join(leaves, ["conv_id", "depth"], "left")
        .withColumn("saved", F.coalesce("saved", zero))
        .withColumn("leaf", F.coalesce("leaf", zero))
    )
    below = running(valued, "conv_id", "depth", ["saved", "leaf"], split, back=True).filter("saved <> 0 or leaf <> 0")
    none = F.lit(None)

    def parts(rows: DataFrame, **values: Column) -> DataFrame:
        kinds = {c: "long" for c in ("conv_id", "n_convs", "up_a", "up_b", "children", "saved", "leaf")} | {"ends_sha256": "string"}
        return rows.select(*NODE, *[values.get(c, none).cast(kind).alias(c) for c, kind in kinds.items()])

    col = F.col
    gathered = (
        parts(nodes, conv_id=col("conv_id"), n_convs=col("n_convs"), up_a=col("up_a"), up_b=col("up_b"))
        .unionByName(parts(below, saved=col("saved"), leaf=col("leaf")))
        .unionByName(
            parts(
                nodes.filter("depth > 0").select((col("depth") - 1).alias("depth"), col("up_a").alias("a"), col("up_b").alias("b")),
                children=F.lit(1),
            )
        )
        .unionByName(parts(end_digests(ends), ends_sha256=col("ends_sha256")))
    )
    summed = stable(
        gathered.groupBy(*NODE).agg(
            *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "up_a", "up_b", "ends_sha256")],
            F.coalesce(F.sum("children"), zero).alias("n_children"),
            F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
            F.coalesce(F.sum("saved"), zero).alias("saved_tokens"),
        )
    )
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    summed = summed.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    named = F.struct((col("depth") - 1).alias("depth"), col("up_a").alias("a"), col("up_b").alias("b"))
    deeper = summed.filter("depth > 0").withColumn("up", named)
    inner = summed.filter("n_children > 0").withColumn("up", F.struct(*NODE))
    count = nodes.count()
    placed = attach(
        deeper, inner.select("up", col("conv_id").alias("parent_conv_id")), "up", inner.select("up", col("n_children").alias("n")), count
    )
    top = summed.filter("depth = 0").withColumn("parent_conv_id", none.cast("long"))
    return placed.select(*shown).unionByName(top.select(*shown))


def conversation_trie(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """The trie of the conversations as :func:`rebuilt`, from rows of single turns; see :func:`prefix_trie`."""
    own = stable(turns(rows, id_column, turn_column, role_column, text_column))
    convs, after = rebuilt(own)
    return prefix_trie(convs, stable(after))

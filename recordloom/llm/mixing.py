"""Mix sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions.sizing import stable
from recordloom.llm.common import WORD

#: Output shards: as many as keep a shard near SHARD_WORDS words, SHARDS at least.
SHARDS, SHARD_WORDS = 64, 32_000_000
#: A source's words make blocks of about BLOCK_WORDS; a source has at most MAX_BLOCKS, or
#: BLOCKS_PER_SHARD for each shard, so blocks of a large source are larger.
BLOCK_WORDS, MAX_BLOCKS, BLOCKS_PER_SHARD = 65_536, 1024, 8
#: A mix has at most so many sources; one row for each is planned on the driver.
MAX_SOURCES = 100_000
SEED = 20_240_601

Weigh = Callable[[Sequence[str | None]], Sequence[float]]


def cyclic(weights: Sequence[float] = (1, 2, 3)) -> Weigh:
    """Weights dealt in turn to the sources in order of code points, null last."""
    return lambda sources: [weights[i % len(weights)] for i in range(len(sources))]


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size.

    What a capped source can't take is shared again by weight among the others until
    none is above its cap.
    """
    limit = np.array(sizes, dtype=float) * cap
    weight = np.array(weights, dtype=float)
    capped = weight <= 0
    out = np.where(capped, 0.0, 0.0)
    while True:
        free = ~capped
        if not free.any():
            return out.tolist()
        share = weight[free] * max(0.0, total - out[capped].sum()) / weight[free].sum()
        above = share > limit[free]
        out[free] = np.where(above, limit[free], share)
        if not above.any():
            return out.tolist()
        capped[np.flatnonzero(free)[above]] = True


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of every source for every shard, shape (sources, shards).

    A node of the tree holds some shards and counts of blocks left for them; its left
    half draws a multivariate-hypergeometric sample of its even share and the right half
    keeps the rest, so sums over shards are exact.
    """
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    rng = np.random.default_rng(seed)
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        middle = (low + high) // 2
        share = int(have.sum()) * (middle - low) // (high - low)
        left, rest = np.zeros_like(have), int(have.sum())
        for i in np.flatnonzero(have):  # marginals one after another: no limit on the counts' sum
            need = share - int(left.sum())
            good, bad = int(have[i]), rest - int(have[i])
            left[i] = need if bad == 0 else _hypergeometric(rng, good, bad, need)
            rest -= good
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # far beyond the generator's range the normal limit is closer than a block in a million
    n = good + bad
    mean = draws * good / n
    spread = math.sqrt(max(0.0, mean * (bad / n) * (n - draws) / max(1, n - 1)))
    return int(min(max(round(rng.normal(mean, spread)), max(0, draws - bad)), min(good, draws)))


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plan_draws(docs: DataFrame, **options: object) -> DataFrame:
    """Every row with ``_mix_plan``; options and results as in :func:`_planned`."""
    return _planned(docs, **options)[0]


def _planned(
    docs: DataFrame,
    weigh: Weigh | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    share: float = 1.0,
    cap: float = 3.0,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    max_blocks: int = MAX_BLOCKS,
    seed: int = SEED,
) -> tuple[DataFrame, int]:
    """Every row with ``_mix_plan``: its size, its source's size and target, and its draws.

    A row's size is its number of words.  Sources share ``share`` of all sizes by
    weight, up to ``cap`` times their own size.  A source is cut into blocks by a hash
    of the row and its blocks are drawn in permuted order, whole rounds first; in a
    last, partial round the block that crosses the target gives rows until the target is
    as near as whole rows come.  The tree splits the drawn blocks among the shards
    exactly and each shard takes its own run of each source's order, so draws are
    disjoint.  A draw holds its round, shard and a place for the shuffle in the shard.

    Null texts have size 0 and are drawn with their block; a null source is a source of
    its own, last in order; repeated rows fall into one block and are drawn each by
    itself; an empty table stays empty.  Results depend on rows alone, so reruns agree.
    """
    marks = ["_mix_key", "_mix_hash", "_mix_size"]
    if clash := [c for c in docs.columns if c.startswith("_mix_")]:
        docs = docs.withColumnsRenamed({c: f"_own{c}" for c in clash})
    source = F.col(source_column).cast("string")
    rows = docs.select(
        "*",
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("_mix_key"),
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("_mix_hash"),
        words_of(text_column).alias("_mix_size"),
    )
    narrow = stable(rows.select(*marks))

    totals = narrow.groupBy("_mix_key").agg(F.sum("_mix_size").alias("size"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] == "", r[0]))
    names, sizes = [r[0] for r in found], [int(r[1]) for r in found]
    weights = (weigh or cyclic())([n[1:] or "" if n else None for n in names])
    goal = targets(sizes, weights, share * sum(sizes), cap)
    shards = shards or max(SHARDS, math.ceil(sum(goal) / SHARD_WORDS))
    max_blocks = max(max_blocks, BLOCKS_PER_SHARD * shards)
    plan = []
    for name, size, target in zip(names, sizes, goal, strict=True):
        rounds = min(math.floor(target / size), math.floor(cap)) if size else 0
        parts = min(max_blocks, max(1, math.ceil(size / block_words)))
        plan.append((name, size, float(target), rounds, float(target - rounds * size), parts))
    spark = docs.sparkSession
    schema = "_mix_key string, _mix_total long, _mix_target double, _mix_rounds int, _mix_rest double, _mix_parts int"
    sources = F.broadcast(spark.createDataFrame(plan, schema))
    block = F.pmod("_mix_hash", "_mix_parts").cast("int").alias("_mix_block")

    ahead = Window.partitionBy("_mix_key").orderBy("_mix_permuted", "_mix_block")
    blocks = (
        narrow.join(sources, "_mix_key")
        .groupBy("_mix_key", block)
        .agg(F.sum("_mix_size").alias("_mix_words"), F.first("_mix_rest").alias("_mix_rest"))
        .withColumn("_mix_permuted", F.xxhash64(F.lit(seed), "_mix_key", "_mix_block"))
        .select(
            "_mix_key",
            "_mix_block",
            (F.row_number().over(ahead) - 1).alias("_mix_rank"),
            (F.col("_mix_rest") - (F.sum("_mix_words").over(ahead) - F.col("_mix_words"))).alias("_mix_left"),
        )
    )
    blocks = stable(blocks)
    begun = {
        r[0]: (r[1], r[2])
        for r in blocks.groupBy("_mix_key")
        .agg(F.count(F.lit(1)), F.count(F.when(F.col("_mix_left") > 0, 1)))
        .collect()
    }
    drawn = np.array([p[3] * begun[p[0]][0] + begun[p[0]][1] for p in plan], dtype=np.int64)
    ends = np.cumsum(split_quotas(drawn, shards, seed), axis=1)
    quotas = F.broadcast(
        spark.createDataFrame(
            [(*p, begun[p[0]][0], e.tolist()) for p, e in zip(plan, ends, strict=True)],
            schema + ", _mix_held int, _mix_ends array<long>",
        )
    )

    inside = Window.partitionBy("_mix_key", "_mix_block").orderBy("_mix_place", "_mix_hash")
    placed = (
        rows.join(quotas, "_mix_key")
        .withColumn("_mix_block", F.pmod("_mix_hash", "_mix_parts").cast("int"))
        .join(blocks, ["_mix_key", "_mix_block"])
        .withColumn("_mix_place", F.xxhash64(F.lit(seed + 1), "_mix_hash"))
        .withColumn("_mix_before", F.sum("_mix_size").over(inside) - F.col("_mix_size"))
        .withColumn(
            "_mix_extra",
            (F.col("_mix_left") > 0) & (F.col("_mix_before") + F.col("_mix_size") / 2 <= F.col("_mix_left")),
        )
    )

    def draw(number: Column) -> Column:
        turned = F.pmod(
            F.col("_mix_rank") + F.pmod(F.xxhash64(F.lit(seed), "_mix_key", number), "_mix_held"), "_mix_held"
        )
        order = F.when(number < F.col("_mix_rounds"), turned).otherwise(F.col("_mix_rank"))
        at = number * F.col("_mix_held") + order
        return F.struct(
            number.alias("round"),
            _first_above("_mix_ends", at, shards).alias("shard"),
            F.xxhash64(F.lit(seed), "_mix_hash", number).alias("place"),
        )

    takes = F.col("_mix_rounds") + F.col("_mix_extra").cast("int")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(cap))), lambda n: n < takes)
    mix = F.struct(
        F.col("_mix_size").alias("size"),
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.transform(numbers, draw).alias("draws"),
    )
    out = placed.select(*[c for c in docs.columns], mix.alias("_mix_plan"))
    return (out.withColumnsRenamed({f"_own{c}": c for c in clash}) if clash else out), shards


def _first_above(ends: str, at: Column, size: int) -> Column:
    """How many of the rising numbers in an array are not above ``at``, by bisection."""
    steps = F.sequence(F.lit(0), F.lit(max(0, size.bit_length() - 1)))

    def narrow(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = F.get(F.col(ends), middle) > at
        done = state["low"] >= state["high"]
        return F.struct(
            F.when(done | above, state["low"]).otherwise(middle + 1).alias("low"),
            F.when(~done & above, middle).otherwise(state["high"]).alias("high"),
        )

    return F.aggregate(
        steps, F.struct(F.lit(0).alias("low"), F.lit(size).alias("high")), narrow, lambda state: state["low"]
    )


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row once per draw, dealt to shards and shuffled in each.

    A shard is a task; the number of shards grows with the words of the mix.
    """
    drawn, shards = _planned(docs, **options)
    return (
        drawn.withColumn("_mix_draw", F.explode("_mix_plan.draws"))
        .repartitionById(shards, F.col("_mix_draw.shard"))
        .sortWithinPartitions("_mix_draw.shard", "_mix_draw.place", "_mix_draw.round")
        .drop("_mix_plan", "_mix_draw")
    )

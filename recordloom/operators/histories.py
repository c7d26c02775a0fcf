"""Reports that follow from the written record specification.

Validity windows, supersession, open contradictions, history consistency,
epistemic transitions and evidence links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.hot import SALT, spread_over
from recordloom.functions.ordered import MAX_GROUP_ROWS, Chunked, chunk, running
from recordloom.functions.sizing import stable


def valid_at(information: DataFrame, moment: str) -> DataFrame:
    """Records applicable at a moment; an open end stays applicable."""
    at = F.lit(moment).cast("timestamp")
    begins = F.try_to_timestamp(F.col("time.valid_from"))
    ends = F.try_to_timestamp(F.col("time.valid_until"))
    return information.filter(
        F.coalesce(begins <= at, F.lit(True)) & F.coalesce(at <= ends, F.lit(True))
    )


#: Seconds of the smallest bin of time.
BIN_SECONDS = 3_600


def valid_at_moments(information: DataFrame, moments: DataFrame) -> DataFrame:
    """(moment, id) for every moment of a table (moment) and every record applicable then.

    A span of time is cut into bins of different widths, at most two of each width, so that a moment of the span lies
    in exactly one of them; a moment asks one bin of each width.  Both meet by equality, and the ends are compared
    exactly afterwards.  Open ends reach to the first or last moment that is asked for.  Bins that very many records
    share (all that are always valid) are spread over salts, to which the moments of the bin are copied.
    Null moments match nothing; moments that repeat count once.
    """
    asked = moments.select(F.col("moment").cast("timestamp").alias("moment")).filter("moment is not null").distinct()
    asked = stable(asked.withColumn("second", F.unix_seconds("moment")))
    least, most = asked.agg(F.min("second"), F.max("second")).first()
    if least is None:
        return asked.select("moment").join(information.select("id").limit(0), F.lit(True))
    last = (most - least) // BIN_SECONDS
    # each level's bins are twice as wide as those before; one of the last level holds all moments
    levels = int(last + 1).bit_length() + 1

    def bin_of(second: Column) -> Column:
        return F.floor((second - F.lit(least)) / BIN_SECONDS).cast("long")

    begins, ends = (F.try_to_timestamp(F.col(f"time.{name}")) for name in ("valid_from", "valid_until"))
    spans = information.select("id", begins.alias("begins"), ends.alias("ends")).withColumns(
        {
            "first": F.greatest(F.lit(0).cast("long"), F.coalesce(bin_of(F.unix_seconds("begins")), F.lit(0).cast("long"))),
            "end": F.least(F.lit(last), F.coalesce(bin_of(F.unix_seconds("ends")), F.lit(last))) + 1,
        }
    )

    def bins(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        low, high = F.ceil(F.col("first") / width).cast("long"), F.floor(F.col("end") / width).cast("long")
        top = level == levels - 1
        left = F.when((low < high) & (top | (low % 2 == 1)), F.struct(level.alias("level"), low.alias("bin")))
        right = F.when((low < high) & ~top & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("bin")))
        return F.array_compact(F.array(left, right))

    every = F.sequence(F.lit(0), F.lit(levels - 1))
    cut = spans.filter(F.col("first") < F.col("end")).withColumn("at", F.explode(F.flatten(F.transform(every, bins))))
    cut = stable(cut.select(F.concat_ws(":", "at.level", "at.bin").alias("bin"), "id", "begins", "ends"))
    bin_now = F.floor(bin_of(F.col("second")) / F.pow(F.lit(2), F.col("level"))).cast("long")
    probes = asked.withColumn("level", F.explode(every)).select(F.concat_ws(":", "level", bin_now).alias("bin"), "moment")
    spread = spread_over(cut, "bin")
    met = spread.salted(cut, "id").join(spread.copied(probes), ["bin", SALT])
    inside = F.coalesce(F.col("begins") <= F.col("moment"), F.lit(True)) & F.coalesce(F.col("moment") <= F.col("ends"), F.lit(True))
    return met.filter(inside).select("moment", "id")


def stale(information: DataFrame, now: str) -> DataFrame:
    """Records whose validity has ended."""
    return information.filter(
        F.try_to_timestamp(F.col("time.valid_until")) < F.lit(now).cast("timestamp")
    )


def supersession_view(information: DataFrame, relations: DataFrame) -> DataFrame:
    """Every record, marked as active or as superseded by another."""
    replaced = (
        relations.filter(F.col("type") == "SUPERSEDES")
        .select(F.col("target_id").alias("id"))
        .distinct()
        .withColumn("replaced", F.lit(True))
    )
    return information.join(replaced, "id", "left").select(
        "id",
        "epistemic_status",
        F.coalesce("replaced", F.lit(False)).alias("superseded"),
    )


def successors(information: DataFrame, relations: DataFrame) -> DataFrame:
    """Who stands for each superseded record now: (id, successor_id, forked, problem).

    A record is replaced by those that supersede it, these by others, up to records that nobody
    supersedes: its active successors, one row each.  ``forked`` marks ids with several of them.  An id from which a chain
    runs into a ring has a row with problem ``CYCLE`` and no successor; a successor without a record
    has problem ``MISSING``.

    Pointers are doubled: each round replaces the end of a pointer by that end's own pointers, so a
    chain of any length takes about log2 of it rounds.  When a round finds no end that wasn't known and no record
    whose pointers all came to an end, no later one does: the first end or last record to be found after it
    would have one nearer to it that this round had found.  What still moves then goes round, however long
    the rings are.  Ends that very many pointers share are spread over salts.
    """
    links = relations.filter(F.col("type") == "SUPERSEDES").select(F.col("target_id").alias("id"), F.col("source_id").alias("to"))
    links = stable(links.filter(F.col("id").isNotNull() & F.col("to").isNotNull()).distinct())
    replaced = links.select(F.col("id").alias("to"), F.lit(False).alias("done")).distinct()
    spread = spread_over(links, "to")
    begun = spread.salted(links, "id").join(spread.copied(replaced), ["to", SALT], "left")
    # those that aren't done are as many steps long as were doubled, the others at most that
    pointers = stable(begun.select("id", "to", F.coalesce("done", F.lit(True)).alias("done")))
    before = None
    while True:
        each = pointers.groupBy("id").agg(F.count_if("done").alias("ends"), F.bool_or(~F.col("done")).alias("moves"))
        now = tuple(each.agg(F.sum("ends"), F.count_if("moves")).first())
        if not now[1] or now == before:
            break
        before = now
        moving, ended = pointers.filter(~F.col("done")), pointers.filter("done")
        spread = spread_over(moving, "to")
        onward = pointers.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("last"))
        moved = spread.salted(moving, "id").join(spread.copied(onward), ["to", SALT])
        moved = moved.select("id", F.col("next").alias("to"), F.col("last").alias("done"))
        pointers = stable(moved.unionByName(ended).distinct())
    moving, ended = pointers.filter(~F.col("done")).drop("done"), pointers.filter("done").drop("done")
    known = information.select(F.col("id").alias("to"), F.lit(True).alias("known")).distinct()
    several = ended.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("forked"))
    found = ended.join(known, "to", "left").join(several, "id").select(
        "id", F.col("to").alias("successor_id"), "forked", F.when(F.col("known").isNull(), F.lit("MISSING")).alias("problem")
    )
    none = F.lit(None).cast("string")
    rings = moving.select("id").distinct().join(several, "id", "left").select(
        "id", none.alias("successor_id"), F.coalesce("forked", F.lit(False)).alias("forked"), F.lit("CYCLE").alias("problem")
    )
    return found.unionByName(rings)


def open_contradictions(information: DataFrame, relations: DataFrame) -> DataFrame:
    """CONTRADICTS pairs where neither side is resolved.

    A pair is resolved when a side is refuted or superseded.  Records that very many others contradict
    are spread over salts in both joins.
    """
    pairs = relations.filter(F.col("type") == "CONTRADICTS").select("source_id", "target_id").distinct()
    state = information.select("id", "epistemic_status")
    source = state.select(F.col("id").alias("source_id"), F.col("epistemic_status").alias("source_status"))
    target = state.select(F.col("id").alias("target_id"), F.col("epistemic_status").alias("target_status"))
    resolved = ("REFUTED", "SUPERSEDED")
    first, second = spread_over(pairs, "source_id"), spread_over(pairs, "target_id")
    begun = first.salted(pairs, "target_id").join(first.copied(source), ["source_id", SALT]).drop(SALT)
    return (
        second.salted(begun, "source_id")
        .join(second.copied(target), ["target_id", SALT])
        .filter(~F.col("source_status").isin(*resolved) & ~F.col("target_status").isin(*resolved))
        .select("source_id", "target_id", "source_status", "target_status")
    )


def history_gaps(events: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Events that do not continue the history of their entity.

    An event concerns an information or a thread, never both or neither; its
    ``before`` equals the previous ``after``; a thread change is a legal one.
    """
    both = F.col("information_id").isNotNull() & F.col("thread_id").isNotNull()
    neither = F.col("information_id").isNull() & F.col("thread_id").isNull()
    keyed = events.withColumn("_entity", F.coalesce("information_id", "thread_id"))
    known = keyed.filter(F.col("_entity").isNotNull())
    linked = running(
        chunk(known, "_entity", "revision", max_rows), lasts={"previous": F.col("after")}, before=True
    ).rows
    lost = keyed.filter(F.col("_entity").isNull()).withColumn("previous", F.lit(None).cast("string"))
    rows = linked.select(*lost.columns).unionByName(lost)
    legal = F.lit(False)
    for origin, targets in K.THREAD_TRANSITIONS.items():
        if targets:
            legal = legal | ((F.col("before") == origin) & F.col("after").isin(*targets))
    problem = X.first_error(
        (both | neither, "ENTITY"),
        (
            F.coalesce(F.col("previous") != F.col("before"), F.lit(False)),
            "BROKEN_CHAIN",
        ),
        (F.col("thread_id").isNotNull() & ~legal, "ILLEGAL_TRANSITION"),
    )
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "event_id", "revision", "before", "after", "previous", "problem"
    )


def states_at(events: DataFrame, moments: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The state of entities at past moments, from their events: (entity_id, moment, status, revision, event_id).

    ``events``: event_id, information_id or thread_id, revision, before, after, happened_at; ``moments``: entity_id, moment.
    The state is that after the last event up to the moment, of events at one time that with the highest revision (then
    event_id).  Ahead of the first event it is what that event found, without a revision; an entity without events has a
    row without status.  Events of no entity or of two, or without a time, tell of no state; null moments and entities
    match nothing, and moments that repeat count once.

    Events and moments of an entity are put in one order and the last event is carried along it, over the chunks of an
    entity that has very many of them.
    """
    one = F.col("information_id").isNull() != F.col("thread_id").isNull()
    told = events.filter(one & F.col("happened_at").isNotNull()).select(
        F.coalesce("information_id", "thread_id").alias("entity_id"),
        F.unix_micros(F.col("happened_at").cast("timestamp")).alias("at"),
        F.struct("revision", "event_id", F.col("after").alias("status")).alias("state"),
        F.struct("revision", "event_id", "before").alias("found"),
    )
    instants = told.groupBy("entity_id", "at").agg(F.max("state").alias("state"))
    asked = moments.select("entity_id", F.col("moment").cast("timestamp").alias("moment"))
    asked = asked.filter(F.col("entity_id").isNotNull() & F.col("moment").isNotNull()).distinct()
    # a moment comes after the events of its own microsecond
    steps = instants.select("entity_id", (F.col("at") * 2).alias("place"), F.lit(None).cast("timestamp").alias("moment"), "state")
    nothing = F.lit(None).cast(instants.schema["state"].dataType)
    probes = asked.select("entity_id", (F.unix_micros("moment") * 2 + 1).alias("place"), "moment", nothing.alias("state"))
    line = running(chunk(steps.unionByName(probes), "entity_id", "place", max_rows), lasts={"now": F.col("state")}).rows
    met = stable(line.filter(F.col("moment").isNotNull()).select("entity_id", "moment", "now"))
    early = met.filter(F.col("now").isNull()).select("entity_id", "moment")
    first = told.groupBy("entity_id").agg(F.min(F.struct("at", "found")).alias("first"))
    spread = spread_over(early, "entity_id")
    begun = spread.salted(early, "moment").join(spread.copied(first), ["entity_id", SALT], "left")
    unknown = F.lit(None)
    ahead = begun.select(
        "entity_id",
        "moment",
        F.col("first.found.before").alias("status"),
        unknown.cast(events.schema["revision"].dataType).alias("revision"),
        unknown.cast(events.schema["event_id"].dataType).alias("event_id"),
    )
    later = met.filter(F.col("now").isNotNull()).select("entity_id", "moment", "now.status", "now.revision", "now.event_id")
    return later.unionByName(ahead)


def revision_gaps(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose last event is not at their stored revision.

    ``entities``: entity_id, revision.
    """
    last = (
        events.withColumn("entity_id", F.coalesce("information_id", "thread_id"))
        .filter(F.col("entity_id").isNotNull())
        .groupBy("entity_id")
        .agg(F.max("revision").alias("event_revision"))
    )
    return entities.join(last, "entity_id").filter(F.col("revision") != F.col("event_revision"))


def epistemic_gaps(events: DataFrame) -> DataFrame:
    """Information events whose change of status the specification does not list."""
    legal = F.col("before") == F.col("after")
    for origin, targets in K.EPISTEMIC_TRANSITIONS.items():
        if targets:
            legal = legal | ((F.col("before") == origin) & F.col("after").isin(*targets))
    return events.filter(
        F.col("information_id").isNotNull() & F.col("thread_id").isNull() & ~legal
    ).select("event_id", "information_id", "before", "after")


def reopened_actions(replayed: Chunked) -> DataFrame:
    """Accepted commands that put a completed action back to PLANNED.

    ``replayed`` is a replayed command log.  The previous state of an action is
    the status of the last accepted command on it; the chunks of a thread order
    the commands of each of its actions as well.
    """
    steps = replayed.rows.filter(
        (F.col("outcome") == "OK") & F.col("kind").isin("ADD_ACTION", "SET_ACTION_STATUS")
    ).withColumn("_action", F.concat_ws("|", "thread_id", "action_id"))
    by_action = Chunked(steps, "_action", replayed.order, replayed.split)
    seen = running(by_action, lasts={"previous": F.col("status")}, before=True).rows
    return seen.filter((F.col("previous") == "COMPLETED") & (F.col("status") == "PLANNED")).select(
        "seq", "thread_id", "action_id"
    )


def evidence_links(information: DataFrame) -> DataFrame:
    """Supporting and contradicting references per record, and those that exist."""
    kinds = F.array(
        F.struct(F.lit("supporting").alias("kind"), F.col("evidence.supporting").alias("refs")),
        F.struct(F.lit("contradicting").alias("kind"), F.col("evidence.contradicting").alias("refs")),
    )
    links = information.select("id", F.explode(kinds).alias("k")).select(
        "id", F.col("k.kind").alias("kind"), F.explode_outer("k.refs").alias("ref")
    )
    known = information.select(F.col("id").alias("ref"), F.lit(1).alias("known"))

    def count(kind: str):
        return F.count(F.when(F.col("kind") == kind, F.col("ref"))).alias(kind)

    return (
        links.join(known, "ref", "left")
        .groupBy("id")
        .agg(
            count("supporting"),
            count("contradicting"),
            F.count(F.when(F.col("ref").isNotNull() & F.col("known").isNull(), 1)).alias("dangling"),
        )
    )

"""Evaluation of many logged requests against one thread table.

Requests meet threads through equality keys: the thread id, the title, a
related id, a relation type, or, for what is left, the status.  Repeated
requests are evaluated once.  Requests without a selective key are few in
practice; they are broadcast when counted small and otherwise spread with a
salt, so that no status value ends up in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.ranking import best_rows
from recordloom.functions.sizing import BROADCAST_ROWS, fits, stable
from recordloom.operators import threads as T
from recordloom.sources.requests import parse_requests

SALTS = 64

_FILTERS = (
    "intent",
    "thread_id",
    "status",
    "statuses",
    "title",
    "title_contains",
    "action_id",
    "action_status",
    "action_statuses",
    "relation_type",
    "related_to",
    "provenance",
    "created_after",
    "created_before",
    "updated_after",
    "updated_before",
    "started_after",
    "started_before",
    "sort_by",
    "sort_order",
    "limit",
    "offset",
)

ACTION_INTENTS = ("LIST_OPEN_ACTIONS", "LIST_THREAD_ACTIONS")


def distinct_queries(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests as (request, query) pairs and the distinct queries."""
    valid = keep_where(parse_requests(requests), F.col("error").isNull())
    # A map cannot be a grouping key: its sorted entries stand for it.
    texts = [
        F.to_json(F.struct(F.array_sort(F.map_entries(c)))) if c == "provenance" else F.to_json(F.struct(c))
        for c in _FILTERS
    ]
    keyed = valid.withColumn("query_id", X.sha256(F.concat_ws("|", *texts)))
    # Parsing is done once: both uses below read the kept rows.
    keyed = stable(keyed.select("request_id", "query_id", *_FILTERS))
    queries = keyed.groupBy("query_id").agg(*[F.first(c).alias(c) for c in _FILTERS])
    return keyed.select("request_id", "query_id"), stable(queries)


def evaluate_requests(
    requests: DataFrame,
    threads: DataFrame,
    relations: DataFrame,
    actions: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Result rows of every valid request.

    Columns: request_id, rank (1 is the first row of the page), thread_id and,
    for action lists, pos, action_id, description, action_status and metadata.
    """
    pairs, queries = distinct_queries(requests)
    q = _prefixed(queries)
    matches = match_threads(q, threads, relations, broadcast_rows)

    get = F.col("q_intent") == "GET_THREAD"
    none = F.lit(None).cast("string")
    lists = matches.filter(~F.col("q_intent").isin(*ACTION_INTENTS, "GET_THREAD"))
    by = F.col("q_sort_by")
    text_key = (
        F.when(by == "created_at", F.col("created_at"))
        .when(by == "updated_at", F.col("updated_at"))
        .when(by == "started_at", F.coalesce("started_at", F.lit("")))
        .when(by == "title", F.col("_title"))
        .when(by == "status", F.col("status"))
    )
    number_key = F.when(by == "revision", F.col("revision"))
    down = F.col("q_sort_order") == "DESC"
    thread_hits = lists.select(
        "query_id",
        "q_limit",
        "q_offset",
        "thread_id",
        F.lit(None).cast("int").alias("pos"),
        none.alias("action_id"),
        # one sort direction per window: each direction gets its own columns
        F.when(down, text_key).alias("text_down"),
        F.when(~down, text_key).alias("text_up"),
        F.when(down, -number_key).otherwise(number_key).alias("number"),
        none.alias("description"),
        none.alias("action_status"),
        none.alias("metadata"),
    )

    wanted = F.array_distinct(
        F.array_compact(F.concat(F.array("q_action_status"), "q_action_statuses"))
    )
    open_states = F.array(*[F.lit(s) for s in K.OPEN_ACTION_STATUSES])
    is_open = F.col("q_intent") == "LIST_OPEN_ACTIONS"
    states = F.when(is_open & (F.size(wanted) == 0), open_states).otherwise(wanted)
    steps = (
        matches.filter(F.col("q_intent").isin(*ACTION_INTENTS))
        .select("query_id", "q_limit", "q_offset", "q_intent", "q_action_id", states.alias("states"), "thread_id")
        .join(actions.withColumnRenamed("status", "action_status"), "thread_id")
        .filter(
            ((F.size("states") == 0) | F.array_contains("states", F.col("action_status")))
            & (is_open | F.col("q_action_id").isNull() | (F.col("q_action_id") == F.col("action_id")))
        )
    )
    action_hits = steps.select(
        "query_id",
        "q_limit",
        "q_offset",
        "thread_id",
        "pos",
        "action_id",
        none.alias("text_down"),
        none.alias("text_up"),
        F.lit(None).cast("int").alias("number"),
        "description",
        "action_status",
        "metadata",
    )

    order = [
        F.col("text_down").desc_nulls_last(),
        F.col("text_up").asc_nulls_last(),
        F.col("number").asc_nulls_last(),
        X.file_order(F.col("thread_id")),
        F.col("pos"),
        F.col("action_id"),
        F.col("description"),
        F.col("metadata"),
    ]
    kept = (
        best_rows(
            thread_hits.unionByName(action_hits),
            "query_id",
            order,
            spread="thread_id",
            bound=F.col("q_offset") + F.col("q_limit"),
        )
        .filter(F.col("row") > F.col("q_offset"))
        .select(
            "query_id",
            (F.col("row") - F.col("q_offset")).alias("rank"),
            "thread_id",
            "pos",
            "action_id",
            "description",
            "action_status",
            "metadata",
        )
    )
    # GET_THREAD knows neither order nor page.
    single = matches.filter(get).select(
        "query_id",
        F.lit(1).alias("rank"),
        "thread_id",
        F.lit(None).cast("int").alias("pos"),
        *[none.alias(n) for n in ("action_id", "description", "action_status", "metadata")],
    )
    return pairs.join(kept.unionByName(single), "query_id").drop("query_id")


def _prefixed(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *[F.col(c).alias("q_" + c) for c in _FILTERS])


def match_threads(
    q: DataFrame, threads: DataFrame, relations: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Threads that pass the filters of each query, by the most selective key."""
    route = (
        F.when(F.col("q_intent") == "GET_THREAD", "id")
        .when(F.col("q_related_to").isNotNull(), "related")
        .when(F.col("q_relation_type").isNotNull(), "type")
        .when(F.col("q_title").isNotNull(), "title")
        .otherwise("status")
    )
    q = q.withColumn("_route", route).withColumn("q_needle", X.casefold(F.col("q_title_contains")))
    rows = threads.withColumn("_title", X.casefold(F.col("title")))

    by_id = q.filter(F.col("_route") == "id").withColumn("thread_id", F.col("q_thread_id"))
    ends = relations.select(
        "thread_id",
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("q_related_to"),
    )
    related = q.filter(F.col("_route") == "related").join(ends, "q_related_to")
    links = relations.select("thread_id", F.col("type").alias("q_relation_type"))
    # A query with both relation filters: they may be met by different relations.
    one = related.filter(F.col("q_relation_type").isNull())
    both = related.filter(F.col("q_relation_type").isNotNull()).join(
        links, ["thread_id", "q_relation_type"], "left_semi"
    )
    # A type is met by a tenth of all relations: spread these over slots.
    slots = F.sequence(F.lit(0), F.lit(SALTS - 1))
    typed = (
        links.withColumn("_slot", F.pmod(F.xxhash64("thread_id"), F.lit(SALTS)).cast("int"))
        .join(q.filter(F.col("_route") == "type").withColumn("_slot", F.explode(slots)), ["q_relation_type", "_slot"])
        .drop("_slot")
    )
    titled = q.filter(F.col("_route") == "title").join(
        threads.select("thread_id", F.col("title").alias("q_title")), "q_title"
    )
    candidates = reduce(DataFrame.unionByName, (by_id, one, both, typed, titled)).dropDuplicates(
        ["query_id", "thread_id"]
    )
    keyed = rows.join(candidates, "thread_id").filter(_residual())

    all_states = F.array(*[F.lit(s) for s in K.THREAD_STATUSES])
    open_states = F.array(*[F.lit(s) for s in K.THREAD_STATUSES if s not in K.CLOSED_STATUSES])
    states = (
        F.when(F.col("q_intent") == "LIST_THREADS_BY_STATUS", _wanted_states())
        .when(F.col("q_intent") == "LIST_OPEN_THREADS", open_states)
        .otherwise(all_states)
    )
    broad = q.filter(F.col("_route") == "status").withColumn("_state", F.explode(states))
    on_state = F.col("status") == F.col("_state")
    # Pages without any other filter share the first rows of each state and order.
    plain = ~F.col("q_intent").isin(*ACTION_INTENTS)
    for name in _FILTERED:
        plain = plain & F.col("q_" + name).isNull()
    plain = F.coalesce(plain, F.lit(False))
    shared = _first_rows(rows, broad.filter(plain))
    broad = broad.filter(~plain)
    if fits(broad, broadcast_rows):
        by_state = rows.join(F.broadcast(broad), on_state & _residual())
    else:
        salted = rows.withColumn(
            "_salt", F.pmod(F.xxhash64("thread_id"), F.lit(SALTS)).cast("int")
        )
        spread = broad.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        by_state = salted.join(
            spread, on_state & (F.col("_salt") == F.col("_slot")) & _residual()
        ).drop("_salt", "_slot")
    by_state = by_state.drop("_state")
    return reduce(DataFrame.unionByName, [keyed, by_state, *[s.select(by_state.columns) for s in shared]])


#: Filters on the thread itself, beside its state.
_FILTERED = (
    "title",
    "title_contains",
    "provenance",
    "created_after",
    "created_before",
    "updated_after",
    "updated_before",
    "started_after",
    "started_before",
)


def _first_rows(rows: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """Candidates of unfiltered pages: for each sort and direction in use (twelve at most)
    the first rows of every state, as many as the deepest page reaches."""
    used = (
        pages.groupBy("q_sort_by", "q_sort_order")
        .agg(F.max(F.col("q_offset") + F.col("q_limit")).alias("bound"))
        .collect()
    )
    out = []
    for by, direction, bound in used:
        if by == "title":
            key = F.col("_title")
        elif by == "started_at":
            key = F.coalesce("started_at", F.lit(""))
        else:
            key = F.col(by)
        key = key.desc_nulls_last() if direction == "DESC" else key.asc_nulls_last()
        first = best_rows(rows, "status", [key, X.file_order(F.col("thread_id"))], "thread_id", bound).drop("row")
        asked = pages.filter((F.col("q_sort_by") == by) & (F.col("q_sort_order") == direction))
        out.append(first.join(asked, F.col("status") == F.col("_state")).drop("_state"))
    return out


def _wanted_states() -> Column:
    return F.array_distinct(F.array_compact(F.concat(F.array("q_status"), "q_statuses")))


def _residual() -> Column:
    """Filters on the thread row itself; null means not asked for."""

    def given(name: str, condition: Column) -> Column:
        return F.col("q_" + name).isNull() | F.coalesce(condition, F.lit(False))

    intent = F.col("q_intent")
    status = (
        F.when(
            intent == "LIST_THREADS_BY_STATUS",
            F.array_contains(_wanted_states(), F.col("status")),
        )
        .when(intent == "LIST_OPEN_THREADS", ~F.col("status").isin(*K.CLOSED_STATUSES))
        .otherwise(F.lit(True))
    )
    equal = F.forall(
        F.map_entries("q_provenance"),
        lambda e: X.comparable(
            F.coalesce(F.try_element_at("provenance", e["key"]), F.lit("null"))
        )
        == X.comparable(e["value"]),
    )
    checks = [
        status,
        given("title", F.col("title") == F.col("q_title")),
        given("title_contains", F.contains("_title", F.col("q_needle"))),
        F.col("q_provenance").isNull() | equal,
    ]
    for field in ("created", "updated", "started"):
        stored = F.col(field + "_at")
        checks.append(given(field + "_after", stored > F.col(f"q_{field}_after")))
        checks.append(given(field + "_before", stored < F.col(f"q_{field}_before")))
    # GET_THREAD looks at nothing but the id.
    return (intent == "GET_THREAD") | reduce(Column.__and__, checks)


def result_rows(results: DataFrame, threads: DataFrame) -> DataFrame:
    """Results as JSON: a thread, or a thread with one of its actions."""
    rows = results.withColumnsRenamed(
        {"description": "action_description", "metadata": "action_metadata"}
    ).join(threads, "thread_id")
    thread = T.thread_json(threads.columns)
    pair = X.json_object(
        {
            "action": T.action_json(
                F.struct(
                    "action_id",
                    F.col("action_description").alias("description"),
                    F.col("action_status").alias("status"),
                    F.col("action_metadata").alias("metadata"),
                )
            ),
            "thread": thread,
        }
    )
    return rows.select(
        "request_id",
        "rank",
        F.when(F.col("action_id").isNull(), thread).otherwise(pair).alias("data"),
    )


def responses(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """One response line per valid request.

    ``rows`` hold request_id, rank and data (a JSON object each).  A page has at
    most 1000 rows, so the list gathered per request is bounded.
    """
    valid = keep_where(parse_requests(requests), F.col("error").isNull())
    lists = rows.groupBy("request_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "data"))), lambda r: r["data"]
        ).alias("items")
    )
    body = X.json_object(
        {
            "response": X.json_object(
                {
                    "schema_version": F.lit(f'"{K.REQUEST_SCHEMA}"'),
                    "domain": X.json_string(F.col("domain")),
                    "intent": X.json_string(F.col("intent")),
                    "status": F.lit('"OK"'),
                    "data": F.concat(
                        F.lit("["), F.coalesce(F.array_join("items", ","), F.lit("")), F.lit("]")
                    ),
                }
            )
        }
    )
    return valid.join(lists, "request_id", "left").select("request_id", body.alias("response"))

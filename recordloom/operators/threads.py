"""Queries over threads and their actions.

Threads are one row each; actions and relations are child tables keyed by
``thread_id`` so that filters and column pruning reach the scan.  Filters are
conjunctive.  Timestamps are compared as text unless ``as_instants`` is set.
Order is total: every sort ends in the record's file name, every action list in
its position inside the thread.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X


class QueryError(ValueError):
    """A query whose arguments contradict each other."""


def get_thread(threads: DataFrame, thread_id: str) -> DataFrame:
    """The thread with this id; no other filter, order or page applies."""
    if not thread_id:
        raise QueryError("thread_id is required for GET_THREAD")
    return threads.filter(F.col("thread_id") == thread_id)


def list_threads(threads: DataFrame, relations: DataFrame | None = None, **filters: Any) -> DataFrame:
    """All threads, closed ones too."""
    return _thread_page(threads, relations, None, filters)


def list_open_threads(threads: DataFrame, relations: DataFrame | None = None, **filters: Any) -> DataFrame:
    """Threads that are neither completed nor cancelled."""
    return _thread_page(threads, relations, ~F.col("status").isin(*K.CLOSED_STATUSES), filters)


def list_threads_by_status(
    threads: DataFrame,
    relations: DataFrame | None = None,
    *,
    status: str | None = None,
    statuses: Iterable[str] = (),
    **filters: Any,
) -> DataFrame:
    wanted = ordered_union(status, statuses)
    if not wanted:
        raise QueryError("status or statuses is required for LIST_THREADS_BY_STATUS")
    return _thread_page(threads, relations, F.col("status").isin(*wanted), filters)


def list_open_actions(
    threads: DataFrame,
    actions: DataFrame,
    relations: DataFrame | None = None,
    *,
    action_status: str | None = None,
    action_statuses: Iterable[str] = (),
    **filters: Any,
) -> DataFrame:
    """Actions in the given states, of open and closed threads alike."""
    wanted = ordered_union(action_status, action_statuses) or list(K.OPEN_ACTION_STATUSES)
    return _action_page(threads, actions, relations, F.col("status").isin(*wanted), filters)


def list_thread_actions(
    threads: DataFrame,
    actions: DataFrame,
    relations: DataFrame | None = None,
    *,
    thread_id: str | None = None,
    action_id: str | None = None,
    action_status: str | None = None,
    action_statuses: Iterable[str] = (),
    **filters: Any,
) -> DataFrame:
    """Actions by id and state.  ``thread_id`` is required with ``action_id`` but
    does not narrow the result."""
    if action_id is not None and not thread_id:
        raise QueryError("thread_id is required when action_id is specified")
    wanted = ordered_union(action_status, action_statuses)
    keep = F.lit(True)
    if action_id is not None:
        keep = keep & (F.col("action_id") == action_id)
    if wanted:
        keep = keep & F.col("status").isin(*wanted)
    return _action_page(threads, actions, relations, keep, filters)


def ordered_union(one: str | None, many: Iterable[str]) -> list[str]:
    """Single value and list together, in order, without repeats."""
    return list(dict.fromkeys(([one] if one is not None else []) + list(many)))


# --- filters -----------------------------------------------------------------


def filter_threads(
    threads: DataFrame,
    relations: DataFrame | None = None,
    *,
    title: str | None = None,
    title_contains: str | None = None,
    relation_type: str | None = None,
    related_to: str | None = None,
    provenance: Mapping[str, object] | None = None,
    created_after: str | None = None,
    created_before: str | None = None,
    updated_after: str | None = None,
    updated_before: str | None = None,
    started_after: str | None = None,
    started_before: str | None = None,
    as_instants: bool = False,
) -> DataFrame:
    for name, value in (("title", title), ("title_contains", title_contains)):
        if value is not None and not value.strip():
            raise QueryError(f"{name} cannot be empty")

    conditions: list[Column] = []
    if title is not None:
        conditions.append(F.col("title") == title)
    if title_contains is not None:
        conditions.append(X.casefold(F.col("title")).contains(title_contains.casefold()))
    for key, value in (provenance or {}).items():
        stored = F.coalesce(F.element_at("provenance", F.lit(key)), F.lit("null"))
        conditions.append(X.comparable(stored) == X.comparable(F.lit(X.canonical(value))))
    bounds = {
        "created_at": (created_after, created_before),
        "updated_at": (updated_after, updated_before),
        "started_at": (started_after, started_before),
    }
    for name, (after, before) in bounds.items():
        if after is not None:
            conditions.append(_moment(F.col(name), as_instants) > _moment(F.lit(after), as_instants))
        if before is not None:
            conditions.append(_moment(F.col(name), as_instants) < _moment(F.lit(before), as_instants))
    kept = threads
    if conditions:
        kept = kept.filter(reduce(Column.__and__, conditions))

    # The two relation filters may be met by different relations of a thread.
    if relation_type is not None:
        kept = _having_relation(kept, relations, lambda r: r["type"] == relation_type)
    if related_to is not None:
        kept = _having_relation(
            kept,
            relations,
            lambda r: (r["target_id"] == related_to) | (r["source_id"] == related_to),
        )
    return kept


def _having_relation(threads: DataFrame, relations: DataFrame | None, condition: Any) -> DataFrame:
    if relations is None:
        return threads.filter(F.exists("relations", condition))
    return threads.join(
        relations.filter(condition(relations)).select("thread_id"), "thread_id", "left_semi"
    )


def _moment(column: Column, as_instant: bool) -> Column:
    return F.try_to_timestamp(column) if as_instant else column


# --- order and pages ---------------------------------------------------------


def check_page(limit: int, offset: int) -> None:
    if limit < 1:
        raise QueryError("limit must be >= 1")
    if limit > K.MAX_LIMIT:
        raise QueryError(f"limit must be <= {K.MAX_LIMIT}")
    if offset < 0:
        raise QueryError("offset must be >= 0")


def sort_key(name: str) -> Column:
    if name not in K.SORT_FIELDS:
        raise QueryError(f"unknown sort field: {name}")
    if name == "started_at":
        return F.coalesce(F.col(name), F.lit(""))
    if name == "title":
        return X.casefold(F.col(name))
    return F.col(name)


def sort_threads(
    threads: DataFrame,
    sort_by: str = "updated_at",
    sort_order: str = "DESC",
    limit: int = K.DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of threads; ties keep file order in both directions."""
    check_page(limit, offset)
    key = sort_key(sort_by)
    ordered = threads.orderBy(
        key.desc() if sort_order == "DESC" else key.asc(), X.file_order(F.col("thread_id"))
    )
    return page(ordered, limit, offset)


def page(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _thread_page(
    threads: DataFrame,
    relations: DataFrame | None,
    condition: Column | None,
    filters: dict[str, Any],
) -> DataFrame:
    paging = {k: filters.pop(k) for k in ("sort_by", "sort_order", "limit", "offset") if k in filters}
    kept = threads if condition is None else threads.filter(condition)
    return sort_threads(filter_threads(kept, relations, **filters), **paging)


def _action_page(
    threads: DataFrame,
    actions: DataFrame,
    relations: DataFrame | None,
    condition: Column,
    filters: dict[str, Any],
) -> DataFrame:
    filters = {k: v for k, v in filters.items() if k not in ("sort_by", "sort_order")}
    limit = filters.pop("limit", K.DEFAULT_LIMIT)
    offset = filters.pop("offset", 0)
    check_page(limit, offset)
    kept = filter_threads(threads, relations, **filters)
    pairs = actions.filter(condition).join(
        kept.select(
            "thread_id",
            F.col("title").alias("thread_title"),
            F.col("status").alias("thread_status"),
        ),
        "thread_id",
    )
    return page(pairs.orderBy(*action_order()), limit, offset)


def action_order() -> list[Column]:
    """Input order of actions: the thread's file name, then the position.

    Position alone decides when it is unique; the other columns make the order
    total where a source repeats it.
    """
    return [
        X.file_order(F.col("thread_id")),
        F.col("pos"),
        F.col("action_id"),
        F.col("description"),
        F.col("metadata"),
    ]


# --- result rows -------------------------------------------------------------

THREAD_FIELDS = (
    "thread_id",
    "title",
    "objective",
    "status",
    "revision",
    "context",
    "actions",
    "relations",
    "created_at",
    "updated_at",
    "started_at",
    "completed_at",
    "provenance",
)


def thread_json(columns: list[str]) -> Column:
    """One thread as canonical JSON.

    ``context`` and the values of ``provenance`` are stored as JSON text.
    ``actions`` and ``relations`` are part of the row only where the table keeps
    them nested, as corpus ingest does; they are never gathered here.
    """
    rendered = {
        "thread_id": X.json_string(F.col("thread_id")),
        "title": X.json_string(F.col("title")),
        "objective": X.json_string(F.col("objective")),
        "status": X.json_string(F.col("status")),
        "revision": X.json_number(F.col("revision")),
        "context": F.coalesce(F.col("context"), F.lit("{}")),
        "created_at": X.json_string(F.col("created_at")),
        "updated_at": X.json_string(F.col("updated_at")),
        "started_at": X.json_string(F.col("started_at")),
        "completed_at": X.json_string(F.col("completed_at")),
        "provenance": json_map(F.col("provenance")),
    }
    if "actions" in columns:
        rendered["actions"] = _json_list(F.transform("actions", action_json))
    if "relations" in columns:
        rendered["relations"] = _json_list(
            F.transform("relations", lambda r: r["raw"])
        )
    return X.json_object(rendered)


def action_json(a: Column) -> Column:
    return X.json_object(
        {
            "action_id": X.json_string(a["action_id"]),
            "description": X.json_string(a["description"]),
            "status": X.json_string(a["status"]),
            "metadata": F.coalesce(a["metadata"], F.lit("{}")),
        }
    )


def json_map(column: Column) -> Column:
    """Map of JSON values as a canonical JSON object."""
    entries = F.array_sort(F.map_entries(column))
    parts = F.transform(
        entries, lambda e: F.concat(X.json_string(e["key"]), F.lit(":"), e["value"])
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


def _json_list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("]"))


def thread_rows(threads: DataFrame) -> DataFrame:
    """Threads as result rows: id and JSON."""
    return threads.select("thread_id", thread_json(threads.columns).alias("data"))


def thread_action_rows(threads: DataFrame, actions: DataFrame) -> DataFrame:
    """(thread, action) pairs as result rows, one JSON object per pair."""
    action = F.struct("action_id", "description", F.col("action_status").alias("status"), "metadata")
    pairs = actions.withColumnRenamed("status", "action_status").join(
        threads, "thread_id"
    )
    return pairs.select(
        "thread_id",
        "pos",
        "action_id",
        X.json_object(
            {"action": action_json(action), "thread": thread_json(threads.columns)}
        ).alias("data"),
    )

"""Logged JSON requests: parsing and checks, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where, last_key_wins


def read_requests(spark, path: str) -> DataFrame:
    """A log of JSON lines; the request id is the digest of the line."""
    return spark.read.text(path).select(
        X.sha256(F.col("value")).alias("request_id"), F.col("value").alias("raw")
    )


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_object(value: Column) -> Column:
    return value.isNotNull() & F.startswith(_kind(value), F.lit("OBJECT"))


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def parse_requests(requests: DataFrame) -> DataFrame:
    """Envelope fields, filters and the first error of every request line.

    Input columns: ``request_id``, ``raw``.  Added: ``schema_version``,
    ``domain``, ``intent``, one column per known filter, ``error``.
    """
    body = F.try_parse_json("raw")
    parsed = last_key_wins(requests).withColumn("_v", body)
    request = F.try_variant_get(F.col("_v"), "$.request", "variant")
    parsed = parsed.withColumn("_r", request)
    filters = F.try_variant_get(F.col("_r"), "$.filters", "variant")
    parsed = parsed.withColumn("_f", filters)

    r, f = F.col("_r"), F.col("_f")
    has = F.coalesce(F.json_object_keys(F.get_json_object("raw", "$.request")), F.array())
    parsed = parsed.withColumn("_keys", has)
    parsed = parsed.withColumn(
        "_names", F.coalesce(F.json_object_keys(F.get_json_object("raw", "$.request.filters")), F.array())
    )
    missing = F.filter(
        F.array(*[F.lit(n) for n in K.REQUEST_FIELDS]),
        lambda n: ~F.array_contains("_keys", n),
    )
    top = F.coalesce(F.json_object_keys("raw"), F.array())
    # Filters set to null count as given but hold nothing, like a missing one.
    columns = {name: _text(f, f"$.{name}") for name in K.REQUEST_FILTERS}
    for name in ("statuses", "action_statuses"):
        columns[name] = F.coalesce(
            F.try_variant_get(f, f"$.{name}", "array<string>"), F.array().cast("array<string>")
        )
    columns["provenance"] = F.transform_values(
        F.try_variant_get(f, "$.provenance", "map<string,variant>"),
        lambda _, value: X.small_escapes(F.to_json(value)),
    )
    for name in ("limit", "offset"):
        columns[name] = F.try_variant_get(f, f"$.{name}", "int")
    columns["limit"] = F.coalesce(columns["limit"], F.lit(K.DEFAULT_LIMIT))
    columns["offset"] = F.coalesce(columns["offset"], F.lit(0))
    columns["sort_by"] = F.coalesce(columns["sort_by"], F.lit("updated_at"))
    columns["sort_order"] = F.coalesce(columns["sort_order"], F.lit("DESC"))
    parsed = parsed.select(
        "*",
        _text(r, "$.schema_version").alias("schema_version"),
        _text(r, "$.domain").alias("domain"),
        _text(r, "$.intent").alias("intent"),
        *[c.alias(n) for n, c in columns.items()],
    )

    envelope = X.first_error(
        (F.col("_v").isNull(), "INVALID_JSON"),
        (~_is_object(F.col("_v")), "NOT_AN_OBJECT"),
        (~F.array_contains(top, "request"), "REQUEST_MISSING"),
        (~_is_object(r), "REQUEST_NOT_AN_OBJECT"),
        (F.size(missing) > 0, F.concat(F.lit("FIELDS_MISSING: "), F.array_join(missing, ", "))),
        (
            F.array_contains("_keys", F.lit("filters")) & ~_is_object(f),
            "FILTERS_NOT_AN_OBJECT",
        ),
        (X.not_in(F.col("schema_version"), (K.REQUEST_SCHEMA,)), "UNSUPPORTED_SCHEMA"),
        (X.absent(F.col("domain")), "DOMAIN_EMPTY"),
        (X.absent(F.col("intent")), "INTENT_EMPTY"),
        (F.col("domain") != "THREAD", "UNSUPPORTED_DOMAIN"),
        (X.not_in(F.col("intent"), K.QUERY_TYPES), "UNSUPPORTED_INTENT"),
        (
            F.exists("_names", lambda n: ~n.isin(*K.REQUEST_FILTERS)),
            "UNKNOWN_FILTER",
        ),
    )
    query = query_error()
    # GET_THREAD never looks at the sort; action lists do not sort either.
    sorts = F.col("intent").isin("LIST_THREADS", "LIST_OPEN_THREADS", "LIST_THREADS_BY_STATUS")
    unknown_sort = F.when(sorts & ~F.col("sort_by").isin(*K.SORT_FIELDS), F.lit("UNKNOWN_SORT"))
    return parsed.withColumn("error", F.coalesce(envelope, query, unknown_sort)).drop(
        "_v", "_r", "_f", "_keys", "_names"
    )


def query_error() -> Column:
    """First contradiction among the arguments of a query."""
    return X.first_error(
        (F.col("limit") < 1, "LIMIT_TOO_SMALL"),
        (F.col("limit") > K.MAX_LIMIT, "LIMIT_TOO_LARGE"),
        (F.col("offset") < 0, "OFFSET_NEGATIVE"),
        (F.col("title").isNotNull() & X.is_blank(F.col("title")), "TITLE_EMPTY"),
        (
            F.col("title_contains").isNotNull() & X.is_blank(F.col("title_contains")),
            "TITLE_CONTAINS_EMPTY",
        ),
        ((F.col("intent") == "GET_THREAD") & X.absent(F.col("thread_id")), "THREAD_ID_REQUIRED"),
        (
            (F.col("intent") == "LIST_THREADS_BY_STATUS")
            & F.col("status").isNull()
            & (F.size("statuses") == 0),
            "STATUS_REQUIRED",
        ),
        (
            F.col("action_id").isNotNull() & X.absent(F.col("thread_id")),
            "THREAD_ID_REQUIRED_WITH_ACTION_ID",
        ),
    )


def request_rejects(requests: DataFrame) -> DataFrame:
    """Requests that cannot be answered, with the reason."""
    rejected = keep_where(parse_requests(requests), F.col("error").isNotNull())
    return rejected.select("request_id", "error")

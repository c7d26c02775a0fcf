"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.catalog import tables as B
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where
from recordloom.functions.sizing import ensure_checkpoint_dir, stable
from recordloom.operators import histories as H
from recordloom.operators import information as I
from recordloom.operators import lifecycle as L
from recordloom.operators import memories as M
from recordloom.operators import quality as Q
from recordloom.operators import relations as R
from recordloom.operators import request_batch as RB
from recordloom.operators import search as S
from recordloom.operators import stored as SN
from recordloom.operators import threads as T
from recordloom.operators.pages import RankIndex
from recordloom.plans import classify as C
from recordloom.plans import decisions as D
from recordloom.plans import execution as E
from recordloom.plans import routing as P
from recordloom.sources import corpora, sinks
from recordloom.sources import requests as RQ
from recordloom.streaming.dedupe import dedupe_stream
from recordloom.streaming.fold import CommandFold, closing_command
from recordloom.streaming.ingest import ingest_stream

NOW = "2025-01-01T00:00:00Z"
RECORD_SEPARATOR = "\x1e"
#: Bytes of text, and commands, that a task writes to one file of a stream's input.
FILE_BYTES, FILE_COMMANDS = 64_000_000, 500_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str) -> Column:
    return F.array_join(column, "; ").alias(column)


_HEAD = ("thread_id", "title", "status", "revision", "updated_at")

# --- thread queries ----------------------------------------------------------


@query
def list_open_threads(spark: SparkSession, sf: str) -> DataFrame:
    return T.list_open_threads(B.threads(spark, sf)).select(*_HEAD)


@query
def list_threads(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.list_threads(
        B.threads(spark, sf), sort_by="created_at", sort_order="ASC", limit=100, offset=25
    )
    return rows.select(*_HEAD, "created_at")


@query
def threads_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return T.list_threads_by_status(
        B.threads(spark, sf), status="TESTING", statuses=["PAUSED", "TESTING"], limit=500
    ).select(*_HEAD)


@query
def get_thread(spark: SparkSession, sf: str) -> DataFrame:
    return T.get_thread(B.threads(spark, sf), "thread-42").select(*_HEAD, "context", "objective")


@query
def threads_title_eq(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(B.threads(spark, sf), title="1-URGENT topic 500").select(*_HEAD)


@query
def threads_title_contains(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(B.threads(spark, sf), title_contains="LOW STRASSE 1").select(*_HEAD)


@query
def threads_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf), B.thread_relations(spark, sf), relation_type="SUPERSEDES"
    ).select("thread_id", "status")


@query
def threads_related_to(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf),
        B.thread_relations(spark, sf),
        related_to="thread-50",
        relation_type="PART_OF",
    ).select("thread_id", "status")


@query
def threads_by_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf), provenance={"state": "F", "rank": 3.0, "absent": None}
    ).select("thread_id", "title", F.element_at("provenance", "desk").alias("desk"))


@query
def threads_created_between(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf), created_after="1995-03-01", created_before="1995-06-01T00:00:00Z"
    ).select("thread_id", "created_at")


@query
def threads_updated_between(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf), updated_after="1996-12-24", updated_before="1997"
    ).select("thread_id", "updated_at")


@query
def threads_started_between(spark: SparkSession, sf: str) -> DataFrame:
    return T.filter_threads(
        B.threads(spark, sf),
        started_after="1998-02-01T00:00:00+02:00",
        started_before="1998-03-01T02:00:00+02:00",
        as_instants=True,
    ).select("thread_id", "started_at")


@query
def open_actions(spark: SparkSession, sf: str) -> DataFrame:
    return T.list_open_actions(
        B.threads(spark, sf),
        B.thread_actions(spark, sf),
        updated_after="1996",
        limit=300,
        offset=10,
    ).select("thread_id", "thread_title", "action_id", "description", "status")


@query
def thread_actions_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return T.list_thread_actions(
        B.threads(spark, sf),
        B.thread_actions(spark, sf),
        thread_id="thread-1",
        action_id="action-3",
        action_statuses=["BLOCKED", "CANCELLED"],
        limit=1000,
    ).select("thread_id", "thread_status", "action_id", "description", "status")


def _sorted(name: str, order: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = T.list_threads(
            B.threads(spark, sf), sort_by=name, sort_order=order, limit=200, offset=5
        )
        return rows.select("thread_id", "title", "status", "revision", "started_at")

    run.__name__ = f"threads_sorted_{name}"
    return query(run)


for _name, _order in (("title", "ASC"), ("revision", "DESC"), ("status", "DESC"), ("started_at", "ASC")):
    _sorted(_name, _order)


@query
def threads_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page four fifths down the list, from the rank index."""
    index = RankIndex.write(B.threads(spark, sf), f"{_scratch(spark)}/ranks", "title", "ASC")
    return index.page(300, index.size() * 4 // 5).select("rank", "thread_id", "title", "status")


@query
def thread_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.thread_rows(B.threads(spark, sf))


@query
def thread_action_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.thread_action_rows(B.threads(spark, sf), B.thread_actions(spark, sf)).select(
        "thread_id", "action_id", X.sha256(F.col("data")).alias("data_sha")
    )


# --- logged requests ---------------------------------------------------------


@query
def request_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return RQ.request_rejects(B.requests(spark, sf))


@query
def request_results(spark: SparkSession, sf: str) -> DataFrame:
    return RB.evaluate_requests(
        B.requests(spark, sf),
        B.threads(spark, sf),
        B.thread_relations(spark, sf),
        B.thread_actions(spark, sf),
    ).select("request_id", F.col("rank").cast("int").alias("rank"), "thread_id", "action_id")


@query
def request_results_broad(spark: SparkSession, sf: str) -> DataFrame:
    rows = RB.evaluate_requests(
        B.broad_requests(spark, sf), B.threads(spark, sf), B.thread_relations(spark, sf), B.thread_actions(spark, sf)
    )
    return rows.select("request_id", "rank", "thread_id")


@query
def request_responses(spark: SparkSession, sf: str) -> DataFrame:
    requests, threads = B.requests(spark, sf), B.threads(spark, sf)
    results = RB.evaluate_requests(
        requests, threads, B.thread_relations(spark, sf), B.thread_actions(spark, sf)
    )
    return RB.responses(requests, RB.result_rows(results, threads))


# --- memories ----------------------------------------------------------------


@query
def memories_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.list_memories(
        B.memories(spark, sf), {"lang": "en", "source": "src3"}, offset=3, limit=100
    )
    return rows.select("information_id", "revision", F.length("content").alias("length"))


@query
def memory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = B.memory_arrivals(spark, sf).select("information_id").distinct()
    return M.lookup(B.memories(spark, sf), keys).select(
        "information_id", "revision", F.col("revision").isNotNull().alias("found")
    )


@query
def existing_memories(spark: SparkSession, sf: str) -> DataFrame:
    return M.existing(B.memories(spark, sf), B.memory_arrivals(spark, sf)).select("seq", "information_id")


@query
def invalid_ids(spark: SparkSession, sf: str) -> DataFrame:
    return M.invalid_ids(B.memory_arrivals(spark, sf)).select("seq", "information_id")


@query
def term_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.term_search(B.memories(spark, sf), "content: Straße the of der que, of", limit=50)
    return rows.select("information_id", "matches", "score")


@query
def term_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    names = B.read(spark, sf, "part").select(F.col("p_name").alias("query")).distinct()
    asked = names.select(F.col("query").alias("query_id"), "query")
    return S.term_search_batch(B.memories(spark, sf), asked, limit=25)


@query
def term_search_passages(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return S.term_search_batch(B.memories(spark, sf), asked, limit=10)


@query
def memory_store(spark: SparkSession, sf: str) -> DataFrame:
    return M.store_batch(B.memories(spark, sf), B.memory_arrivals(spark, sf))[1]


@query
def memory_store_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    snapshot, _ = M.store_batch(B.memories(spark, sf), B.memory_arrivals(spark, sf))
    return snapshot.select("information_id", "revision", X.sha256(F.col("content")).alias("content_sha"))


@query
def memory_update(spark: SparkSession, sf: str) -> DataFrame:
    return M.update_batch(B.memories(spark, sf), B.memory_updates(spark, sf))[1]


@query
def memory_update_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    snapshot, _ = M.update_batch(B.memories(spark, sf), B.memory_updates(spark, sf))
    return snapshot.select("information_id", "revision", X.sha256(F.col("content")).alias("content_sha"))


@query
def delete_requests(spark: SparkSession, sf: str) -> DataFrame:
    return M.request_deletes(B.memories(spark, sf), B.delete_commands(spark, sf))[1]


@query
def delete_requests_on_file(spark: SparkSession, sf: str) -> DataFrame:
    return M.request_deletes(B.memories(spark, sf), B.delete_commands(spark, sf))[0]


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    memories = B.memories(spark, sf)
    pending, _ = M.request_deletes(memories, B.delete_commands(spark, sf))
    return M.decide_deletes(memories, pending, B.delete_decisions(spark, sf))


@query
def delete_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)[2]


@query
def memories_after_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)[0].select("information_id", "revision")


def _stored_memories(spark: SparkSession, sf: str) -> SN.StoredSnapshot:
    return SN.StoredSnapshot.create(B.memories(spark, sf), f"{_scratch(spark)}/memories", M.ID)


@query
def memory_store_by_parts(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_memories(spark, sf)
    SN.store_memories(stored, B.memory_arrivals(spark, sf))
    return stored.read().select("information_id", "revision", X.sha256(F.col("content")).alias("content_sha"))


@query
def memory_update_by_parts(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_memories(spark, sf)
    SN.update_memories(stored, B.memory_updates(spark, sf))
    return stored.read().select("information_id", "revision", X.sha256(F.col("content")).alias("content_sha"))


@query
def memory_deletes_by_parts(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_memories(spark, sf)
    pending, _ = M.request_deletes(stored.read(), B.delete_commands(spark, sf))
    SN.delete_memories(stored, stable(pending), B.delete_decisions(spark, sf))
    return stored.read().select("information_id", "revision")


# --- thread lifecycle --------------------------------------------------------


@query
def invalid_threads(spark: SparkSession, sf: str) -> DataFrame:
    return L.invalid_threads(B.threads(spark, sf), B.thread_actions(spark, sf)).select(
        "thread_id", "error", joined("errors")
    )


@query
def duplicate_actions(spark: SparkSession, sf: str) -> DataFrame:
    return L.duplicate_actions(B.thread_actions(spark, sf))


@query
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return L.illegal_transitions(B.threads(spark, sf), B.commands(spark, sf)).select(
        "seq", "thread_id", "from_status", "to_status", "error"
    )


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return L.apply_commands(
        B.threads(spark, sf), B.thread_actions(spark, sf), B.commands(spark, sf)
    )


@query
def command_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)[2].select("seq", "thread_id", "kind", "before_status", "outcome", "revision")


@query
def thread_snapshot_after_log(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)[0].select(
        "thread_id", "status", "revision", "updated_at", "started_at", "completed_at"
    )


@query
def thread_actions_after_log(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)[1].select("thread_id", "pos", "action_id", "description", "status")


@query
def status_change_events(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)[3].select(
        "event_id", "thread_id", "revision", "event_type", "before", "after", "timestamp"
    )


@query
def thread_upserts(spark: SparkSession, sf: str) -> DataFrame:
    return L.upsert_threads(*_thread_changes(spark, sf))[1]


@query
def threads_after_upserts(spark: SparkSession, sf: str) -> DataFrame:
    return L.upsert_threads(*_thread_changes(spark, sf))[0].select("thread_id", "title", "revision")


def _thread_changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A change per event, against a snapshot of id, title and revision."""
    e = B.read(spark, sf, "events")
    n = F.col("event_id")
    key = F.when(n % 3 == 0, F.col("user_id") + 10_000_000).otherwise(F.col("user_id"))
    changes = e.select(
        n.alias("seq"),
        F.when(n % 61 == 0, F.concat(F.lit("thread "), key)).otherwise(F.concat(F.lit("thread-"), key)).alias("thread_id"),
        F.when(F.col("event_type") == "signup", F.lit("CREATE"))
        .when(F.col("event_type") == "error", F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
        .alias("change"),
        F.concat(F.col("event_type"), F.lit(" "), n).alias("title"),
        (n % 9 + 1).cast("int").alias("revision"),
    )
    return B.threads(spark, sf).select("thread_id", "title", "revision"), changes


@query
def early_updates(spark: SparkSession, sf: str) -> DataFrame:
    return L.thread_invariants(B.threads(spark, sf))


@query
def reopened_actions(spark: SparkSession, sf: str) -> DataFrame:
    return H.reopened_actions(
        L.replay_commands(B.threads(spark, sf), B.thread_actions(spark, sf), B.commands(spark, sf))
    )


# --- information -------------------------------------------------------------


@query
def invalid_information(spark: SparkSession, sf: str) -> DataFrame:
    return I.invalid_information(B.information_texts(spark, sf)).select("path", "id", joined("errors"))


@query
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return I.missing_field_counts(B.information_texts(spark, sf))


@query
def semantic_report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.semantic_report(B.information_texts(spark, sf)).select(
        "path", joined("errors"), joined("warnings")
    )


@query
def semantic_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.error_counts(Q.semantic_report(B.information_texts(spark, sf)))


@query
def information_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpora.information_rows(corpora.parse_information(B.information_texts(spark, sf)))
    return rows.select(
        "id",
        F.col("revision.number").alias("number"),
        F.col("revision.is_revision").alias("is_revision"),
        F.col("revision.previous_revision").alias("previous_revision"),
        "type",
        "epistemic_status",
        F.col("context.project").alias("project"),
        F.col("provenance.source_type").alias("source_type"),
        F.col("time.created_at").alias("created_at"),
        F.try_element_at(F.col("relations.type"), F.lit(1)).alias("relation_type"),
        "retention",
        X.sha256(F.col("content")).alias("content_sha"),
    )


def _ingested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return I.ingest_information(B.information_arrivals(spark, sf), NOW)


@query
def ingested_information(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[0].select(
        "id",
        "type",
        "epistemic_status",
        "operational_state",
        F.col("context.mode").alias("mode"),
        F.col("provenance.source_type").alias("source_type"),
        X.sha256(F.col("content")).alias("content_sha"),
    )


@query
def created_events(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[1].select(
        "event_id", "information_id", "revision", "event_type", "after", "description"
    )


@query
def ingest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[2]


@query
def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[3]


def _manual(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return I.manual_updates(B.information(spark, sf), B.manual_updates(spark, sf), NOW)


@query
def manual_updates(spark: SparkSession, sf: str) -> DataFrame:
    return _manual(spark, sf)[2]


@query
def manual_update_events(spark: SparkSession, sf: str) -> DataFrame:
    return _manual(spark, sf)[1].select(
        "information_id",
        "revision",
        "before_epistemic_status",
        "after_epistemic_status",
        "before_operational_state",
        "after_operational_state",
        "before_importance",
        "after_importance",
        "description",
    )


@query
def information_after_updates(spark: SparkSession, sf: str) -> DataFrame:
    return _manual(spark, sf)[0].select(
        "id",
        F.col("revision.number").alias("number"),
        "epistemic_status",
        "operational_state",
        "confidence",
        "importance",
    )


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return I.resolve_reviews(
        B.reviews(spark, sf), B.information_under_review(spark, sf), B.review_decisions(spark, sf), NOW
    )


@query
def review_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[3].select("seq", "review_id", "decision", "outcome")


@query
def resolved_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[2].select("review_id", "information_id", "status", "decision", "resolver")


@query
def review_events(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[1].select("information_id", "revision", "event_type", "before", "after", "description")


@query
def pending_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return I.pending_reviews(B.reviews(spark, sf)).select("review_id", "information_id")


# --- relations ---------------------------------------------------------------


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return R.relation_checks(B.relation_proposals(spark, sf), B.information_and_memos(spark, sf))


def _related(spark: SparkSession, sf: str):
    return R.apply_relations(
        B.relation_proposals(spark, sf),
        B.information_and_memos(spark, sf),
        B.information_relations(spark, sf),
        NOW,
    )


@query
def relation_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select(
        "seq", "source_id", "type", "target_id", joined("errors"), joined("warnings")
    )


@query
def relation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[4]


@query
def applied_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[1]


@query
def relation_events(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[2].select(
        "event_id", "information_id", "revision", "before_revision", "description"
    )


@query
def relation_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[3].select(
        "review_id", "information_id", "target_information_id", "relation_type", "status"
    )


@query
def information_after_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[0].select("id", F.col("revision.number").alias("number"))


# --- classify, route, plan, decide, apply ------------------------------------


@query
def mechanism_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.classify(B.information_texts(spark, sf))
    return rows.select(
        "id",
        "type",
        *[F.col(f"mechanisms.{m}.status").alias(m.lower()) for m in C.K.MECHANISMS],
    )


@query
def mechanism_long(spark: SparkSession, sf: str) -> DataFrame:
    return C.mechanism_rows(C.classify(B.information_texts(spark, sf)))


@query
def revision_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return P.normalised_revisions(B.information_texts(spark, sf))


@query
def routing(spark: SparkSession, sf: str) -> DataFrame:
    return P.route(B.information_texts(spark, sf)).select(
        "information_id",
        joined("confirmed"),
        joined("possible"),
        joined("rejected"),
        "store_required",
        "update_required",
        "index_required",
        "ignore_required",
        "index_reason",
    )


def plan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored plan documents, one per document, with defects of every kind."""
    d = B.read(spark, sf, "documents")
    k = F.col("doc_id")
    kind = k % 20
    fields = [f for f in E.K.PLAN_INFORMATION_FIELDS if f not in ("identity", "classification")]
    other = F.lit(",".join(f'"{f}":{{}}' for f in fields if f != "retention"))
    op = lambda name, flag: F.concat(
        F.lit(f'"{name}":{{"required":'), flag, F.lit(f',"reason":"{name.lower()}"}}')
    )
    boolean = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    operations = F.concat(
        F.lit('"operations":'),
        F.when(kind == 12, F.lit("[]")).otherwise(
            F.concat(
                F.lit("{"),
                F.when(kind == 13, F.lit("")).otherwise(F.concat(op("STORE", boolean(k % 2 == 0)), F.lit(","))),
                F.when(kind == 14, F.lit('"UPDATE":true')).otherwise(op("UPDATE", boolean(k % 2 == 1))),
                F.lit(","),
                F.when(kind == 15, F.lit('"INDEX":{"reason":"x"}')).otherwise(op("INDEX", boolean(k % 3 == 0))),
                F.lit(","),
                F.when(kind == 16, F.lit('"IGNORE":{"required":false}')).otherwise(op("IGNORE", boolean(k % 7 == 0))),
                F.lit("}"),
            )
        ),
    )
    identity = (
        F.when(kind == 7, F.lit('"identity":"x"'))
        .when(kind == 8, F.lit('"identity":{"id":""}'))
        .when(kind == 9, F.concat(F.lit('"identity":{"id":"info-'), k, F.lit('","revision":3}')))
        .when(kind == 10, F.concat(F.lit('"identity":{"id":"info-'), k, F.lit('","revision":{"is_revision":true}}')))
        .otherwise(
            F.concat(
                F.lit('"identity":{"id":"info-'), k,
                F.lit('","revision":{"number":'), k % 5,
                F.lit(',"is_revision":'), boolean(k % 3 > 0),
                F.lit(',"previous_revision":'), F.when(k % 4 == 0, F.lit("null")).otherwise((k % 5 - 1).cast("string")),
                F.lit("}}"),
            )
        )
    )
    classification = F.when(kind == 11, F.lit('"classification":[]')).otherwise(F.lit('"classification":{}'))
    retention = F.when(kind == 6, F.lit("")).otherwise(F.lit(',"retention":"NORMAL"'))
    schema = (
        F.when(kind == 3, F.lit('"0.1"')).when(kind == 4, F.lit("2")).otherwise(F.lit('"0.2"'))
    )
    body = F.concat(
        F.lit('{"memory_plan":{"schema_version":'), schema,
        F.lit(',"mechanisms":{"confirmed":["EPISODIC"],"possible":[],"rejected":[]},"information":'),
        F.when(kind == 5, F.lit("null")).otherwise(
            F.concat(F.lit("{"), identity, F.lit(","), classification, F.lit(","), other, retention, F.lit("}"))
        ),
        F.lit(","), operations, F.lit("}}"),
    )
    document = (
        F.when(kind == 0, F.concat(F.lit("{oops "), k))
        .when(kind == 1, F.concat(F.lit('{"plan":'), k, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"memory_plan":'), k, F.lit("}")))
        .otherwise(body)
    )
    return d.select(k.alias("plan_id"), document.alias("document"))


def execution_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored execution plans with defects of every kind."""
    d = B.read(spark, sf, "documents")
    k = F.col("doc_id")
    kind = k % 12
    part = lambda bad, broken, good: F.when(kind == bad, F.lit(broken)).otherwise(good)
    body = F.concat(
        F.lit('{"execution_plan":{"schema_version":'), part(2, "null", F.lit('"0.3"')),
        F.lit(',"operation_id":'), part(3, '""', F.concat(F.lit('"op-'), k, F.lit('"'))),
        F.lit(',"input":'),
        part(
            4,
            "[]",
            F.concat(
                F.lit('{"information_id":'), part(5, "7", F.concat(F.lit('"info-'), k, F.lit('"'))),
                F.lit(',"revision":'), part(6, "1", F.lit('{"number":1}')),
                F.lit("}"),
            ),
        ),
        F.lit(',"operations":'),
        part(7, "null", F.concat(F.lit('{"STORE":{},"UPDATE":{},'), part(8, "", F.lit('"INDEX":{},')), part(9, '"OTHER":{}', F.lit('"IGNORE":{}')), F.lit("}"))),
        F.lit("}}"),
    )
    document = (
        F.when(kind == 0, F.concat(F.lit("["), k, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"execution_plan":"'), k, F.lit('"}')))
        .otherwise(body)
    )
    return d.select(k.alias("plan_id"), document.alias("document"))


@query
def plan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return E.plan_rejects(plan_documents(spark, sf))


@query
def execution_plan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return E.execution_plan_rejects(execution_documents(spark, sf))


@query
def prepared_operations(spark: SparkSession, sf: str) -> DataFrame:
    return E.prepare_operations(E.read_plans(plan_documents(spark, sf))).select(
        "plan_id", "store_status", "update_status", "index_status", "ignore_status", "update_reason"
    )


@query
def contradictory_plans(spark: SparkSession, sf: str) -> DataFrame:
    return E.contradictory_plans(E.read_plans(plan_documents(spark, sf))).select(
        "plan_id", "store_required", "update_required", "index_required"
    )


@query
def operation_ids(spark: SparkSession, sf: str) -> DataFrame:
    plans = keep_where(P.route(B.information_texts(spark, sf)), F.col("error").isNull())
    return E.with_operation_id(plans).select("information_id", "operation_id")


def _executions(spark: SparkSession, sf: str) -> DataFrame:
    plans = keep_where(P.route(B.information_texts(spark, sf)), F.col("error").isNull())
    return E.execution_plans(plans)


@query
def execution_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _executions(spark, sf).select(
        "information_id", "operation_id", "store_status", "update_status", "index_status", "execution_plan_hash"
    )


def _short_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Execution plans with a batch order, kept as the log of plans they would be:
    the ledger and the decisions both read it."""
    plans = _executions(spark, sf)
    return stable(
        plans.withColumn("seq", F.regexp_extract("information_id", r"(\d+)", 1).cast("long"))
    )


def _ledger(plans: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Operations on file: French records were executed as planned, German ones
    under another plan; every operation is on file twice."""
    docs = B.read(spark, sf, "documents").select(
        F.concat(F.lit("info-"), "doc_id").alias("information_id"), "lang"
    )
    return (
        plans.select("information_id", "operation_id", "execution_plan_hash")
        .join(docs.filter(F.col("lang").isin("fr", "de")), "information_id")
        .select(
            "operation_id",
            F.when(F.col("lang") == "fr", F.col("execution_plan_hash")).otherwise(F.lit("0")).alias("execution_plan_hash"),
            F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
        )
        .drop("copy")
    )


def _persistent(spark: SparkSession, sf: str) -> DataFrame:
    """Persistent records: those with a label; every second one is a revision behind."""
    texts = B.information_texts(spark, sf)
    labels = B.read(spark, sf, "labels").select(
        F.concat(F.lit("working/info-"), "doc_id", F.lit(".md")).alias("path"), "doc_id"
    )
    old = F.regexp_replace(
        "text", r"(?m)\A(---\nid: info-\d+\nrevision:\n  number: )\d+", F.concat(F.lit("$1"), F.col("doc_id") % 4)
    )
    return texts.join(labels, "path").select(
        F.concat(F.lit("persistent/info-"), "doc_id", F.lit(".md")).alias("path"),
        F.when(F.col("doc_id") % 4 != 2, old).otherwise(F.col("text")).alias("text"),
    )


def _decided_plans(spark: SparkSession, sf: str) -> DataFrame:
    plans = _short_plans(spark, sf)
    return D.decide(plans, _ledger(plans, spark, sf), _persistent(spark, sf))


def _applied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return D.apply_plans(
        _decided_plans(spark, sf), B.information_texts(spark, sf), _persistent(spark, sf), NOW
    )


@query
def idempotency_states(spark: SparkSession, sf: str) -> DataFrame:
    plans = _short_plans(spark, sf)
    return D.idempotency(plans, _ledger(plans, spark, sf)).select("information_id", "idempotency")


@query
def plan_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided_plans(spark, sf).select(
        "information_id", "idempotency", "decision", "decision_reason"
    )


@query
def applied_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf)[3].select("seq", "information_id", "result", "code")


@query
def plan_events(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf)[1].select(
        "information_id", "revision", "event_type", "after", "cause_type", "description"
    )


@query
def ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf)[2].select("information_id", "result", "status", "operation_id", "execution_plan_hash")


def _ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger files, one per customer; some are broken, misnamed or no object."""
    c = B.read(spark, sf, "customer")
    k = F.col("c_custkey")
    operation = F.concat(F.lit("op-"), k)
    value = X.json_object(
        {
            "operation_id": X.json_string(F.when(k % 11 == 3, F.concat(operation, F.lit("x"))).otherwise(operation)),
            "execution_plan_hash": X.json_string(X.sha256(F.col("c_name"))),
            "information_id": X.json_string(F.concat(F.lit("info-"), k)),
            "result": X.json_string(F.when(k % 2 == 0, "STORE").otherwise("UPDATE")),
            "status": X.json_string(F.lit("EXECUTED")),
            "timestamp": X.json_string(F.lit(NOW)),
        }
    )
    broken = F.when(k % 11 == 5, F.substring(value, F.lit(1), F.length(value) - 1)).when(k % 11 == 7, F.lit("[]"))
    return c.select(F.concat(operation, F.lit(".json")).alias("file"), F.coalesce(broken, value).alias("value"))


@query
def ledger_scan(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = corpora.parse_operations(_ledger_files(spark, sf))
    return good.select(
        F.concat("operation_id", F.lit(".json")).alias("file"),
        "information_id",
        "result",
        "execution_plan_hash",
        F.lit(None).cast("string").alias("error"),
    ).unionByName(bad, allowMissingColumns=True)


@query
def ledger_written(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as read back after it was written twice."""
    rows, path = stable(_applied(spark, sf)[2]), f"{_scratch(spark)}/ledger"
    for _ in range(2):
        sinks.append_operations(rows, path)
    return spark.read.parquet(path).select("information_id", "result", "status", "operation_id", "execution_plan_hash")


@query
def events_written(spark: SparkSession, sf: str) -> DataFrame:
    """The history as read back after it was written twice."""
    rows, path = stable(_applied(spark, sf)[1]), f"{_scratch(spark)}/events"
    for _ in range(2):
        sinks.append_events(rows, path)
    return spark.read.parquet(path).select("information_id", "revision", "event_type", "after", "cause_type", "description")


@query
def persistent_after_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf)[0].select("path", X.sha256(F.col("text")).alias("text_sha"))


@query
def index_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return D.index_outcomes(_applied(spark, sf)[3])


# --- corpora and streams ------------------------------------------------------


@query
def corpus_threads(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.parse_threads(B.thread_texts(spark, sf)).select(
        "path",
        "parse_error",
        "thread_id",
        "title",
        "objective",
        "status",
        "revision",
        "context",
        F.array_join(F.col("actions.status"), ",").alias("action_statuses"),
        F.array_join(F.col("relations.target_id"), ",").alias("targets"),
        "created_at",
        "started_at",
        F.element_at("provenance", "source").alias("source"),
    )


@query
def corpus_memories(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.parse_memories(B.memory_texts(spark, sf)).select(
        "path",
        "parse_error",
        "information_id",
        "revision",
        X.sha256(F.col("content")).alias("content_sha"),
        T.json_map(F.col("metadata")).alias("metadata"),
        "relations",
        "verification",
    )


def _scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = B.read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def stream_command_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    fold = CommandFold(spark, _scratch(spark))
    commands = B.commands_of(_event_stream(spark, sf))
    fold.start(commands, B.threads(spark, sf), B.thread_actions(spark, sf)).awaitTermination()
    return fold.outcomes().select("seq", "thread_id", "kind", "before_status", "outcome", "revision")


@query
def stream_shuffled_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The log delivered in any order, in two pieces: outcomes are those of the sorted log."""
    root = _scratch(spark)
    commands = B.commands_of(B.read(spark, sf, "events"))
    size, last = commands.agg(F.count(F.lit(1)), F.max("seq")).first()
    files = 2 * max(1, math.ceil(size / 2 / FILE_COMMANDS))
    commands.repartition(files, F.xxhash64("seq")).write.parquet(f"{root}/in")
    closing_command(spark, last or 0, size).write.mode("append").parquet(f"{root}/in")
    arriving = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{root}/in")
    fold = CommandFold(spark, root)
    fold.start(arriving, B.threads(spark, sf), B.thread_actions(spark, sf), delay=size).awaitTermination()
    return fold.outcomes().select("seq", "thread_id", "kind", "before_status", "outcome", "revision")


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Memories ingested from text files of a bounded size, in two micro-batches."""
    root = _scratch(spark)
    texts = B.memory_texts(spark, sf).select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(4, math.ceil(size / FILE_BYTES))
    texts.repartition(files).write.option("lineSep", RECORD_SEPARATOR).text(f"{root}/in")
    ingest_stream(
        spark, "memories", f"{root}/in", f"{root}/rows", f"{root}/checkpoint", math.ceil(files / 2), RECORD_SEPARATOR
    ).awaitTermination()
    good = spark.read.parquet(f"{root}/rows").select(
        "information_id", "revision", X.sha256(F.col("content")).alias("content_sha")
    )
    rejects = spark.read.parquet(f"{root}/rows_rejects").groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(
        rejects.select(
            F.col("parse_error").alias("information_id"),
            F.col("n").cast("int").alias("revision"),
            F.lit(None).cast("string").alias("content_sha"),
        )
    )


@query
def stream_idempotency(spark: SparkSession, sf: str) -> DataFrame:
    root = _scratch(spark)
    plans = _event_stream(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("op-"), F.col("event_id") % 700).alias("operation_id"),
        X.sha256(F.col("event_type")).alias("execution_plan_hash"),
    )
    ledger = B.read(spark, sf, "customer").select(
        F.concat(F.lit("op-"), F.col("c_custkey") * 7).alias("operation_id"),
        X.sha256(F.lit("click")).alias("execution_plan_hash"),
    )
    dedupe_stream(spark, plans, ledger, f"{root}/judged", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/judged").select(
        "operation_id", "execution_plan_hash", "idempotency"
    )


# --- reports from the written specification ----------------------------------


@query
def valid_at(spark: SparkSession, sf: str) -> DataFrame:
    return H.valid_at(B.information(spark, sf), "2025-03-01T12:00:00Z").select("id", "type")


@query
def stale(spark: SparkSession, sf: str) -> DataFrame:
    return H.stale(B.information(spark, sf), NOW).select("id", F.col("time.valid_until").alias("valid_until"))


@query
def superseded_view(spark: SparkSession, sf: str) -> DataFrame:
    return H.supersession_view(B.information(spark, sf), B.information_relations(spark, sf))


@query
def valid_at_moments(spark: SparkSession, sf: str) -> DataFrame:
    days = F.make_dt_interval((F.col("c_custkey") % 97 * 9).cast("int"))
    moments = B.read(spark, sf, "customer").select((F.lit("2023-06-01T12:00:00").cast("timestamp") + days).alias("moment"))
    found = H.valid_at_moments(B.information(spark, sf), moments)
    return found.select(F.date_format("moment", "yyyy-MM-dd HH:mm").alias("moment"), "id")


@query
def active_successors(spark: SparkSession, sf: str) -> DataFrame:
    return H.successors(B.information(spark, sf), B.supersessions(spark, sf))


@query
def open_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return H.open_contradictions(B.information(spark, sf), B.information_relations(spark, sf))


@query
def history_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return H.history_gaps(B.history_events(spark, sf))


@query
def states_at_moments(spark: SparkSession, sf: str) -> DataFrame:
    found = H.states_at(B.history_events(spark, sf), B.state_moments(spark, sf))
    return found.withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def revision_gaps(spark: SparkSession, sf: str) -> DataFrame:
    entities = B.memories(spark, sf).select(
        F.col("information_id").alias("entity_id"), "revision"
    )
    return H.revision_gaps(B.history_events(spark, sf), entities)


@query
def epistemic_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return H.epistemic_gaps(B.history_events(spark, sf))


@query
def evidence_links(spark: SparkSession, sf: str) -> DataFrame:
    return H.evidence_links(B.information(spark, sf))

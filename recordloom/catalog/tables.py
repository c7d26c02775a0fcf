"""Record tables derived from the given test tables.

The test data has no threads, memories or information records, so each logical
table is a whole-table projection of a given one.  Remainders of keys only
choose values (a status, a defect); no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.sizing import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their whole text."""
    return spread(read(spark, sf_dir, "documents"))


def pick(values: tuple[str, ...] | list[str], index: Column) -> Column:
    """The value at a zero-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- threads -----------------------------------------------------------------


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = pick(K.THREAD_STATUSES, k % 8)
    created = F.col("o_orderdate")
    updated = F.timestamp_add("DAY", F.when(k % 89 == 0, F.lit(-1)).otherwise((k % 30).cast("int")), created)
    topic = F.when(k % 7 == 0, F.lit(" Straße ")).otherwise(F.lit(" topic "))
    return o.select(
        F.concat(F.lit("thread-"), k).alias("thread_id"),
        F.when(k % 97 == 0, F.lit("  "))
        .otherwise(F.concat("o_orderpriority", topic, F.pmod(k, F.lit(1000))))
        .alias("title"),
        F.concat(F.lit("Settle order "), k).alias("objective"),
        status.alias("status"),
        F.when(k % 101 == 0, F.lit(0)).otherwise((k % 5 + 1).cast("int")).alias("revision"),
        X.json_object({"price": F.floor("o_totalprice").cast("string")}).alias("context"),
        iso(created).alias("created_at"),
        iso(updated).alias("updated_at"),
        F.when(
            ~status.isin("PROPOSED", "VALIDATED"),
            iso(F.timestamp_add("DAY", F.lit(1), created)),
        ).alias("started_at"),
        F.when((k % 103 == 0) != (status == "COMPLETED"), iso(updated)).alias("completed_at"),
        F.create_map(
            F.lit("desk"),
            X.json_string(F.concat(F.lit("desk-"), F.col("o_custkey") % 25)),
            F.lit("state"),
            X.json_string(F.col("o_orderstatus")),
            F.lit("rank"),
            (F.col("o_custkey") % 5).cast("string"),
        ).alias("provenance"),
    )


def thread_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("thread-"), F.col("l_orderkey")).alias("thread_id"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_partkey") % 307 == 0, F.lit(""))
        .when(F.col("l_partkey") % 101 == 0, F.lit("action-1"))
        .otherwise(F.concat(F.lit("action-"), F.col("l_linenumber")))
        .alias("action_id"),
        F.when(F.col("l_partkey") % 211 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("part "), "l_partkey", F.lit(" from "), "l_suppkey"))
        .alias("description"),
        pick(K.ACTION_STATUSES, F.col("l_partkey") % 5).alias("status"),
        X.json_object(
            {"quantity": F.col("l_quantity").cast("int").cast("string")}
        ).alias("metadata"),
    )


def thread_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    here = F.concat(F.lit("thread-"), k)
    links = F.array(
        F.struct(
            F.lit(0).alias("pos"),
            pick(K.RELATION_TYPES, c % 10).alias("type"),
            F.concat(F.lit("thread-"), k + 1).alias("target_id"),
        ),
        F.struct(
            F.lit(1).alias("pos"),
            pick(K.RELATION_TYPES, k % 10).alias("type"),
            F.concat(F.lit("thread-"), c).alias("target_id"),
        ),
    )
    return o.select(here.alias("thread_id"), F.explode(links).alias("r")).select(
        "thread_id",
        F.col("r.pos").alias("pos"),
        F.col("r.type").alias("type"),
        F.col("thread_id").alias("source_id"),
        F.col("r.target_id").alias("target_id"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered thread commands, one per event."""
    return commands_of(read(spark, sf_dir, "events"))


def commands_of(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "purchase", F.lit("ADD_ACTION"))
        .when(F.col("event_type") == "error", F.lit("SET_ACTION_STATUS"))
        .otherwise(F.lit("SET_STATUS"))
    )
    target = (
        F.when(n % 37 == 0, F.lit("CANCELLED"))
        .when(n % 31 == 0, F.lit("COMPLETED"))
        .when(n % 41 == 0, F.lit("ARCHIVED"))
        .otherwise(pick(("VALIDATED", "IMPLEMENTATION", "TESTING", "PAUSED", "BLOCKED"), n % 5))
    )
    action = F.when(kind != "SET_STATUS", F.concat(F.lit("action-"), n % 40))
    return e.select(
        F.concat(F.lit("thread-"), F.col("user_id")).alias("thread_id"),
        n.alias("seq"),
        iso(F.col("ts")).alias("at"),
        kind.alias("kind"),
        F.when(kind == "SET_STATUS", target)
        .otherwise(pick(K.ACTION_STATUSES, n % 5))
        .alias("status"),
        F.when((kind == "ADD_ACTION") & (n % 29 == 0), F.lit("")).otherwise(action).alias("action_id"),
        F.when(kind == "ADD_ACTION", F.concat(F.lit("value "), F.col("value").cast("int"))).alias("description"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON request lines: one per customer, asking for its own threads."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tid = F.concat(F.lit('"thread-'), k, F.lit('"'))

    def request(intent: str, *filters: Column | str) -> Column:
        parts = [f if isinstance(f, Column) else F.lit(f) for f in filters]
        return F.concat(
            F.lit('{"request":{"schema_version":"0.1","domain":"THREAD","intent":"%s","filters":{' % intent),
            *parts,
            F.lit("}}}"),
        )

    variants = [
        request("GET_THREAD", '"thread_id":', tid),
        request("LIST_THREADS", '"related_to":', tid, ',"sort_by":"title","sort_order":"ASC"'),
        request("LIST_OPEN_THREADS", '"related_to":', tid, ',"limit":3'),
        request(
            "LIST_THREADS_BY_STATUS",
            '"status":"TESTING","statuses":["PAUSED","TESTING"],"related_to":',
            tid,
            ',"sort_by":"revision"',
        ),
        request("LIST_OPEN_ACTIONS", '"related_to":', tid, ',"offset":1,"limit":5'),
        request("LIST_THREADS", '"created_after":"1995","related_to":', tid, ',"offset":1,"limit":2'),
        request("LIST_THREAD_ACTIONS", '"action_status":"PLANNED","related_to":', tid),
        # defects
        F.concat(F.lit("{not json "), k),
        F.concat(F.lit("["), k, F.lit("]")),
        F.concat(F.lit('{"query":'), k, F.lit("}")),
        F.concat(F.lit('{"request":'), k, F.lit("}")),
        F.concat(F.lit('{"request":{"domain":"THREAD","n":'), k, F.lit("}}")),
        F.concat(
            F.lit('{"request":{"schema_version":"0.1","domain":"THREAD","intent":"LIST_THREADS","filters":['),
            k,
            F.lit("]}}"),
        ),
        F.concat(F.lit('{"request":{"schema_version":"0.2","domain":"THREAD","intent":"GET_THREAD","n":'), k, F.lit("}}")),
        F.concat(F.lit('{"request":{"schema_version":"0.1","domain":"","intent":"GET_THREAD","n":'), k, F.lit("}}")),
        F.concat(F.lit('{"request":{"schema_version":"0.1","domain":"THREAD","intent":"","n":'), k, F.lit("}}")),
        F.concat(F.lit('{"request":{"schema_version":"0.1","domain":"MEMORY","intent":"LIST_THREADS","n":'), k, F.lit("}}")),
        request("DROP_THREAD", '"thread_id":', tid),
        request("GET_THREAD", '"limit":10'),
        request("LIST_THREADS", '"limit":0,"related_to":', tid),
        request("LIST_THREADS", '"limit":1001,"related_to":', tid),
        request("LIST_THREADS", '"offset":-1,"related_to":', tid),
        request("LIST_THREADS", '"title":"  ","related_to":', tid),
        request("LIST_THREADS", '"title_contains":"","related_to":', tid),
        request("LIST_THREADS_BY_STATUS", '"related_to":', tid),
        request("LIST_THREAD_ACTIONS", '"action_id":"action-1","related_to":', tid),
        request("LIST_THREADS", '"colour":"red","related_to":', tid),
        request("LIST_THREADS", '"sort_by":"UPDATED_AT","related_to":', tid),
    ]
    position = k % len(variants)
    raw = F.lit(None).cast("string")
    for index, variant in reversed(list(enumerate(variants))):
        raw = F.when(position == index, variant).otherwise(raw)
    return c.select(k.alias("request_id"), raw.alias("raw"))


def broad_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests without a key, one per nation: every sort in both directions."""
    n = F.col("n_nationkey")
    sorts = ("created_at", "updated_at", "started_at", "title", "status", "revision")
    filters = F.concat(
        F.lit('"sort_by":"'), pick(sorts, n % 6), F.lit('","sort_order":"'), F.when(n % 4 < 2, "ASC").otherwise("DESC"),
        F.lit('","limit":'), n + 1, F.lit(',"offset":'), n * 3,
    )
    intent = pick(("LIST_THREADS", "LIST_OPEN_THREADS", "LIST_THREADS_BY_STATUS"), F.least(F.floor(n / 8).cast("int"), F.lit(2)))
    state = F.when(n >= 16, '"status":"TESTING",').otherwise("")
    old = F.when(n == 5, ',"created_before":"1996"').otherwise("")
    return read(spark, sf_dir, "nation").select(
        n.cast("long").alias("request_id"),
        F.concat(
            F.lit('{"request":{"schema_version":"0.1","domain":"THREAD","intent":"'), intent, F.lit('","filters":{'), state, filters, old, F.lit("}}}")
        ).alias("raw"),
    )


# --- memories ----------------------------------------------------------------


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        F.concat(F.lit("info-"), "doc_id").alias("information_id"),
        (F.col("doc_id") % 4 + 1).cast("int").alias("revision"),
        F.col("text").alias("content"),
        F.create_map(
            F.lit("lang"),
            X.json_string(F.col("lang")),
            F.lit("source"),
            X.json_string(F.col("source")),
            F.lit("size"),
            F.col("n_chars").cast("string"),
        ).alias("metadata"),
        X.json_object({"source": X.json_string(F.col("source"))}).alias("provenance"),
        F.lit("{}").alias("temporal"),
        F.lit("{}").alias("verification"),
        F.lit("[]").alias("relations"),
    )


def memory_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories to store, from conversation turns: repeats, bad ids and revisions."""
    c = read(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 40 + F.col("turn")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "system", F.concat(F.lit("chat "), "conv_id"))
        .when(F.col("role") == "user", F.concat(F.lit("info-"), number))
        .otherwise(F.concat(F.lit("chat-"), "conv_id"))
        .alias("information_id"),
        F.when(F.length("text") % 11 == 0, F.lit(0)).otherwise(F.lit(1)).alias("revision"),
        F.col("text").alias("content"),
        F.create_map(F.lit("role"), X.json_string(F.col("role"))).alias("metadata"),
        F.lit("{}").alias("provenance"),
        F.lit("{}").alias("temporal"),
        F.lit("{}").alias("verification"),
        F.lit("[]").alias("relations"),
    )


def memory_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimistic updates, several per memory, from the event log."""
    e = read(spark, sf_dir, "events")
    k, n = F.col("user_id"), F.col("event_id")
    return e.select(
        n.alias("seq"),
        F.concat(F.lit("info-"), F.when(n % 53 == 0, k + 1000000).otherwise(k)).alias("information_id"),
        F.concat(F.lit("info-"), F.when(n % 47 == 0, k + 1).otherwise(F.when(n % 53 == 0, k + 1000000).otherwise(k))).alias("new_information_id"),
        F.concat(F.col("event_type"), F.lit(" "), n).alias("content"),
        (F.col("value").cast("int") % 6 + 1).alias("previous_revision"),
    )


def delete_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests from labelled documents, two rounds each."""
    lb = read(spark, sf_dir, "labels")
    d = F.col("doc_id")
    asked = F.array(*[F.struct(F.lit(i).alias("round"), F.lit(r).alias("reason")) for i, r in enumerate(("quality", "toxic"))])
    return lb.select("doc_id", "quality", "toxic", F.explode(asked).alias("a")).select(
        (d * 2 + F.col("a.round")).alias("seq"),
        F.concat(F.lit("info-"), F.when(F.col("toxic") == 1, d + 1000000).otherwise(d)).alias("information_id"),
        F.lit("curator").alias("requested_by"),
        F.col("a.reason").alias("reason"),
        F.when(F.col("a.reason") == "quality", (d % 4 + 1)).otherwise(d % 3 + 1).cast("int").alias("revision"),
        F.concat(F.lit("op-"), d, F.lit("-"), F.col("a.round")).alias("operation_id"),
    )


def delete_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals and cancellations: two per document."""
    doc = read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    rounds = F.array(F.lit(0), F.lit(1))
    return doc.select("doc_id", F.explode(rounds).alias("round")).select(
        (d * 2 + F.col("round")).alias("seq"),
        F.concat(F.lit("info-"), d).alias("information_id"),
        F.concat(F.lit("op-"), d, F.lit("-"), F.when(d % 5 == 0, F.lit(1)).otherwise(F.lit(0))).alias("operation_id"),
        F.when((d + F.col("round")) % 3 == 0, F.lit("CANCEL")).otherwise(F.lit("APPROVE")).alias("decision"),
    )


def thread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as record files: two actions, a relation, some defects."""
    keys = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("thread-"), "o_orderkey").alias("thread_id"),
        F.col("o_orderkey").alias("k"),
        "o_custkey",
    )
    t = threads(spark, sf_dir).join(keys, "thread_id")
    k = F.col("k")
    kind = k % 17
    action = lambda i, status: F.concat(
        F.lit(f'{{"action_id": "a{i}", "description": "step {i}", "status": "'), status, F.lit('"}')
    )
    actions = (
        F.when(kind == 1, F.lit("{}"))
        .when(kind == 2, F.lit("[1]"))
        .when(kind == 3, F.lit('[{"action_id": "a1"}]'))
        .when(kind == 4, F.lit("[oops"))
        .otherwise(
            F.concat(
                F.lit("["), action(1, pick(K.ACTION_STATUSES, k % 5)),
                F.lit(", "), action(2, F.lit("PLANNED")), F.lit("]"),
            )
        )
    )
    temporal = F.concat(
        F.lit('{"created_at": '), F.when(kind == 8, F.lit("null")).otherwise(X.json_string(F.col("created_at"))),
        F.lit(', "updated_at": '), X.json_string(F.col("updated_at")),
        F.lit(', "started_at": '), X.json_string(F.col("started_at")), F.lit("}"),
    )
    text = F.concat(
        F.lit("# Thread Object\n\nVersion: 0.1\n\n---\n\n## Identity\n\nthread_id: "), "thread_id",
        F.lit("\nrevision: "), F.when(kind == 5, F.lit("x")).otherwise(F.col("revision").cast("string")),
        F.lit("\ntitle: "), "title",
        F.lit("\nstatus: "), F.when(kind == 6, F.lit("ASLEEP")).otherwise(F.col("status")),
        F.lit("\n\n---\n\n## Objective\n\n"), "objective", F.lit("\n\n"),
        F.when(kind == 7, F.lit("")).otherwise(_block("Context", F.col("context"))),
        _block("Actions", actions),
        _block("Relations", F.concat(F.lit('[{"type": "PART_OF", "target_id": "thread-'), "o_custkey", F.lit('"}]'))),
        _block("Temporal", temporal),
        _block("Provenance", F.lit('{"source": "import", "rank": 1}')),
    )
    return t.select(F.concat(F.lit("threads/"), "thread_id", F.lit(".md")).alias("path"), text.alias("text"))


def _block(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"---\n\n## {name}\n\n```json\n"), body, F.lit("\n```\n\n"))


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as record files; some have no revision or a broken section."""
    d = documents(spark, sf_dir)
    k = F.col("doc_id")
    metadata = F.concat(F.lit('{"source": "'), "source", F.lit('", "lang": "'), "lang", F.lit('"}'))
    text = F.concat(
        F.lit("# Information Object\n\nVersion: 0.1\n\n---\n\n## Identity\n\nid: info-"), k,
        F.when(k % 13 == 5, F.lit("")).otherwise(F.concat(F.lit("\nrevision: "), k % 4 + 1)),
        F.lit("\n\n---\n\n## Content\n\n"), "text", F.lit("\n\n"),
        _block("Metadata", metadata),
        F.when(k % 13 == 6, _block("Provenance", F.lit("{broken"))).otherwise(F.lit("")),
        _block("Relations", F.lit("[]")),
    )
    return d.select(F.concat(F.lit("memories/info-"), k, F.lit(".md")).alias("path"), text.alias("text"))


# --- information -------------------------------------------------------------

_TEXT_RELATIONS = K.RELATION_TYPES + ("REQUIRES", "CONCERNS")


def information_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values shared by the record table and the record texts."""
    d = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.concat(F.lit("info-"), k).alias("id"),
        (k % 4 + 1).cast("int").alias("number"),
        (k % 3 == 0).alias("structured"),
        ((k % 3 == 0) & (k % 5 != 0)).alias("is_revision"),
        F.when((k % 3 == 0) & (k % 12 != 0), (k % 4).cast("int")).alias("previous"),
        F.when(k % 23 == 0, F.lit("MEASUREMENT")).otherwise(pick(K.INFORMATION_TYPES, k % 12)).alias("type"),
        F.when(F.col("quality").isNull(), F.lit("UNVERIFIED"))
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("CONFIRMED"))
        .when(F.col("quality") == 1, F.lit("CONFLICTED"))
        .when(F.col("toxic") == 0, F.lit("REFUTED"))
        .otherwise(F.lit("DOUBTFUL"))
        .alias("epistemic_status"),
        F.when(F.col("n_chars") % 50 == 0, F.lit("LOST"))
        .otherwise(pick(K.OPERATIONAL_STATES, k % 6))
        .alias("operational_state"),
        "source",
        "lang",
        F.when(k % 19 == 0, F.lit("RUMOUR")).otherwise(pick(K.SOURCE_TYPES, k % 10)).alias("source_type"),
        iso(F.timestamp_add("DAY", (k % 700).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("created_at"),
        F.when(k % 14 < 12, pick(_TEXT_RELATIONS, F.least(k % 14, F.lit(11)))).alias("relation_type"),
        F.concat(F.lit("info-"), k + 1).alias("relation_target"),
        (k % 17 != 0).alias("has_retention"),
        "text",
    )


def information_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as text with front matter, the form the corpus readers see."""
    f = information_facts(spark, sf_dir)
    revision = F.when(
        F.col("structured"),
        F.concat(
            F.lit("\n  number: "), "number",
            F.lit("\n  is_revision: "), F.col("is_revision").cast("string"),
            F.lit("\n  previous_revision: "), F.coalesce(F.col("previous").cast("string"), F.lit("null")),
        ),
    ).otherwise(F.concat(F.lit(" "), F.col("number")))
    relations = F.when(
        F.col("relation_type").isNotNull(),
        F.concat(F.lit("\n  - type: "), "relation_type", F.lit("\n    target: "), "relation_target"),
    ).otherwise(F.lit(" []"))
    text = F.concat(
        F.lit("---\nid: "), "id",
        F.lit("\nrevision:"), revision,
        F.lit("\ntype: "), "type",
        F.lit("\nepistemic_status: "), "epistemic_status",
        F.lit("\noperational_state: "), "operational_state",
        F.lit('\nconfidence: LOW\nimportance: NORMAL\n\ncontext:\n  mode: ANALYSIS\n  project: "'), "source",
        F.lit('"\n  domain:\n    - GENERAL\n\nprovenance:\n  source_type: '), "source_type",
        F.lit('\n  source: "'), "source",
        F.lit('"\n\nevidence:\n  supporting: []\n  contradicting: []\n\ntime:\n  created_at: "'), "created_at",
        F.lit('"\n\nrelations:'), relations,
        F.lit("\ntriggers: []\n"),
        F.when(F.col("has_retention"), F.lit("\nretention: NORMAL\n")).otherwise(F.lit("")),
        F.lit("---\n\n# Information\n\n"), "text", F.lit("\n"),
    )
    return f.select(
        F.concat(F.lit("working/"), "id", F.lit(".md")).alias("path"), text.alias("text")
    )


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = information_facts(spark, sf_dir)
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    until = iso(
        F.timestamp_add("DAY", (k % 900).cast("int") - 100, F.col("created_at").cast("timestamp"))
    )
    return f.select(
        "id",
        F.struct(
            F.col("number"),
            F.col("is_revision"),
            F.col("previous").alias("previous_revision"),
        ).alias("revision"),
        F.col("structured").alias("structured_revision"),
        "type",
        "epistemic_status",
        "operational_state",
        F.lit("LOW").alias("confidence"),
        F.lit("NORMAL").alias("importance"),
        F.struct(
            F.lit("ANALYSIS").alias("mode"),
            F.col("source").alias("project"),
            F.array(F.lit("GENERAL")).alias("domain"),
        ).alias("context"),
        F.struct("source_type", "source").alias("provenance"),
        F.struct(
            F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("info-"), k + i)).alias("supporting"),
            F.when(k % 4 == 0, F.array(F.concat(F.lit("info-"), k + 7))).otherwise(F.array().cast("array<string>")).alias("contradicting"),
        ).alias("evidence"),
        F.struct(
            F.col("created_at"),
            none.alias("observed_at"),
            none.alias("verified_at"),
            none.alias("updated_at"),
            F.when(k % 5 != 0, F.col("created_at")).alias("valid_from"),
            F.when(k % 7 != 0, until).alias("valid_until"),
        ).alias("time"),
        F.when(F.col("has_retention"), F.lit("NORMAL")).alias("retention"),
        F.col("text").alias("content"),
    )


def information_and_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, some of them once more under an id of another form."""
    rows = information(spark, sf_dir)
    number = F.regexp_extract("id", r"(\d+)", 1)
    memos = rows.filter(number.cast("long") % 19 == 0).withColumn("id", F.concat(F.lit("memo-"), number))
    return rows.unionByName(memos)


def information_under_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, some of them without an operational state."""
    number = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    empty = (number % 13 == 0) & (F.col("operational_state") != "LOST")
    state = F.when(empty, F.lit("")).otherwise(F.col("operational_state"))
    return information(spark, sf_dir).withColumn("operational_state", state)


def information_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations already present: one per record with a relation."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents")
    kind = F.when(k % 14 < 12, pick(_TEXT_RELATIONS, F.least(k % 14, F.lit(11))))
    return d.select(
        F.concat(F.lit("info-"), k).alias("source_id"),
        F.lit(0).alias("pos"),
        kind.alias("type"),
        F.concat(F.lit("info-"), k + 1).alias("target_id"),
    ).filter(F.col("type").isNotNull())


def supersessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with chains of up to five steps, forks, rings and sources without a record."""
    k, d = F.col("doc_id"), read(spark, sf_dir, "documents")
    later = F.when(k % 7 < 5, k + 1).when(k % 70 == 68, k - 2).when(k % 91 == 6, k + 1_000_000)
    more = F.when(k % 7 == 2, k + 3)
    named = d.select(F.explode(F.array_compact(F.array(later, more))).alias("source"), F.concat(F.lit("info-"), k).alias("target_id"))
    chains = named.select(F.concat(F.lit("info-"), "source").alias("source_id"), F.lit("SUPERSEDES").alias("type"), "target_id")
    return chains.unionByName(information_relations(spark, sf_dir).select("source_id", "type", "target_id"))


def relation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four proposals per document: new, repeated, reflexive or to unknown targets."""
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    i = F.col("i")
    target = (
        F.when(i == 0, k + 1)
        .when(i == 1, F.when(k % 6 == 0, k).otherwise(k + 2))
        .when(i == 2, F.floor(k / 2))
        .otherwise(F.when(k % 9 == 0, k + 1000000).otherwise(F.floor(k / 2)))
    )
    kind = (
        F.when((i == 3) & (k % 8 == 0), F.lit("LIKES"))
        .when(i == 0, pick(K.RELATION_TYPES, F.least(k % 14, F.lit(9))))
        .when(i == 1, pick(("SUPERSEDES", "CONTRADICTS"), k % 2))
        .otherwise(pick(K.RELATION_TYPES, k % 10))
    )
    return d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        (k * 4 + i).alias("seq"),
        F.concat(F.lit("info-"), k).alias("source_id"),
        kind.alias("type"),
        F.when((i == 1) & (k % 31 == 0), F.lit(""))
        .when((i == 2) & (k % 16 == 3), F.concat(F.lit("memo-"), F.floor(k / 38) * 19))
        .otherwise(F.concat(F.lit("info-"), target))
        .alias("target_id"),
        (i % 2 == 1).alias("review"),
    )


def information_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to ingest, one per conversation turn."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text") + F.col("turn")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat(F.lit("info-c"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.when(n % 13 == 0, F.lit("rumour")).otherwise(F.lower(pick(K.INFORMATION_TYPES, n % 12))).alias("type"),
        F.lit("analysis").alias("mode"),
        F.concat(F.lit("conversation "), "conv_id").alias("project"),
        F.when(F.col("role") == "user", F.lit("user_statement")).otherwise(F.lit("model_output")).alias("source_type"),
        F.col("role").alias("source"),
        F.col("text").alias("content"),
    )


def manual_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual field changes, several per record, from the event log."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("seq"),
        F.concat(F.lit("info-"), "user_id").alias("id"),
        F.when(n % 43 == 0, F.lit("MAYBE"))
        .when(n % 3 == 0, pick(K.EPISTEMIC_STATUSES, n % 6))
        .when(n % 3 == 1, F.lit(""))
        .alias("epistemic_status"),
        F.when(n % 59 == 0, F.lit("ASLEEP")).when(n % 4 == 0, pick(K.OPERATIONAL_STATES, n % 6)).alias("operational_state"),
        F.when(n % 5 == 0, F.lit("HIGH")).alias("confidence"),
        F.when(n % 7 == 0, F.lit("CRITICAL")).alias("importance"),
        F.concat(F.lit("event "), "event_type").alias("reason"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews asked for documents; some are closed or point to nothing."""
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.concat(F.lit("review-"), k).alias("review_id"),
        F.when(k % 29 == 0, F.concat(F.lit("info-"), k + 1000000))
        .when(k % 30 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("info-"), F.floor(k / 2)))
        .alias("information_id"),
        F.when(F.col("lang") == "de", F.lit("RESOLVED")).otherwise(F.lit("PENDING_REVIEW")).alias("status"),
        F.lit("needs a decision").alias("reason"),
    )


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("seq"),
        F.concat(F.lit("review-"), F.when(k % 37 == 0, k + 1000000).otherwise(k)).alias("review_id"),
        F.lower(pick(("CONFIRMED", "REFUTED", "CONFLICTED", "MAYBE"), F.col("n_chars") % 4)).alias("decision"),
        F.concat(F.lit("from "), "source").alias("reason"),
    )


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of state changes, one entity per user."""
    e = read(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    return e.select(
        F.concat(F.lit("event-"), n).alias("event_id"),
        F.when(u % 2 == 0, F.concat(F.lit("info-"), u)).when(n % 71 == 0, F.lit("info-0")).alias("information_id"),
        F.when((u % 2 == 1) & (n % 73 != 0), F.concat(F.lit("thread-"), u)).alias("thread_id"),
        n.alias("revision"),
        F.when(u % 2 == 0, pick(K.EPISTEMIC_STATUSES, n % 6)).otherwise(pick(K.THREAD_STATUSES, n % 8)).alias("before"),
        F.when(u % 2 == 0, pick(K.EPISTEMIC_STATUSES, F.floor(n / 7) % 6)).otherwise(pick(K.THREAD_STATUSES, F.floor(n / 3) % 8)).alias("after"),
        "event_type",
        F.col("ts").alias("happened_at"),
    )


def state_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moment near each event of an entity, some of them ahead of all its events; a few entities have none."""
    e = read(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    near = F.col("ts") + F.make_dt_interval(hours=(n % 97 * 8 - 600).cast("int"))
    entity = F.when(n % 101 == 0, F.concat(F.lit("info-none-"), n % 5)).when(u % 2 == 0, F.concat(F.lit("info-"), u)).otherwise(F.concat(F.lit("thread-"), u))
    return e.select(entity.alias("entity_id"), near.alias("moment"))

"""Record corpora: one text file per record.

Files are read whole, one row each, and parsed with column expressions; only
YAML front matter needs Python, batch-wise and without the record body.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recordloom import constants as K
from recordloom.functions import text as X
from recordloom.functions.frames import keep_where, last_key_wins


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below ``path`` as (path, text); only the folder itself."""
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def _kind(json_text: Column) -> Column:
    """OBJECT, ARRAY, another variant type name, or null for invalid JSON."""
    schema = F.schema_of_variant(F.try_parse_json(json_text))
    return F.regexp_extract(schema, r"\A([A-Z]+)", 1)


def _section(section: str) -> tuple[Column, Column]:
    """JSON of a section (``{}`` when it is missing) and whether it parses."""
    text = F.col("text")
    raw = F.when(X.section_found(text, section), X.section_json(text, section)).otherwise(
        F.lit("{}")
    )
    return raw, F.try_parse_json(raw).isNotNull()


def _line(name: str, pattern: str) -> Column:
    """First ``name: value`` line.  White space after the colon may run over to
    the next line, as it does for an empty title."""
    return F.regexp_extract(F.col("text"), rf"(?md)^{name}:\s*({pattern})$", 1)


def _has_line(name: str, pattern: str) -> Column:
    return F.col("text").rlike(rf"(?md)^{name}:\s*{pattern}$")


# --- threads -----------------------------------------------------------------

_THREAD_SECTIONS = {
    "Context": "OBJECT",
    "Actions": "ARRAY",
    "Relations": "ARRAY",
    "Temporal": "OBJECT",
    "Provenance": "OBJECT",
}


def parse_threads(texts: DataFrame) -> DataFrame:
    """Thread records with nested actions and relations, and ``parse_error``."""
    rows = last_key_wins(texts).select(
        "path",
        "text",
        *[_section(s)[0].alias("_" + s.lower()) for s in _THREAD_SECTIONS],
    )
    status = X.strip(_line("status", ".+"))
    identity = (
        _has_line("thread_id", ".+")
        & _has_line("revision", r"\d+")
        & _has_line("title", ".*")
        & _has_line("status", ".+")
    )
    checks: list[tuple[Column, Column | str]] = [
        (~identity, "missing Thread identity information"),
        (
            X.not_in(status, K.THREAD_STATUSES),
            F.concat(F.lit("invalid Thread status: "), status),
        ),
    ]
    checks += [
        (F.try_parse_json("_" + s.lower()).isNull(), f"invalid JSON in section '{s}'")
        for s in _THREAD_SECTIONS
    ]
    checks += [
        (
            _kind(F.col("_" + s.lower())) != kind,
            f"{s} must contain a JSON {'object' if kind == 'OBJECT' else 'array'}",
        )
        for s, kind in _THREAD_SECTIONS.items()
    ]
    items = F.try_variant_get(F.try_parse_json("_actions"), "$", "array<variant>")
    has_key = lambda a, k: F.array_contains(F.json_object_keys(F.to_json(a)), k)
    bad_entry = F.exists(items, lambda a: ~F.startswith(F.schema_of_variant(a), F.lit("OBJECT")))
    bad_action = F.exists(
        items,
        lambda a: F.coalesce(
            ~(
                has_key(a, "action_id")
                & has_key(a, "description")
                & F.coalesce(
                    F.try_variant_get(a, "$.status", "string").isin(*K.ACTION_STATUSES),
                    F.lit(False),
                )
                & (
                    ~has_key(a, "metadata")
                    | F.startswith(
                        F.coalesce(
                            F.schema_of_variant(F.try_variant_get(a, "$.metadata", "variant")),
                            F.lit(""),
                        ),
                        F.lit("OBJECT"),
                    )
                )
            ),
            F.lit(True),
        ),
    )
    checks += [(bad_entry, "invalid action entry"), (bad_action, "invalid Thread action")]

    temporal = F.try_parse_json("_temporal")
    temporal_keys = F.coalesce(F.json_object_keys("_temporal"), F.array())

    def moment(name: str) -> Column:
        return F.try_variant_get(temporal, f"$.{name}", "string")

    def required_moment(name: str) -> Column:
        # absent gives "", a JSON null becomes the text None
        return F.when(~F.array_contains(temporal_keys, name), F.lit("")).otherwise(
            F.coalesce(moment(name), F.lit("None"))
        )

    action = lambda a: F.struct(
        _as_text(a, "action_id").alias("action_id"),
        _as_text(a, "description").alias("description"),
        F.try_variant_get(a, "$.status", "string").alias("status"),
        F.coalesce(
            X.small_escapes(F.to_json(F.try_variant_get(a, "$.metadata", "variant"))), F.lit("{}")
        ).alias("metadata"),
    )
    links = F.try_variant_get(F.try_parse_json("_relations"), "$", "array<variant>")
    link = lambda r: F.struct(
        F.try_variant_get(r, "$.type", "string").alias("type"),
        F.try_variant_get(r, "$.source_id", "string").alias("source_id"),
        F.try_variant_get(r, "$.target_id", "string").alias("target_id"),
        X.small_escapes(F.to_json(r)).alias("raw"),
    )
    provenance = F.transform_values(
        F.try_variant_get(F.try_parse_json("_provenance"), "$", "map<string,variant>"),
        lambda _, v: X.small_escapes(F.to_json(v)),
    )
    parsed = rows.select(
        "path",
        X.strip(_line("thread_id", ".+")).alias("thread_id"),
        X.strip(_line("title", ".*")).alias("title"),
        X.section_text(F.col("text"), "Objective").alias("objective"),
        status.alias("status"),
        _line("revision", r"\d+").try_cast("int").alias("revision"),
        X.canonical_json(F.col("_context")).alias("context"),
        F.transform(items, action).alias("actions"),
        F.transform(links, link).alias("relations"),
        required_moment("created_at").alias("created_at"),
        required_moment("updated_at").alias("updated_at"),
        moment("started_at").alias("started_at"),
        moment("completed_at").alias("completed_at"),
        provenance.alias("provenance"),
        X.first_error(*checks).alias("parse_error"),
    )
    return parsed


def _as_text(a: Column, key: str) -> Column:
    """A JSON member as text; null becomes the text None."""
    return F.coalesce(F.try_variant_get(a, f"$.{key}", "string"), F.lit("None"))


def read_threads(spark: SparkSession, path: str, fail_fast: bool = True) -> tuple[DataFrame, DataFrame]:
    """Threads of a folder and the files that do not parse.

    With ``fail_fast`` a single bad file fails the job when the threads are
    used, otherwise bad files only show up among the rejects.
    """
    parsed = parse_threads(read_texts(spark, path))
    if fail_fast:
        complaint = F.concat("path", F.lit(": "), "parse_error")
        threads = parsed.withColumn(
            "thread_id",
            F.when(F.col("parse_error").isNull(), F.col("thread_id")).otherwise(
                F.raise_error(complaint)
            ),
        )
    else:
        threads = keep_where(parsed, F.col("parse_error").isNull())
    rejects = keep_where(parsed, F.col("parse_error").isNotNull()).select("path", "parse_error")
    return threads.drop("path", "parse_error"), rejects


def child_tables(threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested threads as a flat table with action and relation tables."""
    actions = threads.select("thread_id", F.posexplode("actions").alias("pos", "a")).select(
        "thread_id", "pos", "a.action_id", "a.description", "a.status", "a.metadata"
    )
    relations = threads.select("thread_id", F.posexplode("relations").alias("pos", "r")).select(
        "thread_id", "pos", "r.type", "r.source_id", "r.target_id"
    )
    return threads.drop("actions", "relations"), actions, relations


# --- memories ----------------------------------------------------------------

_MEMORY_SECTIONS = ("Metadata", "Provenance", "Temporal", "Verification", "Relations")


def parse_memories(texts: DataFrame) -> DataFrame:
    rows = last_key_wins(texts).select(
        "path",
        "text",
        *[_section(s)[0].alias("_" + s.lower()) for s in _MEMORY_SECTIONS],
    )
    checks: list[tuple[Column, Column | str]] = [
        (
            ~(_has_line("id", ".+") & _has_line("revision", r"\d+")),
            "missing identity information",
        )
    ]
    checks += [
        (F.try_parse_json("_" + s.lower()).isNull(), f"invalid JSON in section '{s}'")
        for s in _MEMORY_SECTIONS
    ]
    metadata = F.transform_values(
        F.try_variant_get(F.try_parse_json("_metadata"), "$", "map<string,variant>"),
        lambda _, v: X.small_escapes(F.to_json(v)),
    )
    return rows.select(
        "path",
        X.strip(_line("id", ".+")).alias("information_id"),
        _line("revision", r"\d+").try_cast("int").alias("revision"),
        X.section_text(F.col("text"), "Content").alias("content"),
        metadata.alias("metadata"),
        *[X.canonical_json(F.col("_" + s.lower())).alias(s.lower()) for s in _MEMORY_SECTIONS[1:]],
        X.first_error(*checks).alias("parse_error"),
    )


def read_memories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Memories of a folder and the files that were skipped."""
    parsed = parse_memories(read_texts(spark, path))
    return (
        keep_where(parsed, F.col("parse_error").isNull()).drop("path", "parse_error"),
        keep_where(parsed, F.col("parse_error").isNotNull()).select("path", "parse_error"),
    )


# --- information -------------------------------------------------------------


def _plain(value: object) -> object:
    """YAML values as JSON values; dates become ISO text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


_FRONT_MATTER = StructType(
    [StructField("json", StringType()), StructField("error", StringType())]
)


@F.pandas_udf(_FRONT_MATTER)
def front_matter_json(front: pd.Series) -> pd.DataFrame:
    """Front matter as canonical JSON, or why it cannot be read."""
    try:
        import yaml
    except ImportError as missing:  # pragma: no cover
        raise RuntimeError("reading front matter needs a YAML reader") from missing
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, "front matter absent"
        try:
            data = yaml.load(text, loader)
        except (yaml.YAMLError, ValueError):
            return None, "front matter YAML invalide"
        if not isinstance(data, dict):
            return None, "front matter YAML invalide : objet attendu"
        try:
            return (
                json.dumps(_plain(data), ensure_ascii=False, sort_keys=True, separators=(",", ":")),
                None,
            )
        except (TypeError, ValueError):
            return None, "front matter YAML invalide"

    return pd.DataFrame([one(t) for t in front], columns=["json", "error"])


def parse_information(texts: DataFrame) -> DataFrame:
    """Front matter and body of record texts.

    Columns: path, front (raw), content (leading newlines removed), metadata
    (canonical JSON of the whole front matter) and parse_error.
    """
    front, body = X.split_front(F.col("text"))
    return texts.select(
        "path",
        front.alias("front"),
        F.ltrim(body, F.lit("\n")).alias("content"),
        front_matter_json(front).alias("_y"),
    ).select(
        "path", "front", "content", F.col("_y.json").alias("metadata"), F.col("_y.error").alias("parse_error")
    )


def read_information(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    parsed = parse_information(read_texts(spark, path))
    return (
        information_rows(keep_where(parsed, F.col("parse_error").isNull())),
        keep_where(parsed, F.col("parse_error").isNotNull()).select("path", "parse_error"),
    )


def information_rows(parsed: DataFrame) -> DataFrame:
    """Typed record columns of parsed information; unknown keys stay in ``extra``."""
    v = F.try_parse_json("metadata")

    def text(path: str) -> Column:
        return F.try_variant_get(v, "$." + path, "string")

    def texts(path: str) -> Column:
        return F.coalesce(
            F.try_variant_get(v, "$." + path, "array<string>"), F.array().cast("array<string>")
        )

    number, is_revision, previous = revision_parts(v)
    known = (*K.INFORMATION_FIELDS, "is_revision", "previous_revision")
    extra = F.map_filter(
        F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*known)
    )
    return parsed.select(
        text("id").alias("id"),
        F.struct(
            number.try_cast("int").alias("number"),
            is_revision.alias("is_revision"),
            previous.try_cast("int").alias("previous_revision"),
        ).alias("revision"),
        F.startswith(
            F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.revision", "variant")), F.lit("")),
            F.lit("OBJECT"),
        ).alias("structured_revision"),
        *[
            text(n).alias(n)
            for n in ("type", "epistemic_status", "operational_state", "confidence", "importance")
        ],
        F.struct(
            text("context.mode").alias("mode"),
            text("context.project").alias("project"),
            texts("context.domain").alias("domain"),
        ).alias("context"),
        F.struct(
            text("provenance.source_type").alias("source_type"),
            text("provenance.source").alias("source"),
        ).alias("provenance"),
        F.struct(
            texts("evidence.supporting").alias("supporting"),
            texts("evidence.contradicting").alias("contradicting"),
        ).alias("evidence"),
        F.struct(*[text("time." + n).alias(n) for n in K.TIME_FIELDS]).alias("time"),
        F.coalesce(
            F.try_variant_get(v, "$.relations", "array<struct<type:string,target:string>>"),
            F.array().cast("array<struct<type:string,target:string>>"),
        ).alias("relations"),
        F.to_json(F.try_variant_get(v, "$.triggers", "variant")).alias("triggers"),
        text("retention").alias("retention"),
        "content",
        F.to_json(extra).alias("extra"),
    )


def revision_parts(v: Column) -> tuple[Column, Column, Column]:
    """Number, revision flag and previous number, as canonical JSON text and a
    boolean.

    A revision is a number with the two other keys beside it, or an object that
    holds all three.  A missing revision is number 1.
    """

    def member(path: str) -> Column:
        return F.to_json(F.try_variant_get(v, path, "variant"))

    revision = member("$.revision")
    nested = F.coalesce(revision.startswith("{"), F.lit(False))
    number = F.when(nested, F.coalesce(member("$.revision.number"), F.lit("null"))).otherwise(
        F.coalesce(revision, F.lit("1"))
    )
    flag = F.when(nested, member("$.revision.is_revision")).otherwise(member("$.is_revision"))
    previous = F.coalesce(
        F.when(nested, member("$.revision.previous_revision")).otherwise(
            member("$.previous_revision")
        ),
        F.lit("null"),
    )
    truth = X.let(
        F.coalesce(flag, F.lit("false")),
        lambda f: F.when(f.startswith('"'), F.lower(f).isin('"true"', '"yes"', '"1"')).otherwise(
            ~f.isin("false", "null", "0", "0.0", "[]", "{}")
        ),
    )
    return number, truth, previous


# --- operation ledger --------------------------------------------------------


def read_operations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Operation records, one JSON file each, and those that contradict their name."""
    return parse_operations(
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )


def parse_operations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operation records (file, value): the sound ones, and (file, error) of the others."""
    v = F.try_parse_json("value")
    raw = last_key_wins(raw)
    fields = ("operation_id", "execution_plan_hash", "information_id", "result", "status", "timestamp")
    rows = raw.select(
        "file", v.alias("v"), *[F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in fields]
    )
    error = X.first_error(
        (F.col("v").isNull(), "INVALID_JSON"),
        (~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "NOT_AN_OBJECT"),
        (
            F.coalesce(F.concat("operation_id", F.lit(".json")) != F.col("file"), F.lit(True)),
            "ID_CONFLICT",
        ),
    )
    rows = rows.withColumn("error", error)
    return (
        keep_where(rows, F.col("error").isNull()).select(*fields),
        keep_where(rows, F.col("error").isNotNull()).select("file", "error"),
    )

"""Corpus readers on files, the ledger, sinks and incremental ingest."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordloom.sources import corpora, sinks
from recordloom.sources.requests import parse_requests, read_requests
from recordloom.streaming.ingest import ingest_stream


def thread_file(thread_id, title="A title", actions="[]", status="TESTING", objective="Do it"):
    return (
        f"# Thread Object\n\nVersion: 0.1\n\n---\n\n## Identity\n\nthread_id: {thread_id}\nrevision: 3\n"
        f"title: {title}\nstatus: {status}\n\n---\n\n## Objective\n\n{objective}\n\n---\n\n"
        f'## Context\n\n```json\n{{"b": 1, "a": [2]}}\n```\n\n---\n\n## Actions\n\n```json\n{actions}\n```\n\n---\n\n'
        '## Relations\n\n```json\n[{"type": "PART_OF", "target_id": "x"}]\n```\n\n---\n\n'
        '## Temporal\n\n```json\n{"created_at": "2026-01-01", "updated_at": null}\n```\n\n---\n\n'
        '## Provenance\n\n```json\n{"k": 1.0, "s": "é"}\n```\n'
    )


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="recordloom-test-"))


def test_threads(spark, folder):
    action = '[{"action_id": 7, "description": "d", "status": "PLANNED", "metadata": {"z": 1}}]'
    (folder / "a.md").write_text(thread_file("a", actions=action), encoding="utf-8")
    (folder / "a-b.md").write_text(thread_file("a-b", title="", objective="one\n---\ntwo"), encoding="utf-8")
    (folder / "notes.txt").write_text("no record")
    threads, rejects = corpora.read_threads(spark, str(folder))
    got = {r.thread_id: r for r in threads.collect()}
    assert rejects.count() == 0 and set(got) == {"a", "a-b"}
    a = got["a"]
    assert a.actions[0].action_id == "7" and a.actions[0].metadata == '{"z":1}'
    assert a.context == '{"a":[2],"b":1}' and a.updated_at == "None" and a.started_at is None
    assert a.provenance["s"] == '"é"'
    # an empty title takes the next line, the objective ends at the first rule
    assert got["a-b"].title == "status: TESTING" and got["a-b"].objective == "one"
    flat, actions, relations = corpora.child_tables(threads)
    assert actions.count() == 1 and relations.count() == 2 and "actions" not in flat.columns


def test_bad_thread_fails_the_list(spark, folder):
    (folder / "a.md").write_text(thread_file("a"), encoding="utf-8")
    (folder / "b.md").write_text(thread_file("b", actions="{}"), encoding="utf-8")
    threads, _ = corpora.read_threads(spark, str(folder))
    with pytest.raises(Exception, match="Actions must contain a JSON array"):
        threads.collect()
    kept, rejects = corpora.read_threads(spark, str(folder), fail_fast=False)
    assert [r.thread_id for r in kept.collect()] == ["a"]
    assert rejects.first().parse_error == "Actions must contain a JSON array"


def memory_file(name, content="text", revision="2"):
    return (
        f"# Information Object\n\n## Identity\n\nid: {name}\nrevision: {revision}\n\n---\n\n## Content\n\n{content}\n\n---\n\n"
        '## Metadata\n\n```json\n{"lang": "fr"}\n```\n'
    )


def test_memories_skip_bad_files(spark, folder):
    (folder / "a.md").write_text(memory_file("a", "first\n---\nsecond"), encoding="utf-8")
    (folder / "b.md").write_text(memory_file("b", revision="two"), encoding="utf-8")
    memories, rejects = corpora.read_memories(spark, str(folder))
    row = memories.first()
    assert (row.information_id, row.revision, row.content) == ("a", 2, "first")
    assert row.metadata == {"lang": '"fr"'} and row.relations == "{}"
    assert rejects.count() == 1


def test_information(spark, folder):
    (folder / "info-1.md").write_text(
        "---\nid: info-1\nrevision:\n  number: 4\n  is_revision: 'Yes'\n  previous_revision: 3\ntype: FACT\n"
        "time:\n  created_at: 2026-08-01T10:00:00\nmood: calm\n---\n\n\n# Body\n",
        encoding="utf-8",
    )
    (folder / "info-2.md").write_text("no front matter", encoding="utf-8")
    (folder / "info-3.md").write_text("---\n: [\n---\nx", encoding="utf-8")
    records, rejects = corpora.read_information(spark, str(folder))
    row = records.first()
    assert row.revision.number == 4 and row.revision.is_revision and row.revision.previous_revision == 3
    assert row.structured_revision and row.time.created_at == "2026-08-01T10:00:00"
    assert row.content == "# Body\n" and json.loads(row.extra) == {"mood": "calm"}
    assert sorted(r.parse_error for r in rejects.collect()) == ["front matter YAML invalide", "front matter absent"]


def test_ledger(spark, folder):
    good = {"operation_id": "op-1", "execution_plan_hash": "h", "information_id": "i", "result": "STORE", "status": "EXECUTED", "timestamp": "t"}
    (folder / "op-1.json").write_text(json.dumps(good, indent=2))
    (folder / "op-2.json").write_text(json.dumps(good))
    (folder / "op-3.json").write_text("[]")
    ledger, rejects = corpora.read_operations(spark, str(folder))
    assert [r.operation_id for r in ledger.collect()] == ["op-1"]
    assert sorted((r.file, r.error) for r in rejects.collect()) == [("op-2.json", "ID_CONFLICT"), ("op-3.json", "NOT_AN_OBJECT")]
    target = str(folder / "table")
    sinks.append_operations(ledger, target)
    sinks.append_operations(ledger, target)
    assert spark.read.parquet(target).count() == 1


def test_event_sink_and_snapshots(spark, folder):
    events = spark.createDataFrame([("e1", "2026-01-02T00:00:00Z"), ("e2", "2026-01-03T00:00:00Z")], "event_id string, timestamp string")
    sinks.append_events(events, str(folder / "events"))
    back = spark.read.parquet(str(folder / "events"))
    assert back.filter(F.col("day") == "2026-01-02").count() == 1
    assert sinks.write_snapshot(events, str(folder / "snap"), 3).endswith("version=0000000003")


def test_request_log(spark, folder):
    (folder / "log.txt").write_text(
        '{"request":{"schema_version":"0.1","domain":"THREAD","intent":"GET_THREAD","filters":{"thread_id":"t"}}}\n{"request":{}}\n'
    )
    parsed = parse_requests(read_requests(spark, str(folder / "log.txt"))).collect()
    assert sorted(str(r.error) for r in parsed) == ["FIELDS_MISSING: schema_version, domain, intent", "None"]


def test_incremental_ingest_equals_batch(spark, folder):
    source, target = folder / "in", str(folder / "out")
    source.mkdir()
    for step in range(2):
        (source / f"m{step}.md").write_text(memory_file(f"m{step}"), encoding="utf-8")
        (source / f"bad{step}.md").write_text("nothing", encoding="utf-8")
        ingest_stream(spark, "memories", str(source), target, str(folder / "cp")).awaitTermination()
    stream = spark.read.parquet(target).drop("path", "epoch")
    batch, rejects = corpora.read_memories(spark, str(source))
    key = lambda r: r.information_id
    assert sorted(stream.select(*batch.columns).collect(), key=key) == sorted(batch.collect(), key=key)
    assert spark.read.parquet(target + "_rejects").count() == rejects.count() == 2


def test_last_of_repeated_keys_counts(spark):
    raw = '{"request":{"schema_version":"0.1","domain":"X","domain":"THREAD","intent":"GET_THREAD","filters":{"thread_id":"a","thread_id":"b"}}}'
    row = parse_requests(spark.createDataFrame([(1, raw)], "request_id long, raw string")).first()
    assert row.error is None and row.domain == "THREAD" and row.thread_id == "b"
    good, bad = corpora.parse_operations(
        spark.createDataFrame([("o.json", '{"operation_id":"x","operation_id":"o","result":"STORE"}')], "file string, value string")
    )
    assert good.first().operation_id == "o" and bad.count() == 0

"""Batch search through the inverted index against single scans and a plain count."""

import json
import re

import pytest
from pyspark.sql import functions as F

from recordloom.catalog import tables as B
from recordloom.operators import postings
from recordloom.operators import search as S

MEMORY = "information_id string, revision int, content string, metadata map<string,string>, provenance string, temporal string, verification string, relations string"


def _memories(spark, texts):
    return spark.createDataFrame([(i, 1, t, {}, "{}", "{}", "{}", "[]") for i, t in texts], MEMORY)


def _plain(memories, queries, limit):
    """Every query with every record, as (query, rank, id, score)."""
    hays = {r[0]: r[1] for r in memories.select("information_id", S.haystack()).collect()}
    out = []
    for name, query in queries:
        terms = S.query_terms(query)
        scores = {i: sum(t in hay for t in terms) for i, hay in hays.items()}
        best = sorted((i for i in scores if scores[i]), key=lambda i: (-scores[i], i + ".md"))[:limit]
        out.extend((name, rank + 1, i, scores[i] / len(terms)) for rank, i in enumerate(best))
    return sorted(out)


def _found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def some(spark):
    words = ["alpha", "beta", "gamma", "delta", "straße", "wort", "an", "anna", "content", "zeta"]
    texts = [(f"m{i}", " ".join(words[j] for j in range(10) if (i * 7 + j * j) % (j + 2) == 0)) for i in range(200)]
    texts += [(f"same-{i}", "alpha beta") for i in range(60)] + [("a", "Rare Wörter"), ("a-b", "rarely"), ("null", None)]
    return _memories(spark, texts)


QUERIES = [
    ("one", "rare"),
    ("two", "alpha beta an"),
    ("three", "content"),
    ("four", "zeta zeta zeta rare alpha content content"),
    ("five", "a e"),
    ("six", "nothing of this kindx"),
    ("seven", "xyzzy"),
    ("eight", " ,; "),
    ("nine", "Straße WORT nnf"),
    ("ten", " ".join(["alpha"] * 40 + ["gamma", "delta", "rare"])),
]


@pytest.mark.parametrize(("bits", "limit"), [(10, 5), (2, 1), (2, 1000)])
def test_results_are_those_of_a_full_scan(spark, some, monkeypatch, bits, limit):
    monkeypatch.setattr(postings, "BLOCK_BITS", bits)
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert _found(S.term_search_batch(some, asked, limit)) == _plain(some, QUERIES, limit)


def test_single_and_batch_search_agree(spark, sf):
    memories = B.memories(spark, sf)
    asked = B.read(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct().limit(3)
    batch = S.term_search_batch(memories, asked, 5).collect()
    for name in {r["query_id"] for r in batch}:
        one = [(r["information_id"], r["score"]) for r in S.term_search(memories, name, 5).collect()]
        assert one == [(r["information_id"], r["score"]) for r in sorted(batch, key=lambda r: r["rank"]) if r["query_id"] == name]


def test_groups_of_queries_and_long_matches(spark, some, monkeypatch):
    monkeypatch.setattr(postings, "QUERY_GROUP", 2)
    monkeypatch.setattr(postings, "fits", lambda *_: False)
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert _found(S.term_search_batch(some, asked, 3)) == _plain(some, QUERIES, 3)


def test_only_postings_of_the_terms_are_opened(spark, some, tmp_path):
    index = S.memory_index(some)
    index.write(f"{tmp_path}/index")
    kept = postings.TermIndex.read(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([("q", "rare")], "query_id string, query string")
    assert _found(S.indexed_search(kept, asked, 5)) == _plain(some, [("q", "rare")], 5)
    wanted = spark.createDataFrame([("rare",), ("rarely",)], "run string")
    opened = kept.opened(wanted)
    rows, total = opened.count(), kept.postings.count()
    buckets = {r[0] for r in wanted.select(postings.bucket_of("run")).collect()}
    folders = {re.search(r"bucket=(\d+)", f)[1] for f in opened.inputFiles()}
    assert rows < total / 3 and {r[0] for r in opened.select("bucket").distinct().collect()} == buckets
    assert len(folders) > 2  # Spark lists all folders; the filter on the folder keeps the scan to two of them
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in re.sub(r"#\d+", "", plan) or "PartitionFilters: [isnotnull(bucket" in re.sub(r"#\d+", "", plan)


def test_blocks_that_cannot_reach_the_threshold_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    texts = [(f"m{i:04}", "common word" + (" needle hay" if i < 6 else " hay" if i % 10 == 0 else "")) for i in range(800)]
    memories = _memories(spark, texts)
    counted = []
    plain = postings._counted

    def watched(lists, pairs, groups, limit):
        counted.append(pairs.count())
        return plain(lists, pairs, groups, limit)

    monkeypatch.setattr(postings, "_counted", watched)
    queries = [("q", "needle hay common word"), ("r", "common word")]
    asked = spark.createDataFrame(queries, "query_id string, query string")
    assert _found(S.term_search_batch(memories, asked, 5)) == _plain(memories, queries, 5)
    # two first blocks of each query, and none of the other 98
    assert counted == [4, 0]


def test_no_memories_and_no_queries(spark, some):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert _found(S.term_search_batch(some.limit(0), asked, 5)) == []
    assert _found(S.term_search_batch(some, asked.limit(0), 5)) == []


def test_haystack_holds_the_whole_record(spark):
    row = _memories(spark, [("x", 'a "b" \n ü')]).select(S.haystack()).first()[0]
    assert json.loads(row)["content"] == 'a "b" \n ü'


def test_words_and_lists_are_shuffled_together_and_taken_apart_in_their_block(spark, some, monkeypatch):
    plans = []

    def keep(df, stable=postings.stable):
        if "places" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stable(df)

    monkeypatch.setattr(postings, "stable", keep)
    for name, value in (("BLOCK_BITS", 4), ("OUT_ROWS", 3), ("OPEN_PLACES", 5)):
        monkeypatch.setattr(postings, name, value)
    # records whose rows share an id, and one without text or id
    more = _memories(spark, [("m3", "alpha unseen"), ("m3", None), (None, "alpha"), ("z", "")])
    memories, asked = some.unionByName(more), [*QUERIES[:5], ("own", "unseen alpha")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    found = _found(S.term_search_batch(memories, queries, 50))
    assert len(plans) == 2 and not any("Generate" in p or "collect_" in p.replace("collect_set(term_id", "") for p in plans)
    lone = _found(S.term_search_batch(memories, queries.filter("query_id = 'own'"), 50))
    assert [r for r in found if r[0] == "own"] == lone
    assert ("own", 1, "m3", 1.0) in lone
    assert [r for r in found if r[0] == "one"] == [r for r in _plain(some, asked, 50) if r[0] == "one"]

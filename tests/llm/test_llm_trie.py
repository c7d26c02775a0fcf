import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recordloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * words
            leaves[k[:d]] += not children[k]
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if rebuilt[c] == k)
        parent = min(nodes[k[:-1]]) if k else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(k), parent, len(members), children[k], leaves[k], saved[k], sha))
    return sorted(out, key=repr)


def _found(df):
    return sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=repr)


def _hard_rows():
    rows = [(c, t, "user", f"turn {t % 3} of it") for c in range(60) for t in range(c % 7 + 1)]
    rows += [(c, t, "user", "same words") for c in range(100, 180) for t in range(4)]
    rows += [(200, None, None, None), (200, None, "a", ""), (200, 1, "", None), (200, 1, "", None), (203, 1, "x", "y z")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (40, 9, "long", "wort \t" * 50_000), (40, 9, "é", "日本 語")]
    rows += [(5_000_001, t, "r", f"w{t % 2}") for t in range(300)] + [(5_000_021, t, "r", f"w{t % 2}") for t in range(301)]
    return rows


def test_nodes_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert _found(df) == _brute(list(map(tuple, df.select("conv_id", "turn", "role", "text").collect())))


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_hard_conversations_whole_and_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = _hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("place", "digest", "words", "depth", "a", "b", "part", "tie", "weight", "n", "base", "chunk"):
        df = df.withColumn(name, F.lit("x"))
    assert _found(df) == _brute(rows)


def test_turns_of_one_long_conversation_are_numbered_by_many_tasks(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("conv_id"),
        (F.col("id") * 7 % 3000).alias("turn"),
        F.lit("r").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    found = prefix_trie.turns(rows.repartition(4)).filter("conv_id = 7")
    assert sorted(r[0] for r in found.select("place").collect()) == list(range(2000))
    placed = rows.filter("conv_id = 7").orderBy("turn").collect()
    digests = {r["place"]: r["digest"] for r in found.collect()}
    assert all(digests[i] == hashlib.sha256(f"1:r{r['text']}".encode()).digest() for i, r in enumerate(placed))


def test_rows_that_repeat_are_turns_of_their_own(spark):
    rows = [(1, 1, "u", "a b")] * 3 + [(2, 1, "u", "a b")] * 2
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)


def test_no_conversations(spark):
    assert _found(spark.createDataFrame([], SCHEMA)) == []
    assert _found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_a_conversation_left_without_turns_ends_at_the_root(spark):
    # 21 takes turns of 20, which has none
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    found = _found(spark.createDataFrame([(conv, 1, "u", "a")], SCHEMA))
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_long_end_lists_are_joined_in_pieces(spark, monkeypatch):
    ends = spark.range(10_000).select(*[F.lit(0).cast("long").alias(c) for c in prefix_trie.NODE], F.col("id").alias("conv_id"))
    want = hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.end_digests(ends).collect()] == [(0, 0, 0, want)]

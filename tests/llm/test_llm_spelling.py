import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from recordloom.llm import spelling


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(docs):
    import re

    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def _brute(words):
    out = {}
    for w, n in words.items():
        near = sorted((v for v in words if abs(len(v) - len(w)) < 2 and _near(v, w)), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= 5 * n else None
        out[w] = [n, len(near), form, form and words[form]]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def _found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_variants_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _brute(_words(docs.select("doc_id", "text").collect()))
    assert len(want) > 500 and any(r[2] for r in want.values())
    assert _found(spelling.variants(docs)) == want


@pytest.mark.parametrize("spelled", [64, 5])
def test_near_words_of_every_kind(spark, monkeypatch, spelled):
    monkeypatch.setattr(spelling, "SPELLED", spelled)
    rng = np.random.default_rng(0)
    words = {"".join(rng.choice(list("abé"), rng.integers(4, 8))): int(rng.integers(1, 60)) for _ in range(500)}
    long = "q" * 3000
    words |= {long: 50, long + "q": 7, long[:100] + "z" + long[101:]: 9, "z" + long: 9, long[:-1]: 300}
    words |= {"a" * 64: 9, "a" * 65: 3, "a" * 66: 4, "a" * 30 + "b" + "a" * 34: 5}
    ordered = sorted(words)
    df = spark.createDataFrame([(i, w, words[w]) for i, w in enumerate(ordered)], "rank long, word string, n long")
    found = {ordered[r["rank"]]: (r["n_near"], ordered[r["near"]["rank"]]) for r in spelling.neighbours(df).collect()}
    want = {}
    for w in words:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and _near(v, w)]
        if near:
            want[w] = (len(near), min(near, key=lambda v: (-words[v], v)))
    assert found == want


def test_chains_end_at_the_last_form(spark):
    texts = ["abcdef " * 5, "abcdeg " * 25, "abcdgg " * 125, "abcggg " * 624, "zzzzzz " * 5, "zzzzzy " * 25, "zzzzzx " * 25]
    docs = [(i, t) for i, t in enumerate(texts)]
    found = _found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == _brute(_words(docs))
    assert found["abcdef"][4] == "abcdgg" and found["zzzzzz"][2] == "zzzzzx"


def test_hard_documents(spark):
    docs = brute.hard_documents(spark).withColumnRenamed("_salt", "rank")
    plain = docs.select("doc_id", "text").collect()
    many = docs.unionByName(docs).unionByName(docs)
    assert _found(spelling.variants(many)) == _brute(_words(plain * 3))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_very_long_words_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    words = ["é" * 50_000, "é" * 50_001, "Éé" + "e" * 49_999]
    docs = [(i, " ".join([w] * 5) + " mot, Mot ") for i, w in enumerate(words)] + [(9, "abcdefghi " * 40)]
    assert _found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == _brute(_words(docs))


def test_one_exchange_sorts_and_groups_the_rotations(spark, capsys):
    df = spark.createDataFrame([(0, "abcdef", 5)], "rank long, word string, n long")
    spelling.neighbours(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("rangepartitioning(start") == 1 and "hashpartitioning(start" not in plan

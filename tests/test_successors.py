import pytest

from recordloom.functions import hot
from recordloom.operators import histories as H


def _found(spark, links, known):
    relations = spark.createDataFrame([(s, "SUPERSEDES", t) for t, s in links] + [("x", "DEPENDS_ON", "y")], "source_id string, type string, target_id string")
    information = spark.createDataFrame([(k,) for k in known], "id string")
    return {tuple(r) for r in H.successors(information, relations).collect()}


@pytest.mark.parametrize("spread", [False, True])
def test_chains_forks_rings_and_missing_records(spark, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(hot, "HOT_ROWS", 1)
        monkeypatch.setattr(hot, "HOT_SHARE", 10_000)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(21)]
    fork = [("f", "f1"), ("f", "f2"), ("f1", "f3"), ("f2", "f3"), ("f2", "gone"), ("f", "f1"), (None, "f"), ("f", None)]
    ring = [("r1", "r2"), ("r2", "r1"), ("in", "r1"), ("in", "out"), ("self", "self")]
    many = [(f"m{i}", "hub") for i in range(30)] + [("hub", "top")]
    known = [f"c{i}" for i in range(22)] + ["f", "f1", "f2", "f3", "r1", "r2", "in", "out", "self", "hub", "top"]
    want = {(f"c{i}", "c21", False, None) for i in range(21)}
    want |= {("f", "f3", True, None), ("f", "gone", True, "MISSING"), ("f1", "f3", False, None), ("f2", "f3", True, None), ("f2", "gone", True, "MISSING")}
    want |= {(i, None, False, "CYCLE") for i in ("r1", "r2", "in", "self")} | {("in", "out", False, None)}
    want |= {(f"m{i}", "top", False, None) for i in range(30)} | {("hub", "top", False, None)}
    assert _found(spark, chain + fork + ring + many, known) == want


def test_nothing_superseded(spark):
    assert _found(spark, [], ["a"]) == set()


def test_rounds_follow_the_longest_chain_not_the_number_of_records(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(H, "stable", lambda df, keep=H.stable: rounds.append(1) or keep(df))
    pairs = [(f"p{i}", f"q{i}") for i in range(3000)] + [(f"q{i}", f"top{i}") for i in range(3000)]
    ring = [(f"r{i}", f"r{(i + 1) % 701}") for i in range(701)]
    found = _found(spark, pairs + ring, [f"top{i}" for i in range(3000)])
    assert found == {(f"{n}{i}", f"top{i}", False, None) for i in range(3000) for n in "pq"} | {(f"r{i}", None, False, "CYCLE") for i in range(701)}
    assert len(rounds) <= 6


def test_a_long_way_beside_short_ones_and_a_ring_with_one_exit(spark):
    ladder = [(f"s{i:02}", f"s{i + 1:02}") for i in range(40)] + [(f"s{i:02}", "end") for i in range(41)]
    ring = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("r5", "out")]
    want = {(f"s{i:02}", "end", False, None) for i in range(41)}
    want |= {(f"r{i}", "out", False, None) for i in range(37)} | {(f"r{i}", None, False, "CYCLE") for i in range(37)}
    assert _found(spark, ladder + ring, ["end", "out"]) == want

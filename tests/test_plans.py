"""Plans: repeated operations in a batch, revisions, mechanism matrix."""

from pyspark.sql import functions as F

from recordloom import constants as K
from recordloom.catalog import queries as Q
from recordloom.catalog import tables as B
from recordloom.plans import classify as C
from recordloom.plans import decisions as D
from recordloom.plans import routing as P
from recordloom.streaming.dedupe import judge_batch


def test_repeated_plans_in_one_batch(spark, sf):
    decided = Q._decided_plans(spark, sf)
    again = decided.withColumn("seq", F.col("seq") + 1_000_000)
    working, stored = B.information_texts(spark, sf), Q._persistent(spark, sf)
    texts, events, ledger, outcomes = D.apply_plans(decided.unionByName(again), working, stored, "now")
    once = D.apply_plans(decided, working, stored, "now")
    assert ledger.count() == once[2].count() == events.count()
    assert texts.count() == once[0].count()
    first = {r.information_id: r for r in outcomes.filter("seq < 1000000").collect()}
    for r in outcomes.filter("seq >= 1000000").collect():
        before = first[r.information_id]
        if before.code in D.EXECUTED:
            assert (r.result, r.code) == ("NO-OP", "ALREADY_EXECUTED")
        else:
            assert r.code == before.code


def record(kind, epistemic="CONFIRMED", marker="", extra=""):
    return f"---\nid: info-1\ntype: {kind}\nepistemic_status: {epistemic}\n{extra}---\nbody\n{marker}"


def test_mechanism_matrix(spark):
    kinds = (*K.INFORMATION_TYPES, "MEASUREMENT", "fact")
    cases = [(k, e, m) for k in kinds for e in ("CONFIRMED", "UNVERIFIED") for m in ("", "  - type: supports\n", "- type: SUPPORTSX\n")]
    texts = spark.createDataFrame([(f"{i}", record(*c)) for i, c in enumerate(cases)], "path string, text string")
    got = {int(r.path): r.mechanisms for r in C.classify(texts).collect()}
    for i, (kind, epistemic, marker) in enumerate(cases):
        m, kind = got[i], kind.upper()
        assert m.WORKING.status == "YES" and m.PROSPECTIVE.status == "NO" and m.SEMANTIC.status == "POSSIBLE"
        assert m.EPISODIC.status == ("YES" if kind in K.EPISODIC_TYPES else "POSSIBLE")
        assert m.ASSOCIATIVE.status == ("YES" if "supports\n" in marker else "POSSIBLE")
        assert m.PROCEDURAL.status == ("YES" if kind == "PROCEDURE" else "NO")
        known = kind in K.SEMANTIC_TYPES
        assert m.SEMANTIC.reason == (
            K.SEMANTIC_OTHER_REASON if not known
            else K.SEMANTIC_CONFIRMED_REASON if epistemic == "CONFIRMED" else K.SEMANTIC_UNCONFIRMED_REASON
        )


def test_revisions_and_caution(spark):
    extras = {
        "a": "revision: 3\nis_revision: 'YES'\nprevious_revision: 2\n",
        "b": "",
        "c": "revision: {number: 2, is_revision: 'no'}\n",
        "d": "revision: {is_revision: 1}\nweight: 1.0e+30\n",
    }
    texts = spark.createDataFrame([(k, record("FACT", extra=e)) for k, e in extras.items()], "path string, text string")
    got = {r.path: (r.number, r.is_revision, r.previous_revision) for r in P.normalised_revisions(texts).collect()}
    assert got == {"a": (3, True, 2), "b": (1, False, None), "c": (2, False, None), "d": (None, True, None)}
    routed = {r.path: r for r in P.route(texts).collect()}
    assert [routed[p].hash_caution for p in "abcd"] == [False, False, False, True]
    assert routed["a"].update_required and not routed["a"].store_required


def test_unreadable_records_have_no_plan(spark):
    texts = spark.createDataFrame([("a", "no front"), ("b", "---\nid: x\n---\n"), ("c", "---\ntype: [\nid: x\n---\n")], "path string, text string")
    got = {r.path: (r.error, r.plan) for r in P.route(texts).collect()}
    assert got["a"] == ("front matter absent", None)
    assert got["b"] == ("champ type absent", None)
    assert got["c"] == ("front matter YAML invalide", None)


def test_judging_a_batch(spark):
    plans = spark.createDataFrame(
        [(1, "n", "h"), (2, "n", "h"), (3, "n", "g"), (4, "k", "h"), (5, "k", "g")], "seq long, operation_id string, execution_plan_hash string"
    )
    ledger = spark.createDataFrame([("k", "h")], "operation_id string, execution_plan_hash string")
    got = [r.idempotency for r in judge_batch(plans, ledger).orderBy("seq").collect()]
    assert got == ["NEW", "ALREADY_EXECUTED", "CONFLICT", "ALREADY_EXECUTED", "CONFLICT"]

"""Summaries of trials by literals and by hand."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators import trials

SCORES = "variant string, scenario string, query_id string, rank int, score int"
ATTEMPTS = "model string, category string, case_id string, expected_in_scope boolean, expected_decision string, prediction string"


def test_variants(spark):
    rows = [("A", "s1", "q1", 1, 3), ("A", "s1", "q1", 2, 1), ("B", "s1", "q2", 1, 2), ("B", "s1", "q2", 2, 2), ("C", "s1", "q3", 1, 1), ("A", "s2", "q4", 1, 2), ("B", "s2", "q5", 2, 3)]
    d = spark.createDataFrame(rows, SCORES)
    got = {r.variant: tuple(r)[1:] for r in trials.variant_summary(d).collect()}
    assert got["A"] == (2, 3, 2.0, 2.5, 1, 0.3333, 2, 0.6667)
    assert got["B"] == (1, 3, 2.3333, 2.0, 1, 0.3333, 3, 1.0)
    assert got["C"] == (1, 1, 1.0, 1.0, 0, 0.0, 0, 0.0)
    got = {r.scenario: tuple(r)[1:] for r in trials.scenario_winners(d, ["A", "B", "C"]).collect()}
    assert got == {"s1": (2.0, 2.0, 1.0, 2.0, "A+B"), "s2": (2.0, 3.0, None, 3.0, "B")}
    two = spark.createDataFrame([("A", "s", "q1", 1, 3), ("A", "s", "q2", 1, 1), ("B", "s", "q3", 1, 2)], SCORES)
    assert trials.scenario_winners(two, ["A", "B"]).first().winner == "B"  # of two questions the last by id
    no_first = spark.createDataFrame([("A", "s", "q", 2, 3)], SCORES)
    assert trials.variant_summary(no_first).first().mean_top1_score is None
    for bad in (0, 4, None):
        with pytest.raises(Exception, match="a score is 1, 2 or 3"):
            trials.variant_summary(spark.createDataFrame([("A", "s", "q", 1, bad)], SCORES)).collect()
    assert trials.variant_summary(d.where("false")).count() == 0 and trials.scenario_winners(d.where("false"), ["A"]).count() == 0


def test_scope(spark):
    rows = [
        ("m", "x", "a", True, None, "true"),  # right
        ("m", "x", "b", True, None, "false"),  # a false block
        ("m", "x", "c", True, "ALLOW", "BLOCK"),  # wrong, but a decision is no plain false: no block is counted
        ("m", "y", "d", False, None, None),  # fails, so it is let through
        ("m", "y", "e", False, "BLOCK", "CLARIFY"),  # not the decision, but out of scope as expected
        ("m", "y", "f", True, None, "ALLOW"),  # a decision where a truth value is wanted: in scope, not right
        ("n", "y", "g", False, None, None),
    ]
    d = spark.createDataFrame(rows, ATTEMPTS)
    got = {(r.model, r.category): r for r in trials.scope_summary(d).collect()}
    m = got["m", None]
    assert (m.total, m.valid_outputs, m.raw_accuracy, m.scope_accuracy, m.fail_open_accuracy) == (6, 5, 0.2, 0.6, 0.5)
    assert (m.expected_in_scope_count, m.false_block_count, m.false_block_rate, m.false_allow_count) == (4, 1, 0.25, 1)
    assert (got["m", "x"].total, got["m", "x"].level, m.level) == (3, "category", "model")
    n = got["n", None]
    assert (n.raw_accuracy, n.false_block_rate, n.fail_open_accuracy) == (None, None, 0.0)  # nothing said, nothing in scope
    errors = {(r.case_id, r.error) for r in trials.scope_errors(d).collect()}
    assert errors == {("b", "false_block"), ("d", "failure"), ("d", "false_allow"), ("g", "failure"), ("g", "false_allow")}
    assert trials.scope_summary(d.where("false")).count() == 0


def test_latency(spark):
    rng = random.Random(4)
    of = {f"m{k}": [rng.randrange(50) / 4 for _ in range(k)] for k in (1, 2, 19, 20, 21, 200)}
    d = spark.createDataFrame([(m, v) for m, vs in of.items() for v in vs] + [("m2", None)], "model string, latency_ms double")
    for r in trials.latency_summary(d).collect():
        v = sorted(of[r.model])
        assert abs(r["mean"] - statistics.fmean(v)) < 6e-4 and abs(r.p50 - statistics.median(v)) < 6e-4
        assert (r.p95, r["max"]) == (v[-(-len(v) * 95 // 100) - 1], v[-1])


def test_label_sensitivity(spark):
    of = lambda rows: spark.createDataFrame(rows, "q int, c string, grade int")
    majority, independent = of([(1, "a", 2), (1, "b", 3), (1, "c", 1), (2, "d", 3)]), of([(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, "e", 2)])
    seen = of([(1, "a", 0), (1, "a", 0), (1, "c", 0)]).drop("grade")
    got = {(r.q, r.c): (r.majority, r.independent, r.sensitive, r.unchecked) for r in trials.label_sensitivity(majority, independent, seen, ["q", "c"]).collect()}
    assert got == {(1, "a"): (2, 1, True, False), (1, "b"): (3, 2, False, True), (1, "c"): (1, 2, True, False), (2, "d"): (3, 0, True, True), (2, "e"): (0, 2, True, False)}


def test_policy_misses(spark):
    """Against plain Python on random rankings; one query has a third of all positives."""
    rng = random.Random(9)
    grades = [(p, 0 if rng.random() < 0.4 else rng.randrange(1, 6), i, rng.randrange(4)) for p in ("one", "two") for i in range(150)]
    ranked = [(m, q, i, k) for m in "xy" for q in range(6) for k, i in enumerate(rng.sample(range(150), 12), 1)]
    g, r = spark.createDataFrame(grades, "policy string, query_id int, id int, grade int"), spark.createDataFrame(ranked, "model string, query_id int, id int, rank int")
    at = {(m, q, i): k for m, q, i, k in ranked if k <= 10}
    want = {}
    for p, q, i, grade in grades:
        if grade >= 2:
            places = {m: at.get((m, q, i)) for m in "xy"}
            for m, k in places.items():
                n = want.setdefault((p, q, m), [0] * 5)
                lost = not any(places.values())
                for j, x in enumerate((True, k is not None and k <= 5, lost, k is None and not lost, k is not None and k >= 6)):
                    n[j] += x
    got = {(x.policy, x.query_id, x.model): [x.relevant, x.found5, x.shared_missing, x.own_missing, x.late] for x in trials.policy_misses(g, r, ["x", "y"]).collect()}
    assert got == want
    assert trials.policy_misses(g, r.where(F.lit(False)), ["x", "y"]).where("shared_missing <> relevant").count() == 0

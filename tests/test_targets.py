"""Review samples against plain Python on random rows, and literals."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import targets

SCHEMA = "query_id int, candidate_id string, human int, ai int, seed int, confidence string, second int, second_confidence string, critical boolean"


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    """A third of the rows has query 0; positive critical rows are few, so strata run short."""
    q = lambda i: 0 if i % 3 == 0 else rng.randrange(1, 12)
    out = []
    for i in range(n):
        query, human = q(i), rng.choice([0, 0, 1, 2, 3])
        ai = human if rng.random() < 0.8 else rng.randrange(4)
        out.append((query, f"c{i:04}", human, ai, rng.choice([None, human, ai]), rng.choice(["low", "high", "high", "medium"]), ai if rng.random() < 0.9 else rng.randrange(4), rng.choice(["low"] + ["high"] * 9), query % 5 == 4))
    return out


def sha(*parts) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def controls(d, free, score, seed):
    """First positive and first other free row of each critical query."""
    out = {}
    for r in sorted(free, key=lambda r: sha(seed, r[0], r[1])):
        if r[8]:
            out.setdefault((r[0], r[score] >= 2), r[:2])
    return set(out.values())


@pytest.mark.parametrize("n,rate", [(400, 0.1), (25, 0.1), (60, 1.0), (60, 0.0), (0, 0.1)])
def test_by_hand(spark, n, rate):
    rows = rows_of(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA)
    same = [r for r in rows if r[2] == r[3]]
    drawn = {r[:2] for r in sorted(same, key=lambda r: sha("s", r[0], r[1]))[: round(len(same) * rate)]}
    kept = controls(rows, same, 2, "s")
    want = {}
    for r in rows:
        why = [("ai_low_confidence", r[5] == "low"), ("agreement_random_sample", r[:2] in drawn), ("critical_query_control_sample", r[:2] in kept), ("positive_threshold_disagreement", (r[2] >= 2) != (r[3] >= 2))]
        if any(x for _, x in why):
            want[r[:2]] = sorted(name for name, x in why if x)
    got = targets.team_review(df, rate, "s").collect()
    assert {(r.query_id, r.candidate_id): r.selection_reasons for r in got} == want and len(got) == len(want)

    want = {}
    for r in rows:
        sown = r[4] is not None
        why = [("ai_low_confidence", r[5] == "low"), ("unseeded_ai_positive", not sown and r[3] >= 2), ("seed_ai_score_disagreement", sown and r[4] != r[3]), ("seed_ai_threshold_disagreement", sown and (r[4] >= 2) != (r[3] >= 2))]
        if any(x for _, x in why):
            want[r[:2]] = sorted(name for name, x in why if x)
    calm = [r for r in rows if r[:2] not in want and r[3] < 2 and r[5] == "high"]
    for r in sorted(calm, key=lambda r: sha("s", r[0], r[1]))[: round(len(calm) * rate)]:
        want[r[:2]] = ["high_confidence_negative_control"]
    for k in controls(rows, [r for r in rows if r[:2] not in want], 3, "s"):
        want[k] = ["critical_query_control"]
    got = targets.first_judged(df, rate, "s").collect()
    assert {(r.query_id, r.candidate_id): r.selection_reasons for r in got} == want and len(got) == len(want)

    order = lambda r: hashlib.sha256(f"{r[0]}|{r[1]}".encode()).hexdigest()
    doubt = {}
    for r in rows:
        split = (r[3] >= 2) != (r[6] >= 2)
        why = ["first_second_threshold_disagreement"] * split + ["seed_threshold_conflict_with_ai_consensus"] * (not split and r[4] is not None and (r[4] >= 2) != (r[6] >= 2))
        why += ["ai_low_confidence"] * ("low" in (r[5], r[7]))
        if why:
            doubt[r[:2]] = ("required", why)
    calm = sorted((r for r in rows if r[:2] not in doubt), key=order)
    total = math.ceil(len(calm) * rate)
    taken = []
    for k, (positive, critical) in enumerate([(False, False), (True, False), (False, True), (True, True)]):
        own = [r for r in calm if ((r[6] >= 2), r[8]) == (positive, critical)]
        taken += own[: total // 4 + (k < total % 4)]
    taken += [r for r in calm if r not in taken][: total - len(taken)]
    want = doubt | {r[:2]: ("control", ["quality_control_sample"]) for r in taken}
    got = targets.calibrated_review(df, rate).collect()
    assert {(r.query_id, r.candidate_id): (r.tier, r.reasons) for r in got} == want and len(got) == len(want)
    assert sum(r.tier == "control" for r in got) == total


def test_hash_cuts(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("int").alias("stratum"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    all_of = {s: sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(s, 3000, 2)) for s in (0, 1)}
    for a, b in ((1, 700), (1500, 9999), (0, 3)):
        quotas = spark.createDataFrame([(0, a), (1, b), (2, 5)], "stratum int, quota long")
        got = {r.stratum: r.cut for r in targets.hash_cuts(rows, quotas).collect()}
        assert got == {s: all_of[s][min(q, 1500) - 1] for s, q in ((0, a), (1, b)) if q}


def test_odd_rows(spark):
    """Scores that are null raise no disagreement; a rate beyond 1 is refused."""
    df = spark.createDataFrame([(1, "a", None, 2, None, None, None, None, None), (None, "b", 2, 2, 2, "low", 2, "high", True)], SCHEMA)
    assert [r.candidate_id for r in targets.team_review(df, 0.0).collect()] == ["b"]
    assert sorted(r.candidate_id for r in targets.first_judged(df, 0.0).collect()) == ["a", "b"]
    assert [(r.candidate_id, r.tier) for r in targets.calibrated_review(df, 0.0).collect()] == [("b", "required")]
    with pytest.raises(ValueError):
        targets.team_review(df, 1.5)

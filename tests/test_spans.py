"""Span validation against the plain rule: tokens that overlap, spans across bins, one text with most spans."""

import random
from collections import Counter, defaultdict

import pytest

from quern.operators import spans as P


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def verdict(tokens, start, end):
    near = sorted(t for t in tokens if t[0] < end and t[1] > start)
    if not near:
        return "no_morpheme"
    if near[0][0] != start or near[-1][1] != end:
        return "not_token_aligned"
    return None if near[-1][2].startswith("NN") or near[-1][2] in P.NOMINAL else "non_nominal_morpheme"


def greedy(spans):
    kept = []
    for s, e, k in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if not any(s < b and a < e for a, b, _ in kept):
            kept.append((s, e, k))
    return kept


def test_against_plain_rule(spark):
    r = random.Random(9)
    tokens, spans = defaultdict(list), []
    for i in (1, 2, 3):
        at = 0
        while at < 400:
            n = r.choice([1, 2, 3, 90])
            tokens[i].append((at, at + n, r.choice(["NNG", "VV", "XSN", "JX"])))
            if r.random() < 0.1:
                tokens[i].append((at, at + n + 1, "NNP"))  # two readings of one place
            at += n + r.choice([0, 0, 1])
    for k in range(600):
        i = r.choice([1, 1, 1, 1, 2, 3])
        s = r.randrange(420)
        spans.append((k, i, s, s + r.choice([1, 2, 3, 4, 93]), r.choice("abc")))
        if r.random() < 0.5 and (t := r.choice(tokens[i])):
            spans[-1] = (k, i, t[0], t[1], spans[-1][4])
    columns = "span long, id long, start int, end int, key string"
    df = spark.createDataFrame(spans, columns).repartition(3)
    words = spark.createDataFrame([(i, *t) for i, own in tokens.items() for t in own], "id long, start int, end int, tag string")
    want = {k: verdict(tokens[i], s, e) for k, i, s, e, _ in spans}
    assert {x.span: x.reason for x in P.aligned(df, words).collect()} == want
    valid = [x for x in spans if want[x[0]] is None]
    chosen = {i: greedy([(s, e, (key, k)) for k, j, s, e, key in valid if j == i]) for i in (1, 2, 3)}
    keep = {k for own in chosen.values() for _, _, (_, k) in own}
    got = {x.span: x.kept for x in P.chosen(spark.createDataFrame(valid, columns)).collect()}
    assert got == {x[0]: x[0] in keep for x in valid}
    rows = {x.key: x for x in P.term_validation(df, words).collect()}
    for key in "abc":
        mine = [x for x in spans if x[4] == key]
        bad = Counter(want[x[0]] for x in mine if want[x[0]])
        x = rows[key]
        assert (x.no_morpheme, x.not_token_aligned, x.non_nominal_morpheme) == (bad["no_morpheme"], bad["not_token_aligned"], bad["non_nominal_morpheme"])
        assert x.occurrences == sum(y[0] in keep for y in mine) and x.texts == len({y[1] for y in mine if y[0] in keep})
        assert [tuple(e) for e in x.examples] == sorted((y[1], y[2], want[y[0]]) for y in mine if want[y[0]])[:5]

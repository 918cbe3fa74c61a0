"""Relevance of laws and readiness of labels by literals, borders and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import readiness as A
from quern.operators import relevance as R
from quern.operators import sampling as S
from quern.operators import terms as K

LAW, ARTICLE = "law_id string, law_name string, seed boolean", "law_id string, number string, title string, content string, place int"


def test_labels_of_laws(spark):
    laws = [
        ("seed", "도로교통법", True), ("named", "주택임대차보호법", False), ("both", "건축법", False), ("weak", "건축법", False), ("articles", "민법", False), ("two", "민법", False),
        ("warned", "상가 주택임대차법", False), ("noise", "농지법", None), ("nothing", None, None), ("alone", "전세사기 특별법", False),
    ]
    articles = [
        ("named", "1", None, "임차인", 0),
        ("both", "1", "대항력", "대항력 확정일자 근저당권 전세권", 0),
        ("weak", "1", "", "대항력", 0),
        ("articles", "1", "", "주택의 대항력과 확정일자", 0), ("articles", "2", "", "임차인 근저당권 매도인 임대인", 1),
        ("two", "1", "", "주택의 대항력과 확정일자와 근저당권과 임차인 매도인 임대인", 0), ("two", "2", "", "아무것도", 1), ("two", "3", "", "  ", 2), ("two", "4", "", None, 3),
        ("warned", "1", "", "대항력", 0),
        ("orphan", "1", "", "대항력", 0),
    ]
    got = {r.law_id: r for r in R.classified(spark.createDataFrame(laws, LAW), spark.createDataFrame(articles, ARTICLE)).collect()}
    assert {k: (r.label, r.score) for k, r in got.items()} == {
        "seed": (R.DIRECT, 8), "named": (R.DIRECT, 11), "both": (R.DIRECT, 10), "weak": (R.INDIRECT, 4), "articles": (R.DIRECT, 9), "two": (R.INDIRECT, 9),
        "warned": (R.INDIRECT, 10), "noise": (R.NOISE, -2), "nothing": (R.NOISE, 0), "alone": (R.INDIRECT, 8),
    }
    assert got["articles"].core == ["근저당권", "대항력", "확정일자"] and got["articles"].anchor_articles == 2
    assert got["two"].article_count == 2 and got["two"].anchor_articles == 1
    assert got["named"].title_direct == ["주택임대차"] and got["named"].title_supporting == ["주택", "임대차"]
    assert got["nothing"].evidence == [] and got["seed"].evidence == []
    empty = spark.createDataFrame([], ARTICLE)
    assert R.classified(spark.createDataFrame(laws, LAW), empty).where("article_count = 0").count() == len(laws)
    with pytest.raises(ValueError, match="terms"):
        R.term_bits(F.col("x"), tuple(map(str, range(63))))


def test_evidence_by_hand(spark):
    chance, rules = random.Random(3), R.HOUSING
    words = [*rules.core[:6], *rules.supporting[:4], "물", "불", "가나다" * 30]
    rows = [(f"l{chance.randrange(4)}", str(chance.randrange(12)), chance.choice(["", "대항력", None]), " ".join(chance.choices(words, k=chance.randrange(1, 14))), k) for k in range(120)]

    def excerpt(text, terms):
        first = min((text.find(t) for t in terms if t in text), default=0)
        a = max(0, first - 70)
        return ("..." if a else "") + text[a : a + 240] + ("..." if a + 240 < len(text) else "")

    want = {}
    for law, number, title, content, place in rows:
        text = f"{title or ''} {content}"
        core, more = [t for t in rules.core if t in text], [t for t in rules.supporting if t in text]
        if core or more:
            want.setdefault(law, []).append(((-len(core), -len(core + more), number, place), (number, title, core + more, excerpt(content, core + more))))
    want = {law: [r for _, r in sorted(x, key=lambda p: p[0])[:3]] for law, x in want.items()}
    got = R.article_evidence(spark.createDataFrame(rows, ARTICLE).repartition(5), rules).collect()
    assert {r.law_id: [tuple(e) for e in r.evidence] for r in got} == want


RANKED = "model string, query_id long, id long, rank int"


def test_ranking_faults(spark):
    ranked = [("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 2, 10, 1), ("a", 2, 11, 3), ("b", 1, 10, 1), ("b", 1, 10, 2), ("b", 9, 77, 1), ("b", 9, None, None)]
    d = spark.createDataFrame(ranked, RANKED)
    queries, corpus = spark.createDataFrame([(1,), (2,), (2,), (3,)], "query_id long"), spark.createDataFrame([(10,), (11,)], "id long")
    faults = A.ranking_faults(d, queries, corpus, ["a", "b", "c"])
    assert sorted(map(tuple, faults.collect()), key=repr) == sorted(
        [
            ("wrong_ranks", "a", "2", None), ("wrong_ranks", "b", "9", None), ("repeated_hit", "b", "1", "10"), ("unknown_hit", "b", "9", "77"), ("unknown_hit", "b", "9", None), ("unasked_query", "b", "9", None),
            ("missing_query", "c", "1", None), ("missing_query", "b", "2", None), ("missing_query", "c", "2", None), ("missing_query", "a", "3", None), ("missing_query", "b", "3", None), ("missing_query", "c", "3", None),
        ],
        key=repr,
    )
    with pytest.raises(Exception, match="wrong_ranks|repeated|unknown|unasked|missing"):
        A.required_sound(faults).collect()
    one = spark.createDataFrame([(1,)], "query_id long")
    assert A.required_sound(A.ranking_faults(d.where("model = 'a' and query_id = 1"), one, corpus, ["a"])).first().sound
    none = A.ranking_faults(d.where("false"), one, corpus, ["a"]).collect()
    assert [tuple(r) for r in none] == [("missing_query", "a", "1", None)]
    assert {r.model: (r.query_count, r.result_counts) for r in A.ranked_models(d).collect()} == {"a": (2, [2]), "b": (2, [2])}


def test_labels_and_readiness(spark):
    labels = spark.createDataFrame([(1, 10, 3), (1, 11, 0), (2, 10, 1), (2, 12, 1), (2, 12, 1), (3, 11, 2)], "query_id long, id long, grade int")
    corpus = spark.createDataFrame([(10,), (11,)], "id long")
    got = sorted((r.fault, r.query_id, r.id) for r in A.label_faults(labels, corpus).select("fault", "query_id", F.coalesce("id", F.lit("")).alias("id")).collect())
    assert got == [("no_positive", "2", ""), ("repeated_label", "2", "12"), ("unknown_label", "2", "12"), ("unknown_label", "2", "12")]
    ranked = spark.createDataFrame([("a", 1, 10, 1), ("b", 1, 10, 2), ("a", 3, 10, 1)], RANKED)
    open_ = labels.where("id = 12").limit(1)
    assert tuple(A.readiness(labels, ranked, open_).first()) == (3, 6, 1, 3, 1, 1, 2, 1, 1, False)
    assert A.readiness(labels, ranked, open_.where("false")).first().final_ready
    assert tuple(A.readiness(labels.where("false"), ranked, open_.where("false")).first()) == (0, 0, 0, 0, 0, 0, 0, 0, 0, True)


def test_merged_hits(spark):
    hits = spark.createDataFrame([(7, "q2", 1), (7, "q1", 4), (7, "q1", 9), (8, "q2", 2), (None, "q1", 1)], "id long, query_id string, rank int")
    got = sorted(map(tuple, A.merged_hits(hits, "id").select("id", "query_id", "rank", "hits", "queries", "best_rank", "first_query").collect()))
    assert got == [(7, "q1", 4, 3, 2, 1, "q1"), (7, "q1", 9, 3, 2, 1, "q1"), (7, "q2", 1, 3, 2, 1, "q1"), (8, "q2", 2, 1, 1, 2, "q2")]


def test_senses_and_terms(spark):
    rows = [(f"t{k:02d}", 2 if k % 3 else 3 + k % 2, (k * 7) % 11) for k in range(30)] + [("one", 1, 1)]
    d = spark.createDataFrame(rows, "key string, senses int, n int")

    def plain(total):
        many = sorted((r for r in rows if r[1] >= 3), key=lambda r: (-r[1], r[2], r[0]))[:total]
        two, left = sorted((r for r in rows if r[1] == 2), key=lambda r: (r[2], r[0])), total - len(many)
        at = [] if not left else [len(two) // 2] if left == 1 else [round(k * (len(two) - 1) / (left - 1)) for k in range(left)]
        return sorted([*many, *(two[i] for i in at)])

    for total in (4, 10, 11, 17, 30):
        assert sorted(map(tuple, S.most_senses_then_spaced(d, "senses", total, "n", "key").collect())) == plain(total)
    with pytest.raises(ValueError, match="two senses"):
        S.most_senses_then_spaced(d, "senses", 31, "n", "key")
    words = spark.createDataFrame([("ab", ["ab"], ["N"]), ("abcd", ["ab", "cd"], ["N", "N"]), ("aabx", ["a", "a", "b", "x"], ["N", "N", "V", "N"]), ("", [], [])], "key string, w array<string>, t array<string>")
    got = {(r.key, r.component): r.methods for r in K.components(words, F.col("t"), F.col("w"), F.col("key"), "^N").collect()}
    assert got == {("abcd", "ab"): ["token"], ("abcd", "cd"): ["token"], ("aabx", "aa"): ["ngram"]}
    t = spark.createDataFrame([("u", False), ("x", True), ("c", True), ("c", None), ("민법", True), ("k", True), ("both", False)], "term string, included boolean")
    picked = K.user_selection(F.col("term"), F.col("included"), ["u", "both"], ["x", "both"], ["c"], F.col("term").endswith("법"))
    assert [tuple(r.s) for r in t.select(picked.alias("s")).collect()] == [
        ("selected", "user_selected"), ("excluded", "user_excluded"), ("excluded", "common_word"), ("excluded", "excluded_before"), ("excluded", "statute_name"), ("selected", "kept_in_doubt"), ("selected", "user_selected"),
    ]

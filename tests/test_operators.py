"""Operators on small rows whose results are known."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import decisions, labels, lexical, matching, metrics, order, review, sampling, stats, structure, terms, validate, vectors
from quern.sources import files
from quern.streaming import state


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_gain(spark):
    d = spark.createDataFrame([(3, 1), (2, 2), (1, 3)], "g int, r int")
    assert math.isclose(d.select(F.sum(metrics.gain(F.col("g"), F.col("r"))).alias("x")).first().x, 7 + 3 / math.log2(3) + 1 / math.log2(4))


def test_query_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 0), ("q", 2, 3), ("q", 3, 1), ("q", 4, 2), *(("q", k, 0) for k in range(5, 11))], "query_id string, rank int, grade int")
    grades = spark.createDataFrame([("q", 3, 1), ("q", 2, 1), ("q", 1, 1)], "query_id string, grade int, n long")
    r = metrics.query_metrics(ranked, grades).first()
    assert (r.recall5, r.recall10, r.mrr10, r.precision10, r.hit10) == (1.0, 1.0, 0.5, 0.2, 1)


def test_group_hits_keeps_the_nearest_chunk(spark):
    hits = spark.createDataFrame([(0, 1, "111", 0.2, 1), (0, 2, "111", 0.1, 2), (0, 3, "222", 0.35, 3), (0, 4, None, 0.01, 4)], "query_id long, id long, document string, distance double, rank int")
    got = vectors.group_hits(hits, 5).orderBy("rank").collect()
    assert [(r.document, r.best_distance, r.matched_chunks, r.rank) for r in got] == [("111", 0.1, 2, 1), ("222", 0.35, 1, 2)]


def test_case_numbers(spark):
    assert one(spark, T.case_number(F.col("t")), t=" 4290 가합 12") == "1957가합12"
    assert one(spark, T.case_list(F.col("t")), t="98다45652,45669 , 2020나3(본소),4(병합), etc") == ["98다45652", "98다45669", "2020나3(본소)", "2020나4(병합)", "etc"]
    p = one(spark, T.case_parts(F.col("t")), t="98다12")
    assert (p.year, p.code, p.serial) == (1998, "다", "12")
    assert one(spark, T.date_of_digits(F.col("t")), t="2021.02.31") == "2021-02-31"
    assert one(spark, T.date_of_digits(F.col("t")), t="2021.13.01") == "날짜 없음"


def test_text(spark):
    assert one(spark, T.match_key(F.col("t")), t="<b>기간제</b> 근로자&amp;Ａ") == "기간제근로자&a"
    assert one(spark, T.article_label(F.lit(3), F.lit("2"))) == "제3조의2"
    assert one(spark, T.lines_normalised(F.col("t")), t=" \n\t ") is None
    assert one(spark, T.preview(F.col("a"), F.col("b")), a=" ", b="x" * 181) == "x" * 177 + "..."
    assert one(spark, T.masked_parameter(F.col("t"), "OC"), t="http://a?OC=key&b=1") == "http://a?OC=***&b=1"


def test_matching():
    a = matching.Automaton(["ab", "abc", "c", "보증"])
    assert sorted(a.find("abc 보증금")) == [(0, 2, "ab"), (0, 3, "abc"), (2, 3, "c"), (4, 6, "보증")]
    assert matching.apart([(0, 2, "ab"), (0, 3, "abc"), (2, 3, "c"), (4, 6, "x")]) == [(0, 3, "abc"), (4, 6, "x")]
    assert matching.inside_word("전세보증", 2, "보증") and not matching.inside_word("보증", 0, "보증")


def test_structure(spark):
    text = "머리【주 문】기각【이 유】가나【결 론】끝"
    assert one(spark, structure.section_until(F.col("t"), "이유"), t=text) == "가나\n결론\n끝"
    assert one(spark, structure.section_until(F.col("t"), "이유", ["결론"]), t=text) == "가나"
    parts = structure.pack("\n".join(f"line {i} " + "x" * 90 for i in range(40)))
    assert all(len(p) <= structure.SIZE for p in parts) and len(parts) > 4
    long = structure.split_long("abc. " * 500)
    assert all(len(p) <= structure.SIZE for p in long) and "".join(long).count("abc") >= 500


def test_labels(spark):
    votes = spark.createDataFrame([(2, 2, 3), (1, 2, 3), (1, None, None), (None, 3, 3)], "a int, b int, c int")
    assert [r.x for r in votes.select(labels.majority([F.col(x) for x in "abc"]).alias("x")).collect()] == [2, None, None, 3]
    a, b = spark.createDataFrame([(1, 0)], "k int, a int"), spark.createDataFrame([(2, 0)], "k int, b int")
    with pytest.raises(Exception, match="same keys"):
        labels.strict_join(a, b, ["k"]).collect()


def test_checks(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        validate.require_unique(d, ["k"]).collect()
    assert one(spark, validate.choice(F.col("t"), ["unrelated", "related"], "none"), t="Related / high") == "related"
    sizes = spark.createDataFrame([([5, 5, 5, 100, 1],)], "s array<bigint>")
    assert sizes.select(stats.batches(F.col("s"), 2, 50).alias("x")).first().x == [0, 0, 1, 2, 3]


def test_evenly_spaced(spark):
    d = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r.id for r in sampling.evenly_spaced(d, 4, ["g"], ["id"]).collect()) == [0, 3, 6, 9]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 2, "v": null}\nbroken\n')
    path = str(tmp_path / "a.jsonl")
    assert [r.k for r in files.json_lines(spark, path, "k int, v string", strict=False).orderBy("k").collect()] == [1, 2]
    with pytest.raises(Exception, match="not a record"):
        files.json_lines(spark, path, "k int, v string").collect()
    for name in ("10", "9", "x"):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps({"k": name}))
    assert [r.k for r in files.json_directory(spark, str(tmp_path / "d"), "k string", limit=3).collect()] == ["9", "10", "x"]
    (tmp_path / "t.csv").write_text("﻿a,b\n1,\"x,y\"\n")
    assert files.csv_table(spark, str(tmp_path / "t.csv")).first().asDict() == {"a": "1", "b": "x,y"}
    rows = spark.createDataFrame([(["a", "b"], ["1"])], "n array<string>, c array<string>").select(F.inline(files.columnar_rows({"n": F.col("n"), "c": F.col("c")})))
    assert [tuple(r) for r in rows.collect()] == [("a", "1"), ("b", "")]
    df = spark.range(5)
    assert files.append_missing(spark, df, str(tmp_path / "p"), "id") == 5
    assert files.append_missing(spark, spark.range(7), str(tmp_path / "p"), "id") == 2
    files.write_review_table(spark.createDataFrame([([1, 2],)], "a array<int>"), str(tmp_path / "r"))
    assert files.csv_table(spark, str(tmp_path / "r")).first().a == "1 | 2"


def test_tree(spark):
    schema = "id int, article array<struct<text:string, paragraph:array<struct<text:string>>>>"
    d = spark.createDataFrame([(7, [("a", [("p",), ("q",)]), ("b", [])])], schema)
    got = {r.node_id: (r.kind, r.parent_node_id, r.text) for r in files.flattened(d, ["article", "paragraph"], "id").collect()}
    assert got["law:7:article:0001:paragraph:0002"] == ("paragraph", "law:7:article:0001", "q") and len(got) == 4


def test_sessions_in_a_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").where("user_id < 5")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.session_stream(stream).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = order.greedy_sessions(events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", 1_800_000_000).select("user_id", "event_id", "session")
    assert sorted(map(tuple, spark.sql("select user_id, event_id, session from sessions").collect())) == sorted(map(tuple, want.collect()))


# ---- chunks, excerpts, terms, decisions ----


def test_units_and_chunks():
    intro, short, long = "상고이유를 본다", "짧은 문단.", "긴 문단이다. " * 40
    units = structure.units(f"{intro}\n\n{long}\n{short}\n{short}\n{long}")
    assert units[0] == f"{intro}\n{long.strip()}" and units[1] == f"{short}\n{short}" and units[2] == long.strip()
    assert structure.units(f"{long}\n{intro}") == [f"{long.strip()}\n{intro}"]
    assert structure.units("") == [] and structure.pack("") == []
    cut = structure.split_long("문장 하나다. " * 200, 800, 0)
    assert all(len(c) <= 800 and c.endswith("다.") for c in cut) and "".join(cut).replace(" ", "") == ("문장 하나다. " * 200).replace(" ", "")
    chunks = structure.pack("\n".join(f"{k} " + "가" * 300 for k in range(8)), 800, 120)
    assert all(len(c) <= 800 for c in chunks) and [c for c in chunks if c.startswith("0 ")] == chunks[:1]
    assert chunks[1].split("\n")[0] == "가" * 120  # the end of the chunk before
    body = "이유 " * 300
    assert structure.without_signatures(body + "\n재판장 판사 홍길동") == (body.rstrip(), True)
    assert structure.without_signatures("가나다라\n대법관 홍길동 김철수 이영희") == ("가나다라\n대법관 홍길동 김철수 이영희", False)  # too little would remain
    assert structure.without_signatures("") == ("", False)


def test_excerpts(spark):
    text = "a" * 3000 + " key " + "b" * 3000
    df = spark.createDataFrame([(text,), ("short",), (None,)], "text string")
    cut = review.excerpts(["zzz"], ["KEY"], 1000, (300, 3), (100, 5), (50, 50), (20, 30), 8)
    whole, short, none = [r.e for r in df.select(cut("text").alias("e")).collect()]
    assert whole.text == f"[이유 발췌 1: 0~300]\n{'a' * 300}\n\n...\n\n[이유 발췌 2: 2981~3034]\n{text[2981:3034]}\n\n...\n\n[이유 발췌 3: 5905~6005]\n{'b' * 100}"
    assert (whole.windows, short.text, none.text) == (3, "short", "")


def test_text_columns(spark):
    df = spark.createDataFrame([("１２ Ａb　c", "제1장 총칙", "전원합의체판결: 가", "가&copy;&#44032;나")], "a string, b string, c string, d string")
    r = df.select(T.term_key("a").alias("k"), T.heading_label(F.col("b")).alias("l"), T.heading_level(F.col("b")).alias("v"), T.judgment_type(F.col("c")).alias("j"), T.entities(F.col("d")).alias("e"), T.low_substance(F.lit("무변론 판결")).alias("s"), T.evidence_in(F.lit("가, 나"), F.lit("x가 나y")).alias("i"), T.evidence_in(F.lit("가"), F.lit("가")).alias("n")).first()
    assert tuple(r) == ("12abc", "제1장", "chapter", "전원합의체 판결 : 가", "가©가나", True, True, False)


def test_component_cover(spark):
    df = spark.createDataFrame([("abcabd", ["ab", "abc", "bd", "b", "x", ""]), ("", ["a"]), ("zz", None)], "parent string, components array<string>")
    assert [tuple(r) for r in terms.cover(df).collect()] == [("abcabd", "abc", 0, 3), ("abcabd", "ab", 3, 5)]


def test_preferred_sample(spark):
    rows = [(k, f"q{k % 5}", "32"[k % 2]) for k in range(20)]
    df = spark.createDataFrame(rows, "n int, q string, g string")
    got = [r.n for r in sampling.preferred(df, F.col("g"), ["3", "2"], 7, "q", ["n"]).collect()]
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6]
    got = [r.n for r in sampling.preferred(df.where("q = 'q0'"), F.col("g"), ["3"], 3, "q", ["n"]).collect()]
    assert sorted(got) == [0, 5, 10]  # two of the cell (0, 10), then the first that is left


def test_decisions_that_fail(spark):
    base = spark.createDataFrame([(1, 2), (2, 0)], "k int, grade int")
    for bad in (spark.createDataFrame([(3, 1)], "k int, grade int"), spark.createDataFrame([(1, 5)], "k int, grade int"), spark.createDataFrame([(1, 1), (1, 1)], "k int, grade int")):
        with pytest.raises(Exception, match="resolution|duplicate"):
            decisions.resolved(base, bad, ["k"]).collect()
    with pytest.raises(Exception, match="does not start"):
        decisions.with_additions(base, spark.createDataFrame([(1, 0, 3)], "k int, from int, to int"), base.where("false"), ["k"]).collect()
    with pytest.raises(Exception, match="duplicate"):
        decisions.combined([("a", base), ("b", base)], ["k"]).collect()


def test_best_bm25_equals_all_scores(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 30))]) for i in range(200)], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(q, [f"w{rng.randrange(60)}" for _ in range(6)]) for q in range(12)] + [(12, ["none"])], "query_id long, tokens array<string>")
    all_of = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(queries, docs).collect()}
    want = {}
    for q in range(13):
        order = sorted(range(200), key=lambda d: (-all_of.get((q, d), 0.0), d))[:5]
        want |= {(q, d): (k + 1, all_of.get((q, d), 0.0)) for k, d in enumerate(order)}
    got = {(r.query_id, r.doc_id): (r.rank, r.score) for r in lexical.best_bm25(queries, docs, 5).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert lexical.best_bm25(queries.where("false"), docs, 5).count() == 0 and lexical.best_bm25(queries, docs.where("false"), 5).count() == 0


def test_survey_ids():
    from quern.plans import catalog

    ids = catalog.covered()
    assert len(ids) >= 200 and all(n in catalog.queries() for names in ids.values() for n in names)

"""Checks of summaries by literals."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import summaries as S

LONG = "법원은 " * 50  # 200 characters


def payload(**fields):
    return json.dumps({k: v for k, v in fields.items() if v is not None}, ensure_ascii=False)


CHECKED = [
    (payload(판례일련번호=7, 생성요약=LONG), ("7", 199, None, [])),
    (payload(판례일련번호="", precedent_id=" 7 ", 생성요약=LONG), ("7", 199, None, [])),
    (payload(precedent_id="8", 생성요약="이 판례는 했습니다"), ("7", 10, None, ["id_corrected", "banned_opening", "polite_style", "too_short"])),
    (payload(precedent_id="7", 생성요약=LONG + "대법원 <b>2020다1</b> " + LONG), ("7", 410, None, ["too_long", "over_recommended", "has_case_number", "has_court"])),
    (payload(precedent_id="7", 생성요약=LONG + "가" * 40), ("7", 240, None, ["over_recommended"])),
    (payload(precedent_id="7", 생성요약="<p>&nbsp;</p>"), ("7", 0, "empty", [])),
    ("no json", ("7", 0, "empty", [])),
    (None, ("7", 0, "empty", [])),
]


def test_summary_check(spark):
    d = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CHECKED)], "i int, p string")
    got = d.select("i", S.summary_check(F.col("p"), F.lit("7"), F.lit("2020다1"), F.lit(" 대법원 "), F.lit(None).cast("string")).alias("c")).orderBy("i").collect()
    for r, (p, want) in zip(got, CHECKED, strict=True):
        assert (r.c.precedent_id, r.c.chars, r.c.error, r.c.warnings) == want, p


EASY = [
    (payload(precedent_id="7", easy_summary="가" * 80, explained_difficult_terms=[]), ([], [])),
    (payload(precedent_id=7, easy_summary="가 \t나\r\n\r\n다", explained_difficult_terms=[{"term": "a"}]), ([], ["review_too_short:6"])),
    (payload(precedent_id="7", easy_summary="이 판례는 " + "가" * 700 + "입니다", explained_difficult_terms="[]"), (["too_long:709", "starts_with_this_precedent", "formal_polite_style", "explained_difficult_terms_not_list"], [])),
    (payload(easy_summary=" \n\n ", explained_difficult_terms=None), (["precedent_id_mismatch", "empty_easy_summary", "explained_difficult_terms_not_list"], [])),
    ("[", (["precedent_id_mismatch", "empty_easy_summary", "explained_difficult_terms_not_list"], [])),
]


def test_easy_summary_check(spark):
    d = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(EASY)], "i int, p string")
    got = d.select("i", S.easy_summary_check(F.col("p"), F.lit("7")).alias("c")).orderBy("i").collect()
    for r, (p, want) in zip(got, EASY, strict=True):
        assert (r.c.errors, r.c.warnings) == want, p


@pytest.mark.parametrize("text,want", [("a  b \n c", "a b\nc"), ("a\r\rb\n\n\n\nc", "a\n\nb\n\nc"), ("a\n \nb", "a\n\nb"), ("  \n\n ", ""), (None, "")])
def test_paragraphs(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.paragraphs(F.col("t"))).first()[0] == want

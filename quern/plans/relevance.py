"""Relevance of laws: conversations as laws with planted names and terms of housing law, their turns as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import relevance as R
from quern.plans.catalog import query
from quern.tables import load

#: Names of laws, by conversation, and what is planted in the turns.
NAMES = ["주택임대차보호법", "건축법", "부동산등기법", "농지법", "상가건물 임대차보호법", "민법", "전세사기 피해자 지원법", "도로교통법"]
PLANTED = ["", "임차인의 대항력", "확정일자", "", "공장", "매도인과 가압류", "", "주택의 우선변제권", "임대차보증금", ""]


def laws(spark, sf_dir) -> DataFrame:
    """(law_id, law_name, seed): every eleventh conversation is a seed."""
    c, n = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("law_id")).distinct(), F.col("law_id")
    return c.select("law_id", F.get(F.array(*map(F.lit, NAMES)), (n % len(NAMES)).cast("int")).alias("law_name"), (n % 11 == 5).alias("seed"))


def articles(spark, sf_dir) -> DataFrame:
    """(law_id, number, title, content, place): a turn with a planted term between two copies of its text."""
    planted = F.get(F.array(*map(F.lit, PLANTED)), ((F.col("conv_id") * 3 + F.col("turn")) % len(PLANTED)).cast("int"))
    content = F.concat_ws(" ", "text", planted, "text")
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("law_id"), F.col("turn").cast("string").alias("number"), F.col("role").alias("title"), content.alias("content"), F.hash("text").alias("place"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _found(text: str, terms) -> str:
    return f"list_filter({_list(terms)}, lambda x: contains({text}, x))"


H = R.HOUSING
LAWS = f"""
WITH l AS (SELECT DISTINCT conv_id AS law_id, ({_list(NAMES)})[conv_id % {len(NAMES)} + 1] AS law_name, conv_id % 11 = 5 AS seed FROM conversations),
a0 AS (SELECT conv_id AS law_id, turn, role AS title, trim(concat_ws(' ', text, ({_list(PLANTED)})[(conv_id * 3 + turn) % {len(PLANTED)} + 1], text), ' ') AS content FROM conversations),
a AS (SELECT *, {_found("title || ' ' || content", H.core)} AS c, {_found("title || ' ' || content", H.supporting)} AS s, len({_found("title || ' ' || content", H.anchors)}) > 0 AS anchor FROM a0 WHERE content <> ''),
f AS (SELECT law_id, list_sort(list_distinct(flatten(list(c)))) AS core, list_sort(list_distinct(flatten(list(s)))) AS supporting, count(*) FILTER (anchor AND len(c) + len(s) > 0) AS anchor_articles, count(*) AS article_count FROM a GROUP BY 1),
t AS (SELECT l.*, f.* EXCLUDE (law_id), {_found("law_name", H.direct_title)} AS d, {_found("law_name", H.supporting_title)} AS u, {_found("law_name", H.warnings)} AS w FROM l JOIN f USING (law_id)),
s AS (SELECT *, CASE WHEN seed THEN 8 ELSE 0 END + 6 * len(d) + 2 * len(u) + 2 * len(core) + len(supporting) - 2 * len(w) AS score FROM t)
"""


@query(LAWS + f"""
SELECT law_id, law_name, score, array_to_string(core, ',') AS core, array_to_string(supporting, ',') AS supporting, array_to_string(w, ',') AS warnings, anchor_articles, article_count,
  CASE WHEN seed OR (len(w) = 0 AND ((len(d) > 0 AND len(core) + len(supporting) > 0) OR (len(u) > 0 AND len(core) > 0 AND score >= 9) OR (len(core) >= 3 AND anchor_articles >= 2 AND score >= 9))) THEN '{R.DIRECT}'
       WHEN score >= 2 AND len(core) + len(supporting) + len(u) > 0 THEN '{R.INDIRECT}' ELSE '{R.NOISE}' END AS label FROM s
""", "V-17")
def law_relevance(spark, sf_dir):
    got = R.classified(laws(spark, sf_dir), articles(spark, sf_dir))
    joined = (F.array_join(c, ",").alias(c) for c in ("core", "supporting", "warnings"))
    return got.select("law_id", "law_name", "score", *joined, "anchor_articles", "article_count", "label")


@query(LAWS + """, m AS (SELECT *, list_concat(c, s) AS matched FROM a WHERE len(c) + len(s) > 0),
p AS (SELECT *, coalesce(list_min(list_filter(list_transform(matched, lambda x: strpos(content, x) - 1), lambda x: x >= 0)), 0) AS first, row_number() OVER (PARTITION BY law_id ORDER BY len(c) DESC, len(matched) DESC, turn::VARCHAR) AS place FROM m)
SELECT law_id, turn::VARCHAR AS number, place::INT AS place, array_to_string(matched, ',') AS matched,
  CASE WHEN first > 70 THEN '...' ELSE '' END || substring(content, greatest(first - 70, 0) + 1, 240) || CASE WHEN greatest(first - 70, 0) + 240 < length(content) THEN '...' ELSE '' END AS excerpt FROM p WHERE place <= 3
""", "V-17 W-12")
def law_evidence(spark, sf_dir):
    got = R.classified(laws(spark, sf_dir), articles(spark, sf_dir)).select("law_id", F.posexplode("evidence").alias("place", "e"))
    return got.select("law_id", "e.number", (F.col("place") + 1).alias("place"), F.array_join("e.matched", ",").alias("matched"), "e.excerpt")

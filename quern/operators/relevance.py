"""Relevance of laws to a field by weighted terms of their titles and articles, with the articles that show it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Terms of titles and articles, at most 62 a kind, and what each is worth."""

    direct_title: tuple[str, ...]
    supporting_title: tuple[str, ...]
    core: tuple[str, ...]
    supporting: tuple[str, ...]
    anchors: tuple[str, ...]
    warnings: tuple[str, ...]
    seed_score: int = 8
    direct_title_score: int = 6
    supporting_title_score: int = 2
    core_score: int = 2
    supporting_score: int = 1
    warning_score: int = -2
    direct_from: int = 9
    indirect_from: int = 2
    most_evidence: int = 3
    most_excerpt: int = 240


#: Labels, and the terms of housing law.
DIRECT, INDIRECT, NOISE = "직접 관련", "간접 관련", "노이즈 가능"
HOUSING = Rules(
    direct_title=("주택임대차", "부동산등기", "부동산 거래신고", "공인중개사", "공동주택", "집합건물", "전세사기", "임대주택", "주택도시기금", "부동산 실권리자"),
    supporting_title=("주택", "부동산", "임대차", "전세", "등기", "건축", "주거"),
    core=(
        "임대차보증금", "보증금반환", "대항력", "우선변제권", "최우선변제권", "임차권등기명령", "계약갱신요구권", "묵시적 갱신", "확정일자",
        "주택 임대차 계약 신고", "중개대상물 확인·설명", "소유권이전등기", "근저당권", "전세권", "신탁등기", "장기수선충당금", "전세보증금반환보증", "전세사기",
    ),
    supporting=("주거용 건물", "임대인", "임차인", "매도인", "매수인", "임대차계약", "매매계약", "보증금 반환", "계약의 해제", "소유권 이전", "중개대상물", "채권최고액", "가압류", "압류", "가등기"),
    anchors=("주택", "주거용", "임대차", "임대인", "임차인", "매도인", "매수인", "부동산"),
    warnings=("상가", "권리금", "공장", "산업단지", "농지", "임야", "도시개발", "재개발", "재건축", "정비사업", "분양권", "입주권", "토지수용"),
)


def found(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that stand in a text, in the order of the list."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def term_bits(text: Column, terms: tuple[str, ...]) -> Column:
    """A bit for each term that stands in a text, so that the terms of many texts are a bit_or, combined before the shuffle."""
    if not 0 < len(terms) <= 62:
        raise ValueError(f"1 to 62 terms, not {len(terms)}")
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(t)), F.lit(1 << i)).otherwise(0).cast("long") for i, t in enumerate(terms)))


def of_bits(bits: Column, terms: tuple[str, ...]) -> Column:
    """The terms of bits, in code-point order."""
    return F.array_sort(F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, t) for i, t in enumerate(terms))), F.isnotnull))


def about(text: Column, terms: Column, most: int) -> Column:
    """Up to `most` characters of a text from a little before the first term on, with ... where it goes on; its beginning without a term."""
    places = F.filter(F.transform(terms, lambda t: F.position(t, text) - 1), lambda p: p >= 0)
    first = F.coalesce(F.array_min(places), F.lit(0))
    begin = F.greatest(F.lit(0), first - min(70, most // 3))
    part = F.substring(text, begin + 1, F.lit(most))
    return F.concat(F.when(begin > 0, "...").otherwise(""), part, F.when(begin + most < F.length(text), "...").otherwise(""))


def article_evidence(articles: DataFrame, rules: Rules) -> DataFrame:
    """(law_id, evidence): of each law's articles with a core or supporting term the first by core terms, all terms, number and place.

    evidence: array of (number, title, matched, excerpt), best first. Articles are ranked within their partition before they
    are shuffled, so a law of any number of articles sends most_evidence of each partition.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "content")
    core, more = found(text, rules.core), found(text, rules.supporting)
    d = articles.select("law_id", "number", "title", "content", "place", F.concat(core, more).alias("matched"), F.size(core).alias("_core")).where(F.size("matched") > 0)
    d = d.select("law_id", "number", "title", "place", "matched", "_core", about(F.col("content"), F.col("matched"), rules.most_excerpt).alias("excerpt"))
    best = Window.partitionBy("law_id").orderBy(F.desc("_core"), F.desc(F.size("matched")), "number", "place")
    d = d.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rules.most_evidence)
    rows = F.array_sort(F.collect_list(F.struct("_n", "number", "title", "matched", "excerpt")))
    return d.groupBy("law_id").agg(F.transform(rows, lambda r: F.struct(r["number"].alias("number"), r["title"].alias("title"), r["matched"].alias("matched"), r["excerpt"].alias("excerpt"))).alias("evidence"))


def classified(laws: DataFrame, articles: DataFrame, rules: Rules = HOUSING) -> DataFrame:
    """Laws (law_id, law_name, seed: boolean) with score and label by their names and articles (law_id, number, title, content, place).

    Each distinct term counts once a law. Direct: a seed; or, without a term of another field in the name, a direct term there
    and any in an article, or a supporting one there with a core one in an article and enough score, or three core terms, two
    articles with anchors and enough score. Indirect: enough score and a supporting term in the name or any in an article.
    Blank articles do not count; a law without articles is judged by its name. A null name is empty, a null seed none.
    """
    name, seed = F.coalesce("law_name", F.lit("")), F.coalesce("seed", F.lit(False))
    d = articles.withColumn("content", F.trim(F.coalesce("content", F.lit("")))).where("content <> ''")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "content")
    bits = d.select("law_id", *(term_bits(text, terms).alias(c) for c, terms in (("_core", rules.core), ("_more", rules.supporting), ("_anchors", rules.anchors))))
    hit = (F.col("_core") != 0) | (F.col("_more") != 0)
    facts = bits.groupBy("law_id").agg(F.bit_or("_core").alias("_core"), F.bit_or("_more").alias("_more"), F.count_if(hit & (F.col("_anchors") != 0)).alias("anchor_articles"), F.count(F.lit(1)).alias("article_count"))
    out = laws.select("law_id", "law_name", seed.alias("seed"), found(name, rules.direct_title).alias("title_direct"), found(name, rules.supporting_title).alias("title_supporting"), found(name, rules.warnings).alias("warnings"))
    out = out.join(facts, "law_id", "left").join(article_evidence(d, rules), "law_id", "left").fillna(0, ["_core", "_more", "anchor_articles", "article_count"])
    n = lambda c: F.size(c)
    cores, others = F.bit_count("_core"), F.bit_count("_more")
    worth = [(n("title_direct"), rules.direct_title_score), (n("title_supporting"), rules.supporting_title_score), (cores, rules.core_score), (others, rules.supporting_score), (n("warnings"), rules.warning_score)]
    score = reduce(lambda a, b: a + b, (c * w for c, w in worth), F.when(F.col("seed"), rules.seed_score).otherwise(0))
    out = out.withColumn("score", score)
    enough, any_term = F.col("score") >= rules.direct_from, (cores > 0) | (others > 0)
    by_name = (n("title_direct") > 0) & any_term
    by_both = (n("title_supporting") > 0) & (cores > 0) & enough
    by_articles = (cores >= 3) & (F.col("anchor_articles") >= 2) & enough
    direct = F.col("seed") | ((n("warnings") == 0) & (by_name | by_both | by_articles))
    indirect = (F.col("score") >= rules.indirect_from) & (any_term | (n("title_supporting") > 0))
    label = F.when(direct, DIRECT).when(indirect, INDIRECT).otherwise(NOISE)
    none = F.expr("cast(array() as array<struct<number:string,title:string,matched:array<string>,excerpt:string>>)")
    return out.select(
        "law_id", "law_name", "seed", label.alias("label"), "score", "title_direct", "title_supporting", of_bits(F.col("_core"), rules.core).alias("core"),
        of_bits(F.col("_more"), rules.supporting).alias("supporting"), "warnings", "anchor_articles", "article_count", F.coalesce("evidence", none).alias("evidence"),
    )

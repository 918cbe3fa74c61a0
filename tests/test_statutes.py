"""Laws as XML: nodes, links and chunks of small documents, by literals."""

import pytest
from pyspark.sql import functions as F

from quern.operators import statutes as L

LAW = """<?xml version="1.0" encoding="UTF-8"?>
<법령 법령키="k1"><기본정보><법령ID>001234</법령ID><법령명_한글>주택법</법령명_한글><시행일자>20240101</시행일자></기본정보><조문>
<조문단위 조문키="a"><조문여부>전문</조문여부><조문번호>1</조문번호><조문내용>  제1장 총칙 </조문내용></조문단위>
<조문단위 조문키="b"><조문여부>조문</조문여부><조문번호>1</조문번호><조문제목>목적</조문제목><조문내용>제1조(목적) 이 법은 &lt;img src="x"&gt;그림&lt;/img&gt; 정한다.</조문내용></조문단위>
<조문단위><조문여부>전문</조문여부><조문내용>제1절 통칙</조문내용></조문단위>
<조문단위><조문여부>전문</조문여부><조문내용>별도 표제</조문내용></조문단위>
<조문단위><조문여부>조문</조문여부><조문번호>2</조문번호><조문가지번호>3</조문가지번호><조문시행일자>20250101</조문시행일자>
<항><항번호>①</항번호><항내용>①  첫째
 항</항내용><호><호번호>1.</호번호><호내용>1. 호</호내용><목><목번호>가.</목번호><목내용>가. 목</목내용></목></호></항><항><호><호번호>1.</호번호></호></항></조문단위>
<조문단위><조문여부>전문</조문여부><조문내용>제2장 보칙</조문내용></조문단위>
<조문단위><조문여부>조문</조문여부><조문번호>3</조문번호></조문단위>
</조문></법령>"""


@pytest.fixture(scope="module")
def laws(spark):
    return L.parsed_laws(spark.createDataFrame([(LAW,)], "raw string"))


def test_nodes(laws):
    got = {r.node_id: r for r in L.law_nodes(laws).collect()}
    at = "law:001234:"
    assert set(got) == {at + x for x in ("heading:0001", "heading:0002", "heading:0003", "heading:0004", "article:0001", "article:0002", "article:0003", "paragraph:0002:0001", "paragraph:0002:0002", "subparagraph:0002:0001:0001", "subparagraph:0002:0002:0001", "item:0002:0001:0001:0001")}
    assert got[at + "article:0001"].text == "제1조(목적) 이 법은 정한다."
    assert (got[at + "heading:0001"].level, got[at + "heading:0003"].level) == ("chapter", "unknown")
    assert got[at + "article:0002"].heading_path == [at + "heading:0001", at + "heading:0002", at + "heading:0003"]
    assert got[at + "article:0003"].heading_path == [at + "heading:0003", at + "heading:0004"]
    assert got[at + "article:0002"].label == "제2조의3"
    assert got[at + "paragraph:0002:0001"].text == "① 첫째\n항"
    assert (got[at + "item:0002:0001:0001:0001"].parent_node_id, got[at + "subparagraph:0002:0002:0001"].text) == (at + "subparagraph:0002:0001:0001", None)


def test_links(laws):
    nodes = L.law_nodes(laws)
    assert L.link_faults(nodes).count() == 0
    bad = nodes.where("node_id not like '%heading:0002' and kind <> 'subparagraph'").union(nodes.where("kind = 'item'"))
    got = sorted((r.fault, r.other) for r in L.link_faults(bad).collect())
    assert got == [("duplicate_id", None), ("missing_heading", "law:001234:heading:0002"), ("missing_parent", "law:001234:subparagraph:0002:0001:0001"), ("missing_parent", "law:001234:subparagraph:0002:0001:0001")]


def test_chunks(spark, laws):
    articles = L.articles_of(laws)
    assert {r.label: (r.has_image, r.effective_date) for r in articles.collect()} == {"제1조": (True, "20240101"), "제2조의3": (False, "20250101"), "제3조": (False, "20240101")}
    groups = spark.createDataFrame([("law:001234:article:0002", [[1], [2]])], "node_id string, groups array<array<int>>")
    got = L.article_chunks(articles, groups)
    by_id = {(r.chunk_type, r.chunk_id): r for r in got.collect()}
    assert by_id["article", "law:001234:article:0001"].retrieval_text == "법령: 주택법\n구조: 제1장 총칙\n조문: 제1조(목적)\n\n본문:\n이 법은 정한다."
    assert by_id["article_part", "law:001234:article:0002:part:01"].retrieval_text.endswith("조문: 제2조의3\n\n본문:\n① 첫째\n항\n1. 호\n가. 목")
    assert by_id["article_part", "law:001234:article:0002:part:02"].paragraph_orders == [2]
    assert by_id["paragraph_child", "law:001234:paragraph:0002:0001"].retrieval_text.split("\n")[3] == "검색 단위: 제2조의3 ①"
    assert ("article_child", "law:001234:article:0001:child") in by_id and ("excluded", None) in by_id
    assert set(L.chunk_faults(got).first()) == {0}
    faults = L.chunk_faults(got.where("chunk_type <> 'article_parent' or chunk_id like '%1'").union(got.where("chunk_type = 'article_child'"))).first()
    assert (faults.duplicate_child_ids, faults.missing_parents) == (1, 1)
    with pytest.raises(Exception, match="each once"):
        L.article_chunks(articles, spark.createDataFrame([("law:001234:article:0002", [[1], [1]])], groups.schema)).collect()


@pytest.mark.parametrize(("change", "what"), [(("법령 ", "법 "), "no law"), (("<조문여부>전문", "<조문여부>다른"), "unknown kind"), (("<조문번호>3</조문번호>", ""), "without a number"), (("<법령ID>001234</법령ID>", "<법령ID> </법령ID>"), "without id")])
def test_refused(spark, change, what):
    with pytest.raises(Exception, match=what):
        L.parsed_laws(spark.createDataFrame([(LAW.replace(*change),)], "raw string")).collect()


def test_lost_heading(laws):
    with pytest.raises(Exception, match="no such heading"):
        L.articles_of(laws.withColumn("headings", F.filter("headings", lambda h: h["ord"] > 1))).collect()

"""Rules by literals: which document a chunk is of, model orders and their guards, case keys, text cleaning."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import metrics, review, vectors


def test_document_of(spark):
    rows = [("1", "2", "precedent:3:a"), (" ", "2", "precedent:3:a"), (None, "", "precedent:3:a:0"), (None, None, "precedent:3"), (None, None, "chunk:3:a"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r.d for r in df.select(vectors.document_of(F.col("a"), F.col("b"), F.col("c")).alias("d")).collect()] == ["1", "2", "3", None, None, None]
    hits = spark.createDataFrame([(1, "x", 1, 0.3, 1), (1, "y", 2, 0.2, 2), (1, "x", 3, 0.2, 3), (1, None, 4, 0.1, 4)], "query_id int, document string, id int, distance double, rank int")
    got = [(r.document, r.best_chunk, r.matched_chunks, r.rank) for r in vectors.group_hits(hits, 5).orderBy("rank").collect()]
    assert got == [("x", 3, 2, 1), ("y", 2, 1, 2)]  # of equal distances the document that came first


def test_model_order(spark):
    rows = [("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 0.9), ("b", 2, 0.9), ("c", 1, 1.0), ("c", 2, 0.5)]
    d = spark.createDataFrame(rows, "model string, query_id int, recall10 double")
    d = d.select("model", "query_id", "recall10", *(F.col("recall10").alias(c) for c in ("recall5", "mrr10", "ndcg10", "precision10", "hit10")))
    critical = metrics.model_order(d, F.col("query_id") == 1)
    assert [(r.model, r.incomplete) for r in critical.orderBy("place").collect()] == [("a", 0), ("c", 0), ("b", 1)]
    plain = metrics.model_order(d, F.lit(False))
    assert [r.model for r in plain.orderBy("place").collect()] == ["b", "a", "c"]
    assert metrics.order_changed(critical, plain).first().changed and not metrics.order_changed(plain, plain).first().changed
    with pytest.raises(Exception, match="different queries"):
        metrics.model_order(d.where("model <> 'a' or query_id = 1"), F.lit(False)).collect()


def test_full_hits(spark):
    d = spark.range(10).selectExpr("1 as query_id", "id")
    assert metrics.full_hits(d).count() == 10
    with pytest.raises(Exception, match="fewer than 10 hits: 1"):
        metrics.full_hits(d.where("id > 0")).collect()


def test_case_key(spark):
    df = spark.createDataFrame([(" 2019다 1\t23 ", 7), ("2019다123", 8), ("  ", 9), (None, 9)], "n string, i int")
    assert [r.k for r in df.select(review.case_key(F.col("n"), F.col("i")).alias("k")).collect()] == ["2019다123", "2019다123", "precedent:9", "precedent:9"]


def test_cleaning(spark):
    raw = "x\\r\\ny\tz\x0bq\\tr<BR>s</P >t&nbsp;u<b>v</b>&lt;w&gt;\r\n\r\n\r\n\r\nend "
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(T.chunk_normalised(F.col("t")).alias("c"), T.body_normalised(F.col("t")).alias("b")).collect()
    assert got[0].c == "x\ny z q r\ns\nt u v <w>\n\nend"
    assert got[0].b == "x\\r\\ny z q\\tr\ns\nt u v <w> \n \n \n \nend"
    assert (got[1].c, got[1].b) == ("", "")
    laws = spark.createDataFrame([("a <IMG\nsrc='x'>그림</Img> b </img> <imgx>c",)], "t string")
    assert laws.select(T.lines_normalised(F.col("t")).alias("t")).first().t == "a b <imgx>c"


def test_heading_levels(spark):
    rows = [("제1편", "part"), ("제 1편 총칙", "part"), ("제2장의2 보칙", "chapter"), ("제3절", "section"), ("제1관", "subsection"), ("제편", "unknown"), ("제1조\n제2장", "unknown"), (" 제1장", "unknown")]
    df = spark.createDataFrame(rows, "t string, v string")
    assert all(r.v == r.got for r in df.withColumn("got", T.heading_level(F.col("t"))).collect())

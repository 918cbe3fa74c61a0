"""Queries of chunking strategies, headings and article texts. Documents stand for reasons, conversations for articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import structure as S
from quern.plans.catalog import query
from quern.tables import load


#: Headings as laws have them, with the level and label that each must get.
HEADINGS = [("제1편 총칙", "part", "제1편"), ("제 1편 총칙", "part", "제 1편"), ("제2장 계약의 절차", "chapter", "제2장"), ("제3절의2 특례", "section", "제3절"), ("제4관 정관", "subsection", "제4관"), ("부칙 제1편", "unknown", None), ("제편", "unknown", None)]


@query("WITH t AS (SELECT conv_id, turn, turn % 7 AS k FROM conversations) SELECT conv_id, turn, CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v, _) in enumerate(HEADINGS)) + " END AS level, CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, _, v) in enumerate(HEADINGS) if v) + " END AS label FROM t", "STR-34")
def heading_labels(spark, sf_dir):
    """Levels and labels of headings that stand before the turns' texts, one line each."""
    title = F.element_at(F.array(*(F.lit(h) for h, _, _ in HEADINGS)), (F.col("turn") % 7 + 1).cast("int"))
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(title, F.lit("\n"), "text").alias("t"))
    return d.select("conv_id", "turn", T.heading_level(F.col("t")).alias("level"), T.heading_label(F.col("t")).alias("label"))


@query("""
WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || ' ' || text ELSE text END AS text, role FROM conversations)
SELECT conv_id, turn, nullif(regexp_replace(CASE WHEN starts_with(text, role) THEN substring(text, length(role) + 1) ELSE text END, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '') AS body FROM a
""", "STR-25")
def article_body(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat_ws(" ", "role", "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_heading(text, F.col("role")).alias("body"))


@query("""
SELECT s_suppkey, trim(regexp_replace(regexp_replace('  ' || s_name || '  :' || s_nationkey, '[ ]+', ' ', 'g'), ' ?: ?', ' : ', 'g')) AS kind FROM supplier
""", "STR-14")
def judgment_types(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("s_name"), F.lit("  :"), F.col("s_nationkey").cast("string"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.judgment_type(raw).alias("kind"))


@query("""SELECT p_partkey, trim(regexp_replace(p_name, '[ ]+', ' ', 'g')) || ' ' || p_size AS name FROM part""", "STR-17")
def case_names(spark, sf_dir):
    raw = F.concat(F.lit('"'), F.col("p_name"), F.lit('"  '), F.col("p_size").cast("string"), F.lit("”"))
    return load(spark, sf_dir, "part").select("p_partkey", T.case_name(raw).alias("name"))


@query(None, "CHK-5")
def signatures_cut(spark, sf_dir):
    """Documents with a judge's line at the end, and whether it was cut off."""
    signed = F.concat("text", F.lit("\n재판장 판사 홍길동"))
    d = load(spark, sf_dir, "documents").select("doc_id", signed.alias("text"))
    return d.select("doc_id", S.signatures_cut("text").alias("s")).select("doc_id", F.length("s.text").alias("chars"), "s.cut")


def cases(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("reason", S.signatures_cut(T.chunk_normalised(F.col("text")))["text"])
    first = F.substring_index(F.col("text"), "\n", 1)
    return d.select("doc_id", "reason", T.one_line(first).alias("summary"), F.when(F.col("n_chars") % 3 == 0, "").otherwise(T.chunk_normalised(first)).alias("issue"), F.col("source").alias("holding"))


@query(None, "CHK-6 CHK-2 CHK-3 CHK-4 STR-4")
def case_chunks_a(spark, sf_dir):
    """The reason in chunks and the summary as one."""
    return S.case_chunks(cases(spark, sf_dir), "doc_id", [("reason", "reason", "reason")], [("summary", "summary", "summary")])


@query(None, "CHK-7")
def case_chunks_b(spark, sf_dir):
    """Reason, issue and holding in chunks, the summary as one."""
    split = [("reason", "reason", "reason"), ("issue", "issue", "issue"), ("holding", "holding", "holding")]
    return S.case_chunks(cases(spark, sf_dir), "doc_id", split, [("summary", "summary", "summary")])


@query("""
SELECT conv_id, CAST(turn // 2 AS BIGINT) AS part, count(DISTINCT turn // 2) OVER (PARTITION BY conv_id) AS parts, chunk FROM (SELECT conv_id, turn // 2 * 2 AS turn, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chunk FROM conversations GROUP BY conv_id, turn // 2 * 2)
""", "CHK-9")
def configured_split(spark, sf_dir):
    """Turns dealt to configured parts of two; a configuration that leaves one out, or names another, fails the job."""
    c = load(spark, sf_dir, "conversations")
    groups = c.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("part"))
    return S.split_by_groups(c, "conv_id", "turn", F.concat_ws(": ", "role", "text"), groups)


@query("""
SELECT doc_id, 'no label of its own' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""", "CHK-11")
def excluded_articles(spark, sf_dir):
    """Articles without any node below, with the reason."""
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").withColumn("reason", F.lit("no label of its own"))


@query("""
WITH o AS (SELECT n_nationkey, count(DISTINCT c_custkey) AS articles, count(o_orderkey) AS paragraphs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
i AS (SELECT c_nationkey AS n_nationkey, count(*) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT n_nationkey, articles, paragraphs, coalesce(items, 0) AS items FROM o LEFT JOIN i USING (n_nationkey)
""", "AGG-20")
def structure_counts(spark, sf_dir):
    """Nodes by level of each tree; every level is counted before it meets the one above."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("items").alias("items"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(orders, "c_custkey", "left")
    g = c.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("articles"), F.sum("paragraphs").alias("paragraphs"), F.sum("items").alias("items"))
    return load(spark, sf_dir, "nation").select("n_nationkey").join(g, "n_nationkey", "left").na.fill(0, ["articles", "paragraphs", "items"])


@query("""
SELECT 'precedent:' || doc_id || ':text' AS id, n_chars, CASE WHEN n_chars % 2 = 0 THEN '{"lang":"' || lang || '"}' ELSE lang END AS metadata FROM documents
""", "SNK-4")
def vector_records(spark, sf_dir):
    """Ids and metadata for a vector store, which takes scalars alone: others as JSON."""
    nested = F.to_json(F.struct("lang"))
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("precedent:"), F.col("doc_id").cast("string"), F.lit(":text")).alias("id"), "n_chars", F.when(F.col("n_chars") % 2 == 0, nested).otherwise(F.col("lang")).alias("metadata"))

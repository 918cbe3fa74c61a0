"""Queries of review workflows and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import review as R
from quern.operators import sampling as S
from quern.operators import validate as V
from quern.plans.catalog import query
from quern.tables import load

RULES = [("title", ["page", "fr"], 4, 2), ("text", ["<h1>", "<table", "<ul>", "cookie"], 2, 3)]


@query("""
WITH l AS (SELECT doc_id, toxic AS score, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN doc_id % 5 = 0 THEN 1 - quality END AS seed FROM labels)
SELECT doc_id, score FROM l WHERE score >= 1 OR confidence <> 'high' OR (seed IS NOT NULL AND seed <> score)
""")
def review_targets(spark, sf_dir):
    d = load(spark, sf_dir, "labels").withColumn("confidence", F.when(F.col("doc_id") % 3 == 0, "low").otherwise("high")).withColumn("seed", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")))
    return d.where(R.needs_review(F.col("toxic"), F.col("confidence"), F.col("seed"))).select("doc_id", F.col("toxic").alias("score"))


@query("SELECT unnest([42, 7, 19, 3]) AS doc_id, unnest([0, 1, 2, 3])::INTEGER AS place, unnest([(SELECT n_chars FROM documents WHERE doc_id = 42), (SELECT n_chars FROM documents WHERE doc_id = 7), (SELECT n_chars FROM documents WHERE doc_id = 19), (SELECT n_chars FROM documents WHERE doc_id = 3)]) AS n_chars")
def by_id_list(spark, sf_dir):
    return R.in_list_order(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [42, 7, 19, 3], "doc_id")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type <> 'click') AS others FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY user_id
""")
def nested_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    item = F.struct(F.col("event_type").alias("key"), "event_id")
    d = e.groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "click", item)).alias("clicks"), F.collect_list(F.when(F.col("event_type") != "click", item)).alias("others"))
    out = spark.createDataFrame([("error",), ("view",)], "key string")
    kept = R.without_keys(d, ["clicks", "others"], out)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return kept.select("user_id", n("clicks"), n("others"))


@query("""
WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM f WHERE n = 1 ORDER BY doc_id LIMIT 8
""")
def first_of_each(spark, sf_dir):
    return R.first_of_each(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 8)


@query("""
WITH t AS (SELECT conv_id, turn, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'und') AS INT) AS core, list_filter(['the', 'und', 'que', 'en'], lambda t: contains(text, t)) AS matched FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY core DESC, len(matched) DESC, turn) AS place FROM t WHERE len(matched) > 0)
SELECT conv_id, turn, core, array_to_string(matched, ',') AS matched, place FROM r WHERE place <= 2
""")
def article_evidence(spark, sf_dir):
    d = R.evidence(load(spark, sf_dir, "conversations"), ["conv_id"], ["the", "und"], ["the", "und", "que", "en"], "text", "turn", 2)
    return d.select("conv_id", "turn", "core", F.array_join("matched", ",").alias("matched"), "place")


@query("""
WITH r AS (SELECT user_id, event_type, round(value) AS v, event_id, row_number() OVER (PARTITION BY user_id, coalesce(event_type, ''), coalesce(CAST(CAST(round(value) AS BIGINT) AS VARCHAR), '') ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, CAST(v AS BIGINT) AS v, event_id FROM r WHERE n = 1
""")
def unique_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.round("value").cast("long").alias("v"), "event_id")
    return R.distinct_first(e, ["event_type", "v"], ["user_id"], ["event_id"])


@query("""
SELECT page_id, least(CAST(contains(url, 'page') AS INT) + CAST(contains(url, 'fr') AS INT), 2) * 4 + least(CAST(contains(html, '<h1>') AS INT) + CAST(contains(html, '<table') AS INT) + CAST(contains(html, '<ul>') AS INT) + CAST(contains(html, 'cookie') AS INT), 3) * 2 AS score FROM pages
""")
def relevance_score(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", R.score_by_rules(F.col("html"), F.col("url"), RULES).alias("score"))


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'precedent:' || c_custkey ELSE lower(replace(c_mktsegment, 'U', 'u')) || c_custkey % 3 END AS k, c_acctbal FROM customer), d AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, k ORDER BY c_acctbal DESC, c_custkey) AS n FROM c),
r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM d WHERE n = 1)
SELECT c_nationkey, c_custkey, place FROM r WHERE place <= 5
""")
def dedupe_by_number(spark, sf_dir):
    """The five first cases of each nation, one a number; numbers are alike without white space and case, and a case without one is alone."""
    number = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" \t"), F.col("c_custkey") % 3))
    c = load(spark, sf_dir, "customer").withColumn("k", R.case_key(number, F.col("c_custkey")))
    d = R.distinct_first(c, ["k"], ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return d.withColumn("place", F.row_number().over(w)).where("place <= 5").select("c_nationkey", "c_custkey", "place")


@query("""
WITH v AS (SELECT p_partkey AS id, p_name AS text, p_size AS n FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN length(text) < 9 THEN 'too_short' END, CASE WHEN length(text) > 11 THEN 'too_long' END, CASE WHEN regexp_matches(text, '^(red|blue)') THEN 'banned_opening' END, CASE WHEN contains(text, 'widget') THEN 'leak' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v
""")
def summary_warnings(spark, sf_dir):
    t = F.col("p_name")
    rules = [("too_short", F.length(t) < 9), ("too_long", F.length(t) > 11), ("banned_opening", t.rlike("^(red|blue)")), ("leak", F.contains(t, F.lit("widget")))]
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(V.all_failing(rules), ",").alias("warnings"))


@query("""
WITH p AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, max(turn) AS m, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, n = d AS unique_turns, m = n - 1 AS gapless, CASE WHEN a > 0 THEN 'completed' ELSE 'empty' END AS status FROM p
""")
def ranking_completeness(spark, sf_dir):
    p = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("turn").alias("d"), F.max("turn").alias("m"), F.count_if(F.col("role") == "assistant").alias("a"))
    return p.select("conv_id", (F.col("n") == F.col("d")).alias("unique_turns"), (F.col("m") == F.col("n") - 1).alias("gapless"), F.when(F.col("a") > 0, "completed").otherwise("empty").alias("status"))


@query("""
WITH c AS (SELECT DISTINCT doc_id, (quality = 1) AS p, (toxic = 1) AS c, CASE WHEN quality = 1 THEN 2 ELSE 0 END + toxic AS cell FROM labels),
s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('s' || chr(0) || doc_id::VARCHAR)) AS sample_rank, count(*) OVER (PARTITION BY cell) AS n FROM c)
SELECT doc_id, cell, sample_rank FROM s WHERE sample_rank <= ceil(n * CAST(0.05 AS DOUBLE))
""")
def control_sample(spark, sf_dir):
    d = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("cell")).distinct()
    return S.hash_sample(d, 0.05, "s", ["cell"], ["doc_id"], "up")


@query("""
WITH a AS (SELECT doc_id, quality AS g FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS g FROM labels JOIN documents USING (doc_id) WHERE n_chars >= 400)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.g AS before, b.g AS after, CASE WHEN b.g IS NULL THEN 'removed' WHEN a.g > b.g THEN 'lowered' ELSE 'raised' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.g IS DISTINCT FROM b.g
""")
def review_package(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    a = labels.select("doc_id", F.col("quality").alias("before"))
    long = load(spark, sf_dir, "documents").where("n_chars >= 400").select("doc_id")  # the second review has no short texts
    b = labels.join(long, "doc_id", "left_semi").select("doc_id", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("after"))
    d = a.join(b, "doc_id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return d.withColumn("change", F.when(F.col("after").isNull(), "removed").when(F.col("before") > F.col("after"), "lowered").otherwise("raised"))


@query()
def windowed_excerpt(spark, sf_dir):
    cut = R.excerpts(["<h[1-3]>"], ["the", "que", "und"], 1500, (400, 3), (200, 5), (50, 200), (40, 80), 8)
    return load(spark, sf_dir, "pages").select("page_id", cut("html").alias("e")).select("page_id", "e.text", "e.windows", "e.chars")

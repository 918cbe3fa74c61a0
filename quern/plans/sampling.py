"""Queries that sample, and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import sampling as S
from quern.operators import validate as V
from quern.plans.catalog import query
from quern.tables import load

_H = "sha256('seed' || chr(0) || doc_id::VARCHAR)"


@query(f"""
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H}) AS sample_rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, sample_rank FROM s WHERE sample_rank <= round_even(n * CAST(0.1 AS DOUBLE), 0)
""")
def hash_sample(spark, sf_dir):
    return S.hash_sample(load(spark, sf_dir, "documents").select("doc_id", "source"), 0.1, "seed", ["source"], ["doc_id"])


@query(f"""
WITH d AS (SELECT doc_id, quality * 2 + toxic AS stratum, {_H} AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS r FROM d),
n AS (SELECT stratum, row_number() OVER (ORDER BY stratum) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT stratum FROM d)),
q AS (SELECT stratum, floor(40 / n) + CASE WHEN i <= 40 % n THEN 1 ELSE 0 END AS quota FROM n),
t AS (SELECT doc_id, stratum, r <= quota AS own, h FROM r JOIN q USING (stratum)),
x AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY h, doc_id) AS k FROM t)
SELECT doc_id, stratum, 'quota' AS taken FROM x WHERE own UNION ALL SELECT doc_id, stratum, 'refill' FROM x WHERE NOT own AND k <= 40 - (SELECT count(*) FROM x WHERE own)
""")
def stratified_sample(spark, sf_dir):
    return S.stratified(load(spark, sf_dir, "labels"), F.col("quality") * 2 + F.col("toxic"), 40, "seed", ["doc_id"]).select("doc_id", "stratum", "taken")


@query(f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H}) AS round FROM documents) SELECT doc_id, source, round FROM r ORDER BY round, source LIMIT 70
""")
def round_robin(spark, sf_dir):
    return S.round_robin(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", 70, "seed", ["doc_id"])


@query("""
WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, n_chars FROM d WHERE n <= 7 OR i IN (SELECT round_even(k * (n - 1) / 6, 0) FROM range(7) t(k))
""")
def evenly_spaced(spark, sf_dir):
    return S.evenly_spaced(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 7, ["source"], ["n_chars", "doc_id"])


@query("SELECT source, lang, count(*) AS rows FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return V.duplicates(load(spark, sf_dir, "documents"), ["source", "lang"])


@query("""
SELECT 'orphans' AS "check", (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey)) AS failures
UNION ALL SELECT 'childless', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
UNION ALL SELECT 'duplicate_parents', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_children', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
""")
def link_checks(spark, sf_dir):
    return V.links(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("child")))


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'related' WHEN event_type = 'error' THEN 'uncertain' ELSE 'unrelated' END AS verdict, CASE WHEN value > 60 THEN 'high' WHEN value > 10 THEN 'medium' ELSE 'low' END AS confidence FROM events)
SELECT event_id, verdict, confidence, verdict = 'uncertain' OR confidence = 'low' AS needs_review, CASE WHEN verdict = 'unrelated' THEN 'outside scope' END AS exclusion FROM v
""")
def verdict_normalise(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    raw = e.select("event_id", F.when(F.col("event_type").isin("click", "view"), " Related").when(F.col("event_type") == "error", "???").otherwise("unrelated/other").alias("verdict"), F.when(F.col("value") > 60, "HIGH").when(F.col("value") > 10, "medium").otherwise("").alias("confidence"))
    return V.verdicts(raw)


@query("""
SELECT page_id, CASE WHEN length(html) < 1500 THEN 'too_short' WHEN NOT contains(html, '<article') THEN 'no_body' WHEN contains(html, 'cookie') AND length(html) < 4000 THEN 'boilerplate' ELSE 'included' END AS reason FROM pages
""")
def inclusion_cascade(spark, sf_dir):
    h = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", V.first_failing([("too_short", F.length(h) < 1500), ("no_body", ~F.contains(h, F.lit("<article"))), ("boilerplate", F.contains(h, F.lit("cookie")) & (F.length(h) < 4000))], "included").alias("reason"))

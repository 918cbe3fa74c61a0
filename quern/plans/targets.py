"""Review samples over `orders`: a customer stands for a query, an order for a candidate, and scores come from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import targets as R
from quern.plans.catalog import query
from quern.tables import load


def judged(spark, sf_dir) -> DataFrame:
    """(query_id, candidate_id, human, ai, seed, confidence, second, second_confidence, critical) of every order."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    human = (k % 4).cast("int")
    cents = F.floor(F.col("o_totalprice")).cast("long")
    ai = F.when(k % 11 < 3, cents % 4).otherwise(human).cast("int")
    said = F.when(p.startswith("5"), "low").when(p.startswith("3"), "medium").otherwise("high")
    again = F.when(k % 23 == 0, "low").otherwise("high")
    second = F.when(k % 13 == 0, cents % 3).otherwise(ai).cast("int")
    critical = F.coalesce(F.col("o_custkey") % 10 == 0, F.lit(False))
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("candidate_id"), human.alias("human"), ai.alias("ai"), F.when(k % 3 == 0, human).alias("seed"), said.alias("confidence"), second.alias("second"), again.alias("second_confidence"), critical.alias("critical"))


JUDGED = """WITH o AS (SELECT *, (o_orderkey % 4)::INT AS human, floor(o_totalprice)::BIGINT AS cents FROM orders),
a AS (SELECT *, CASE WHEN o_orderkey % 11 < 3 THEN cents % 4 ELSE human END::INT AS ai FROM o),
j AS (SELECT o_custkey AS query_id, o_orderkey AS candidate_id, human, ai, CASE WHEN o_orderkey % 3 = 0 THEN human END AS seed,
  CASE left(o_orderpriority, 1) WHEN '5' THEN 'low' WHEN '3' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN o_orderkey % 13 = 0 THEN cents % 3 ELSE ai END::INT AS second,
  CASE WHEN o_orderkey % 23 = 0 THEN 'low' ELSE 'high' END AS second_confidence, coalesce(o_custkey % 10 = 0, false) AS critical FROM a),
"""


@query(JUDGED + """
h AS (SELECT *, sha256('team' || chr(0) || query_id || chr(0) || candidate_id) AS h FROM j),
g AS (SELECT *, row_number() OVER (ORDER BY h) AS n, row_number() OVER (PARTITION BY query_id, human >= 2 ORDER BY h) AS m, (SELECT round_even(count(*) * 0.1::DOUBLE, 0) FROM h WHERE human = ai) AS quota FROM h WHERE human = ai),
r AS (SELECT query_id, candidate_id, 'positive_threshold_disagreement' AS r FROM j WHERE (human >= 2) <> (ai >= 2) UNION ALL SELECT query_id, candidate_id, 'ai_low_confidence' FROM j WHERE confidence = 'low'
  UNION ALL SELECT query_id, candidate_id, 'agreement_random_sample' FROM g WHERE n <= quota UNION ALL SELECT query_id, candidate_id, 'critical_query_control_sample' FROM g WHERE critical AND m = 1)
SELECT query_id, candidate_id, string_agg(r, ',' ORDER BY r) AS reasons FROM r GROUP BY ALL
""", "SMP-1")
def team_review(spark, sf_dir):
    d = R.team_review(judged(spark, sf_dir), 0.1, "team")
    return d.select("query_id", "candidate_id", F.array_join("selection_reasons", ",").alias("reasons"))


@query(JUDGED + """
h AS (SELECT *, sha256('first' || chr(0) || query_id || chr(0) || candidate_id) AS h FROM j),
r AS (SELECT query_id, candidate_id, 'ai_low_confidence' AS r FROM j WHERE confidence = 'low' UNION ALL SELECT query_id, candidate_id, 'unseeded_ai_positive' FROM j WHERE seed IS NULL AND ai >= 2
  UNION ALL SELECT query_id, candidate_id, 'seed_ai_score_disagreement' FROM j WHERE seed <> ai UNION ALL SELECT query_id, candidate_id, 'seed_ai_threshold_disagreement' FROM j WHERE (seed >= 2) <> (ai >= 2)),
f AS (SELECT h.*, ai < 2 AND confidence = 'high' AS calm FROM h ANTI JOIN r USING (query_id, candidate_id)),
c AS (SELECT *, row_number() OVER (ORDER BY h) AS n, (SELECT round_even(count(*) * 0.1::DOUBLE, 0) FROM f WHERE calm) AS quota FROM f WHERE calm),
s AS (SELECT query_id, candidate_id, 'high_confidence_negative_control' AS r FROM c WHERE n <= quota),
k AS (SELECT query_id, candidate_id, critical, row_number() OVER (PARTITION BY query_id, ai >= 2 ORDER BY h) AS m FROM f ANTI JOIN s USING (query_id, candidate_id)),
x AS (SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT query_id, candidate_id, 'critical_query_control' FROM k WHERE critical AND m = 1)
SELECT query_id, candidate_id, string_agg(r, ',' ORDER BY r) AS reasons FROM x GROUP BY ALL
""", "SMP-2")
def first_judged(spark, sf_dir):
    d = R.first_judged(judged(spark, sf_dir), 0.1, "first")
    return d.select("query_id", "candidate_id", F.array_join("selection_reasons", ",").alias("reasons"))


@query(JUDGED + """
q AS (SELECT *, concat_ws(',', CASE WHEN (ai >= 2) <> (second >= 2) THEN 'first_second_threshold_disagreement' WHEN (seed >= 2) <> (second >= 2) THEN 'seed_threshold_conflict_with_ai_consensus' END,
  CASE WHEN confidence = 'low' OR second_confidence = 'low' THEN 'ai_low_confidence' END) AS reasons, (second >= 2)::INT + 2 * critical::INT AS s, sha256(query_id || '|' || candidate_id) AS h FROM j),
n AS (SELECT ceil(count(*) * 0.05::DOUBLE)::BIGINT AS n FROM q WHERE reasons = ''),
c AS (SELECT query_id, candidate_id, h, row_number() OVER (PARTITION BY s ORDER BY h) <= n // 4 + (s < n % 4)::INT AS own FROM q, n WHERE reasons = ''),
f AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY h) AS k FROM c)
SELECT query_id, candidate_id, 'required' AS tier, reasons FROM q WHERE reasons <> '' UNION ALL
SELECT query_id, candidate_id, 'control', 'quality_control_sample' FROM f, n WHERE own OR k <= n - (SELECT count(*) FROM c WHERE own)
""", "SMP-3")
def calibrated_review(spark, sf_dir):
    return R.calibrated_review(judged(spark, sf_dir), 0.05).select("query_id", "candidate_id", "tier", F.array_join("reasons", ",").alias("reasons"))

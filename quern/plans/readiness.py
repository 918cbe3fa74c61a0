"""Soundness of rankings and labels. Rankings are of embeddings; documents are the corpus and benchmark items the questions, which
have fewer ids, so that hits the corpus lacks and questions that are not ranked are real gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import readiness as A
from quern.operators.order import written
from quern.plans.catalog import query
from quern.plans.retrieval import MODELS, RANKS, rankings
from quern.plans.trials import KIND, counted_policies, kinds, policies
from quern.tables import load

NAMES = [m for m, _, _ in MODELS]
#: The rankings; one model counts the ranks of every other query from 0.
FAULTY = RANKS + """
k AS (SELECT model, query_id, id, CASE WHEN model = 'tail' AND query_id % 40 = 20 THEN rank - 1 ELSE rank END AS rank FROM r WHERE rank <= 10),
"""


def faulty(spark, sf_dir) -> DataFrame:
    """The models' rankings, written once; one model counts some queries' ranks from 0."""
    late = F.when((F.col("model") == "tail") & (F.col("query_id") % 40 == 20), F.col("rank") - 1).otherwise(F.col("rank"))
    return written(rankings(spark, sf_dir).select("model", "query_id", "id", late.alias("rank")), "rankings")


@query(FAULTY + """
q AS (SELECT model, query_id FROM k GROUP BY ALL),
e AS (SELECT model, query_id, list_sort(list(rank)) AS got, count(*) AS n FROM k GROUP BY ALL)
SELECT 'wrong_ranks' AS fault, model, query_id::VARCHAR AS query_id, NULL::VARCHAR AS id FROM e WHERE got <> range(1, n + 1)
UNION ALL SELECT 'repeated_hit', model, query_id::VARCHAR, id::VARCHAR FROM k GROUP BY model, query_id, id HAVING count(*) > 1
UNION ALL SELECT 'unknown_hit', model, query_id::VARCHAR, id::VARCHAR FROM k WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'unasked_query', model, query_id::VARCHAR, NULL FROM q WHERE query_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)
UNION ALL SELECT 'missing_query', m.model, item_id::VARCHAR, NULL FROM (SELECT DISTINCT item_id FROM benchmark) b, (VALUES ('full'), ('head'), ('tail')) m(model) WHERE (m.model, item_id) NOT IN (SELECT (model, query_id) FROM q)
""", "AGG-26 V-6")
def ranking_faults(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"))
    corpus = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"))
    return A.ranking_faults(faulty(spark, sf_dir), asked, corpus, NAMES)


@query(FAULTY + "n AS (SELECT model, query_id, count(*) AS n FROM k GROUP BY ALL) SELECT model, count(*) AS query_count, array_to_string(list_sort(list(DISTINCT n)), ',') AS result_counts FROM n GROUP BY 1", "AGG-26")
def ranked_models(spark, sf_dir):
    got = A.ranked_models(rankings(spark, sf_dir))
    return got.withColumn("result_counts", F.array_join(F.transform("result_counts", lambda n: n.cast("string")), ","))


LABELS = RANKS + """
b AS (SELECT query_id, id, rank, grade AS m, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 5 = 0 THEN 2 ELSE grade END AS i FROM r WHERE grade > 0),
l AS (SELECT query_id, id, min(m) AS m, min(i) AS i, min(rank) AS best FROM b GROUP BY ALL)
"""


@query(LABELS + """
SELECT count(DISTINCT query_id) AS questions, count(*) AS judgments, count(*) FILTER (i = 0) AS grade_0, count(*) FILTER (i = 1) AS grade_1, count(*) FILTER (i = 2) AS grade_2, count(*) FILTER (i = 3) AS grade_3,
  count(*) FILTER (i >= 2) AS positives, count(*) FILTER (i >= 2 AND best > 10) AS positives_unranked, count(*) FILTER ((m >= 2) <> (i >= 2)) AS blockers, count(*) FILTER ((m >= 2) <> (i >= 2)) = 0 AS final_ready FROM l
""", "AGG-26")
def metrics_readiness(spark, sf_dir):
    """Independent labels; where they and the majority are on different sides of the threshold, publication is blocked."""
    both = written(counted_policies(spark, sf_dir), "policies")
    per = both.groupBy("query_id", *KIND, "n").agg(F.min(F.col("grade") >= 2).alias("a"), F.max(F.col("grade") >= 2).alias("b"))
    ranked = rankings(spark, sf_dir).join(kinds(spark, sf_dir), "id")
    return A.readiness(both.where("policy = 'independent'"), ranked, per.where("a <> b"), key=tuple(KIND))


@query(LABELS + """
SELECT 'unknown_label' AS fault, query_id::VARCHAR AS query_id, id::VARCHAR AS id FROM l WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'no_positive', query_id::VARCHAR, NULL FROM l GROUP BY query_id HAVING max(i) < 2
""", "AGG-26")
def label_faults(spark, sf_dir):
    """Labels are paired with their queries where they may be faulty: ids that are repeated or that the corpus lacks."""
    corpus = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"))
    ids = kinds(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(corpus.distinct().withColumn("known", F.lit(True)), "id", "left")
    own = written(policies(spark, sf_dir, ids.where("n > 1 or known is null")).where("policy = 'independent'").select("query_id", "id", "grade"), "labels")
    grades = counted_policies(spark, sf_dir).where("policy = 'independent'").select("query_id", "grade")
    return A.label_faults(own, corpus, grades=grades).drop("model")


@query(RANKS + """
h AS (SELECT id, model || ':' || query_id AS query, rank FROM r WHERE rank <= 10)
SELECT id, query, rank, count(*) OVER (PARTITION BY id) AS hits, min(rank) OVER (PARTITION BY id) AS best_rank, min(query) OVER (PARTITION BY id) AS first_query FROM h
""", "AGG-5")
def merged_hits(spark, sf_dir):
    """Hits of all models' searches by vector; a search is a model and a query."""
    d = written(rankings(spark, sf_dir).select("id", F.concat_ws(":", "model", "query_id").alias("query"), "rank"), "hits")
    return A.merged_hits(d, "id", "query").select("id", "query", "rank", "hits", "best_rank", "first_query")

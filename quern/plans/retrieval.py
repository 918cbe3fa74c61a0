"""Queries over `embeddings`: search, pooling, metrics. Query set: vectors whose id is divisible by 20, against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import metrics, vectors
from quern.plans.catalog import query
from quern.tables import load

MODELS = (("full", 0, 64), ("head", 0, 32), ("tail", 32, 64))


def base(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def ranking(spark, sf_dir, k: int, low: int = 0, high: int = 64) -> DataFrame:
    v = base(spark, sf_dir)
    return vectors.knn(v, v.where("id % 20 = 0"), k, low, high)


def rankings(spark, sf_dir, k: int = 10) -> DataFrame:
    v = base(spark, sf_dir)
    out = None
    for name, low, high in MODELS:
        one = vectors.near(v, v.where("id % 20 = 0"), k, low, high).withColumn("model", F.lit(name))
        out = one if out is None else out.union(one)
    return vectors.top(out, ["model", "query_id"], k, F.col("distance"), F.col("id"))


def graded(spark, sf_dir, ranked: DataFrame) -> DataFrame:
    """Adds the grade of each hit: 3 for the query's own label, 1 for a neighbouring one, else 0."""
    v = base(spark, sf_dir).select("id", "label")
    d = ranked.join(v, "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    gap = F.abs(F.col("label") - F.col("own"))
    return d.withColumn("grade", F.when(gap == 0, 3).when(gap == 1, 1).otherwise(0)).drop("label", "own")


def judged(spark, sf_dir) -> DataFrame:
    """(query_id, grade, n): how many vectors each query has of each grade, itself left out."""
    v = base(spark, sf_dir)
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    near = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.explode(F.array(*(F.struct((F.col("label") + d).alias("label"), F.lit(3 - 2 * abs(d)).alias("grade")) for d in (-1, 0, 1)))).alias("x"))
    got = near.select("query_id", "x.label", "x.grade").join(n, "label")
    return got.groupBy("query_id", "grade").agg((F.sum("n") - F.when(F.col("grade") == 3, 1).otherwise(0)).alias("n"))


RANKS = """
WITH m(model, a, b) AS (VALUES ('full', 1, 64), ('head', 1, 32), ('tail', 33, 64)),
d AS (
  SELECT m.model, q.vec_id AS query_id, e.vec_id AS id, q.label AS own, e.label,
         round(1 - list_cosine_similarity(list_slice(q.embedding, a, b)::DOUBLE[], list_slice(e.embedding, a, b)::DOUBLE[]), 6) AS distance
  FROM m, embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id
),
r AS (
  SELECT *, CASE abs(label - own) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS grade,
         row_number() OVER (PARTITION BY model, query_id ORDER BY distance, id) AS rank
  FROM d
),
"""
IDEAL = """
j AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS pos FROM r WHERE model = 'full' AND grade > 0),
p AS (SELECT query_id, count(*) FILTER (grade >= 2) AS positives,
             sum(CASE WHEN pos <= 10 THEN (pow(2, grade) - 1) / log2(pos + 1) END) AS ideal10 FROM j GROUP BY ALL),
"""
PER_QUERY = RANKS + IDEAL + """
x AS (
  SELECT model, query_id, count(*) FILTER (grade >= 2 AND rank <= 5) AS h5, count(*) FILTER (grade >= 2) AS h10, min(rank) FILTER (grade >= 2) AS f,
         sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, count(*) AS n FROM r WHERE rank <= 10 GROUP BY ALL
),
qm AS (
  SELECT model, query_id, round(h5 / positives, 6) AS recall5, round(h10 / positives, 6) AS recall10, round(coalesce(1 / f, 0), 6) AS mrr10,
         round(dcg / ideal10, 6) AS ndcg10, round(h10 / n, 6) AS precision10, CAST(h10 > 0 AS INTEGER) AS hit10
  FROM x JOIN p USING (query_id) WHERE positives > 0
)
"""


@query(RANKS.rstrip().rstrip(",") + " SELECT query_id, id, distance, rank FROM r WHERE model = 'full' AND rank <= 10")
def knn_topk(spark, sf_dir):
    return ranking(spark, sf_dir, 10)


GROUPED = RANKS + """
h AS (SELECT query_id, id, distance, rank, (id % 50)::VARCHAR AS document FROM r WHERE model = 'full' AND rank <= 50 AND id % 8 <> 7),
g AS (SELECT query_id, document, count(*) AS matched_chunks, min(distance) AS best_distance, arg_min(id, rank) AS best_chunk, min(rank) AS fr FROM h GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_distance, fr, document) AS rank FROM g)
SELECT query_id, document, matched_chunks, best_distance, best_chunk, rank FROM k WHERE rank <= 10
"""


@query(GROUPED)
def grouped_search(spark, sf_dir):
    """Hits by document; chunks name it in their own field, in another one, in their id, or not at all."""
    doc, way = (F.col("id") % 50).cast("string"), F.col("id") % 8
    chunk = F.when(way.isin(2, 3, 6), F.concat(F.lit("precedent:"), doc, F.lit(":"), F.col("id"))).otherwise(F.concat(F.lit("chunk:"), F.col("id")))
    document = vectors.document_of(F.when(way.isin(0, 4), doc).when(way == 2, " "), F.when(way.isin(1, 5), doc), chunk)
    hits = ranking(spark, sf_dir, 50).withColumn("document", document)
    return vectors.group_hits(hits, 10)


@query(RANKS + """
c AS (SELECT query_id, id, distance, rank AS child_rank, label AS parent FROM r WHERE model = 'full' AND rank <= 100),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY child_rank) AS n FROM c)
SELECT query_id, id, distance, child_rank, parent, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY child_rank) AS rank FROM f WHERE n = 1) WHERE rank <= 10
""")
def parent_collapse(spark, sf_dir):
    hits = ranking(spark, sf_dir, 100).join(base(spark, sf_dir).select("id", F.col("label").alias("parent")), "id")
    return vectors.collapse_to_parent(hits, 10).select("query_id", "id", "distance", "child_rank", "parent", "rank")


@query(PER_QUERY + " SELECT query_id, recall5, recall10, mrr10, ndcg10, precision10, hit10 FROM qm WHERE model = 'full'")
def ir_metrics_query(spark, sf_dir):
    return metrics.query_metrics(graded(spark, sf_dir, ranking(spark, sf_dir, 10)), judged(spark, sf_dir))


NAMES = ["recall5", "recall10", "mrr10", "ndcg10", "precision10", "hit10"]
MACRO = ", ".join(f"round(avg({c}), 6) AS {c}" for c in NAMES)


def per_query(spark, sf_dir) -> DataFrame:
    d = graded(spark, sf_dir, rankings(spark, sf_dir)).withColumn("key", F.struct("model", "query_id"))
    models = F.array(*(F.lit(m) for m, _, _ in MODELS))
    grades = judged(spark, sf_dir).withColumn("model", F.explode(models)).withColumn("key", F.struct("model", "query_id"))
    got = metrics.query_metrics(metrics.full_hits(d, "key"), grades, by="key")
    return got.select("key.model", "key.query_id", *NAMES)


def by_model(spark, sf_dir) -> DataFrame:
    return metrics.macro(per_query(spark, sf_dir), NAMES, ["model"])


@query(PER_QUERY + f" SELECT model, count(*) AS queries, {MACRO} FROM qm GROUP BY model")
def ir_metrics_macro(spark, sf_dir):
    return by_model(spark, sf_dir)


@query(PER_QUERY + f""", s AS (SELECT model, count(*) AS queries, {MACRO} FROM qm GROUP BY model)
SELECT model, incomplete, recall10, ndcg10, mrr10, row_number() OVER (ORDER BY incomplete, recall10 DESC, ndcg10 DESC, mrr10 DESC, model) AS place
FROM s JOIN (SELECT model, count(*) FILTER (query_id % 3 = 0 AND recall10 < 1) AS incomplete FROM qm GROUP BY 1) USING (model)""")
def model_order(spark, sf_dir):
    """Models by how many critical queries they leave incomplete, then by macro metrics; every model must have ten hits of every query."""
    return metrics.model_order(per_query(spark, sf_dir), F.col("query_id") % 3 == 0).select("model", "incomplete", "recall10", "ndcg10", "mrr10", "place")


@query(PER_QUERY + f""", s AS (SELECT model, {MACRO} FROM qm GROUP BY model)
SELECT s.model, {", ".join(f"round(s.{c} - b.{c}, 6) AS d_{c}" for c in NAMES)} FROM s, s b WHERE b.model = 'full' AND s.model <> 'full'""")
def metric_delta(spark, sf_dir):
    s = by_model(spark, sf_dir)
    b = s.where("model = 'full'").select(*(F.col(c).alias(f"b_{c}") for c in NAMES))
    return s.where("model <> 'full'").join(F.broadcast(b)).select("model", *(F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"d_{c}") for c in NAMES))  # one row


@query(RANKS + """
j AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM r WHERE model = 'full' AND grade >= 2),
ks(k) AS (VALUES (5), (10)),
p AS (SELECT query_id, k, count(*) AS positives, sum(CASE WHEN pos <= k THEN 7 / log2(pos + 1) END) AS ideal FROM j, ks GROUP BY ALL),
x AS (SELECT query_id, k, count(*) FILTER (grade >= 2) AS h, min(rank) FILTER (grade >= 2) AS f, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg
      FROM r, ks WHERE model = 'full' AND rank <= k GROUP BY ALL)
SELECT query_id, k, round(h / greatest(positives, 1), 6) AS recall, round(h / k, 6) AS precision, round(coalesce(dcg / ideal, 0), 6) AS ndcg,
       round(coalesce(1 / f, 0), 6) AS mrr FROM x JOIN p USING (query_id, k)
""")
def ir_metrics_multi_k(spark, sf_dir):
    return metrics.multi_k_metrics(graded(spark, sf_dir, ranking(spark, sf_dir, 10)), judged(spark, sf_dir), [5, 10])


@query(RANKS + """
t AS (SELECT model, query_id, rank, CASE grade WHEN 3 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS score FROM r WHERE rank <= 3),
u AS (SELECT DISTINCT query_id, id, grade FROM r WHERE rank <= 3),
i AS (SELECT query_id, (CASE grade WHEN 3 THEN 3 WHEN 1 THEN 2 ELSE 1 END) - 1 AS g, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS pos FROM u),
b AS (SELECT query_id, sum((pow(2, g) - 1) / log2(pos + 1)) FILTER (pos <= 3) AS ideal FROM i GROUP BY ALL),
x AS (SELECT model, query_id, sum((pow(2, score - 1) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (score >= 2) / 3 AS pr,
             coalesce(max(1 / rank) FILTER (score = 3), 0) AS mr, avg(score) AS me FROM t GROUP BY ALL)
SELECT model, query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, round(pr, 6) AS precision, round(mr, 6) AS mrr, round(me, 6) AS mean_score
FROM x JOIN b USING (query_id)
""")
def rerank_metrics(spark, sf_dir):
    d = graded(spark, sf_dir, rankings(spark, sf_dir, 3)).withColumn("score", F.when(F.col("grade") == 3, 3).when(F.col("grade") == 1, 2).otherwise(1))
    ideal = d.select("query_id", "id", (F.col("score") - 1).alias("grade")).distinct().groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    return metrics.rerank_metrics(d, ideal, 3, ["model", "query_id"]).select("model", "query_id", "ndcg", "precision", "mrr", "mean_score")


@query(RANKS + """
g AS (SELECT query_id, id FROM r WHERE model = 'full' AND grade >= 2),
k AS (SELECT query_id, id, model, rank FROM r WHERE rank <= 10),
f AS (SELECT g.query_id, g.id, count(k.model) AS found, max(CASE WHEN k.rank > 5 THEN 1 ELSE 0 END) AS late FROM g LEFT JOIN k USING (query_id, id) GROUP BY ALL)
SELECT query_id, count(*) FILTER (found = 0) AS shared_missing, count(*) FILTER (found BETWEEN 1 AND 2) AS some_missing,
       count(*) FILTER (found = 3) AS found_by_all, count(*) FILTER (late = 1) AS late FROM f GROUP BY query_id
""")
def failure_bands(spark, sf_dir):
    hits = graded(spark, sf_dir, rankings(spark, sf_dir)).where("grade >= 2").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("found"), F.max((F.col("rank") > 5).cast("int")).alias("late"))
    each = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("any"), F.count_if(F.col("found") < 3).alias("some_missing"), F.count_if(F.col("found") == 3).alias("found_by_all"), F.count_if(F.col("late") == 1).alias("late"))
    total = judged(spark, sf_dir).where("grade = 3 and n > 0").select("query_id", "n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(each, "query_id", "left").select("query_id", (F.col("n") - zero("any")).alias("shared_missing"), *(zero(c).alias(c) for c in ("some_missing", "found_by_all", "late")))


@query(RANKS + """
u AS (SELECT query_id, id, min(rank) AS best_rank, count(DISTINCT model) AS models, min(distance) AS best_distance FROM r WHERE rank <= 10 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, models DESC, best_distance, id) AS pool_rank,
             row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id::VARCHAR || chr(0) || id::VARCHAR)) AS n FROM u)
SELECT query_id, id, best_rank, models, best_distance, pool_rank, 'C' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END AS candidate_id FROM o
""")
def multi_model_pool(spark, sf_dir):
    return vectors.blind(vectors.pool(rankings(spark, sf_dir), 10))

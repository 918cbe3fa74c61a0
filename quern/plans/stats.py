"""Queries that summarise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import stats
from quern.plans.catalog import query
from quern.tables import load

_S = "WITH s AS (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) "
_B = "source, count(*) AS rows, min(v) AS least, max(v) AS most, round(avg(v), 2) AS mean"


@query(_S + f"SELECT {_B}, " + ", ".join(f"max(v) FILTER (i = round_even((n - 1) * CAST({r} AS DOUBLE), 0)) AS p{r * 100:.0f}" for r in (0.5, 0.9, 0.95, 0.99)) + " FROM s GROUP BY source")
def length_summary_round(spark, sf_dir):
    return stats.length_summary(load(spark, sf_dir, "documents"), ["source"], "n_chars", "rounded")


@query(_S + f"SELECT {_B}, median(v) AS median, max(v) FILTER (i = floor(n * CAST(0.95 AS DOUBLE) + CAST(0.999999 AS DOUBLE)) - 1) AS p95, max(v) FILTER (i = floor(n * CAST(0.99 AS DOUBLE) + CAST(0.999999 AS DOUBLE)) - 1) AS p99 FROM s GROUP BY source")
def length_summary_nearest(spark, sf_dir):
    return stats.length_summary(load(spark, sf_dir, "documents"), ["source"], "n_chars", "nearest")


@query("""
WITH s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(v) FILTER (i = greatest(0, ceil(n * CAST(0.5 AS DOUBLE)) - 1)), 3) AS p50, round(max(v) FILTER (i = greatest(0, ceil(n * CAST(0.95 AS DOUBLE)) - 1)), 3) AS p95 FROM s GROUP BY ALL
""")
def latency_percentiles(spark, sf_dir):
    return stats.ceil_percentiles(load(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95])


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS text, count(*) FILTER (lang IS NULL OR lang = '') AS lang, count(*) FILTER (source IS NULL OR trim(source) = '') AS source FROM documents)
SELECT unnest(['text', 'lang', 'source']) AS field, unnest([text, lang, source]) AS blank, round(unnest([text, lang, source]) * 100 / n, 2) AS rate FROM c
""")
def null_profile(spark, sf_dir):
    return stats.blank_profile(load(spark, sf_dir, "documents"), ["text", "lang", "source"])


EDGES = [-1, 0, 100, 300, 1000, 3000, 10000]
_CASES = lambda op, op2: " ".join(f"WHEN n_chars {op} {a}" + (f" AND n_chars {op2} {b}" if b is not None else "") + f" THEN {i}" for i, (a, b) in enumerate(zip(EDGES, [*EDGES[1:], None])))


def _bucket_sql(op: str, op2: str) -> str:
    return f"WITH c AS (SELECT CASE {_CASES(op, op2)} END AS bucket, count(*) AS c FROM documents GROUP BY 1) SELECT CAST(k.k AS INTEGER) AS bucket, coalesce(c, 0) AS rows FROM range({len(EDGES)}) k(k) LEFT JOIN c ON c.bucket = k.k"


@query(_bucket_sql(">", "<="))
def length_buckets_right(spark, sf_dir):
    return stats.buckets(load(spark, sf_dir, "documents"), "n_chars", EDGES)


@query(_bucket_sql(">=", "<"))
def length_buckets_left(spark, sf_dir):
    return stats.buckets(load(spark, sf_dir, "documents"), "n_chars", EDGES, "left")


@query("SELECT source, count(*) AS rows FROM documents GROUP BY source ORDER BY rows DESC, source LIMIT 10")
def top_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "source").limit(10)


@query("SELECT year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def yearly_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT lang, count(*) AS rows, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95,
       sum(n_chars) AS chars, count(*) FILTER (n_chars > 0) AS positive FROM documents GROUP BY lang
""")
def describe_lengths(spark, sf_dir):
    p = [F.round(F.percentile("n_chars", r), 6).alias(f"p{r * 100:.0f}") for r in (0.25, 0.5, 0.75, 0.95)]
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), *p, F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 0).alias("positive"))


@query("SELECT sha256(text) AS digest, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_groups(spark, sf_dir):
    return stats.duplicate_texts(load(spark, sf_dir, "documents"), "text", "doc_id")


@query("(SELECT lang, n_chars % 50 AS k FROM documents WHERE source = 'src0') EXCEPT ALL (SELECT lang, n_chars % 50 AS k FROM documents WHERE source = 'src1')")
def multiset_diff(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    side = lambda s: d.where(F.col("source") == s).select("lang", (F.col("n_chars") % 50).alias("k"))
    return stats.multiset_difference(side("src0"), side("src1"))


@query("SELECT conv_id, count(*) AS rows, sha256(string_agg(sha256(role || '|' || text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def corpus_hash(spark, sf_dir):
    return stats.ordered_hash(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.concat_ws("|", "role", "text"))


@query("SELECT count(*) AS rows, sha256(string_agg(doc_id || '|' || coalesce(lang, 'null') || '|' || coalesce(text, 'null'), chr(10) ORDER BY doc_id)) AS digest FROM documents", "AGG-23")
def corpus_sha256(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    row = F.concat_ws("|", "doc_id", F.coalesce("lang", F.lit("null")), F.coalesce("text", F.lit("null")))
    return spark.createDataFrame([stats.corpus_digest(d, ["doc_id"], row)], "rows long, digest string")


@query("""
SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, count(*) FILTER (value > 100) AS slow, round(count(*) FILTER (value > 100) / count(*), 6) AS slow_rate,
       round(sum(CASE WHEN user_id % 3 = 0 THEN value * 2 WHEN user_id % 3 = 1 THEN value * 0.5 ELSE NULL END) / 1000000, 6) AS cost FROM events GROUP BY event_type
""")
def classifier_summary(spark, sf_dir):
    price = F.when(F.col("user_id") % 3 == 0, 2.0).when(F.col("user_id") % 3 == 1, 0.5)
    slow = F.count_if(F.col("value") > 100)
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("value"), 6).alias("mean"), slow.alias("slow"), F.round(slow / F.count(F.lit(1)), 6).alias("slow_rate"), F.round(F.sum(F.col("value") * price) / 1_000_000, 6).alias("cost"))


@query("""
WITH q AS (SELECT user_id, event_type, round(avg(value), 6) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, user_id % 10 AS scenario, round(avg(m), 6) AS m FROM q GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY m DESC) AS k FROM s)
SELECT scenario, max(m) AS best, string_agg(event_type, '+' ORDER BY event_type) FILTER (k = 1) AS winners FROM r GROUP BY scenario
""")
def variant_winners(spark, sf_dir):
    q = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    s = q.groupBy("event_type", (F.col("user_id") % 10).alias("scenario")).agg(F.round(F.avg("m"), 6).alias("m"))
    r = s.withColumn("k", F.rank().over(Window.partitionBy("scenario").orderBy(F.desc("m"))))
    return r.groupBy("scenario").agg(F.max("m").alias("best"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == 1, F.col("event_type")))), "+").alias("winners"))


@query("""
WITH l AS (SELECT conv_id, role, arg_max(length(text), turn) AS n FROM conversations GROUP BY ALL),
p AS (SELECT conv_id, max(n) FILTER (role = 'user') AS "user", max(n) FILTER (role = 'assistant') AS assistant, max(n) FILTER (role = 'system') AS system, count(DISTINCT n) AS kinds, max(n) AS top FROM l GROUP BY conv_id)
SELECT conv_id, "user", assistant, system, kinds = 1 AS agree, CASE WHEN kinds > 1 OR top >= 300 THEN 'high' ELSE 'normal' END AS priority FROM p
""")
def round_trip_pivot(spark, sf_dir):
    last = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.length("text"), "turn").alias("n"))
    wide = last.groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.max("n"))
    extra = last.groupBy("conv_id").agg(F.countDistinct("n").alias("kinds"), F.max("n").alias("top"))
    return wide.join(extra, "conv_id").select("conv_id", "user", "assistant", "system", (F.col("kinds") == 1).alias("agree"), F.when((F.col("kinds") > 1) | (F.col("top") >= 300), "high").otherwise("normal").alias("priority"))


@query()
def greedy_batches(spark, sf_dir):
    d = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return d.select("conv_id", F.array_join(stats.batches(F.col("sizes"), 3, 800), ",").alias("batches"))

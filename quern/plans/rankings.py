"""Queries of rankings. Line items stand for hits: a supplier's query finds parts through their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import rankings as R
from quern.operators import sampling as S
from quern.plans.catalog import query
from quern.tables import load

HITS = """WITH h AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, l_orderkey * 10 + l_linenumber AS chunk_id, CASE WHEN l_discount >= 0.01 THEN l_discount END AS distance, l_extendedprice AS price,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS chunk_rank FROM lineitem) """


def hits(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_discount") >= 0.01, F.col("l_discount")).alias("distance"), F.col("l_extendedprice").alias("price"), F.row_number().over(w).alias("chunk_rank"))


@query(HITS + """, g AS (SELECT query_id, doc_id, min(chunk_rank) AS best_rank, min(distance) AS best_distance, count(*) AS chunks FROM h GROUP BY ALL),
b AS (SELECT query_id, doc_id, chunk_id AS best_chunk, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coalesce(distance, 1e9), chunk_rank) AS n FROM h)
SELECT query_id, doc_id, best_rank, best_distance, best_chunk, chunks, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, coalesce(best_distance, 1e9), doc_id) AS place FROM g JOIN b USING (query_id, doc_id) WHERE n = 1
""", "W-3 W-17")
def pooled_ranking(spark, sf_dir):
    return R.pooled(hits(spark, sf_dir))


SCORED = HITS + ", s AS (SELECT *, (price % 97) / 97 AS score FROM h) "


@query(SCORED + """, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_rank, chunk_id) AS n, min(chunk_rank) OVER (PARTITION BY query_id, doc_id) AS doc_rank FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_rank, doc_id) AS place FROM b WHERE n = 1)
SELECT query_id, doc_id, place, round(score, 8) AS score, chunk_id AS best_chunk FROM r WHERE place <= 10
""", "W-7")
def rerank(spark, sf_dir):
    h = hits(spark, sf_dir)
    first = h.groupBy("query_id", "doc_id").agg(F.min("chunk_rank").alias("doc_rank"))
    return R.reranked(h.join(first, ["query_id", "doc_id"]).withColumn("score", F.col("price") % 97 / 97), 10)


@query("""
WITH m AS (SELECT conv_id, turn, text, role, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS method, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY length(text) DESC, turn) AS rank FROM conversations),
s AS (SELECT conv_id, turn, text, min((method, rank, role)) AS m FROM m WHERE rank <= 3 GROUP BY ALL)
SELECT conv_id, string_agg('[' || role || '] ' || text, ' || ' ORDER BY method, rank, turn) AS evidence FROM (SELECT s.conv_id, s.turn, s.text, m.method, m.rank, m.role FROM s JOIN m USING (conv_id, turn, text)) GROUP BY conv_id
""", "W-8")
def review_pool(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("method", F.when(F.col("turn") % 2 == 0, "a").otherwise("b"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "method").orderBy(F.desc(F.length("text")), "turn"))
    return R.review_pool(c.select("conv_id", F.col("turn").alias("chunk_id"), "text", F.col("role").alias("kind"), "method", rank.alias("rank")), 3, ["conv_id"])


@query("""
WITH o AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 24) SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM o
""", "W-13")
def longest_chunks(spark, sf_dir):
    return R.longest(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), ["doc_id"], 24)


@query("""
WITH r AS (SELECT p_partkey AS seq, p_brand AS headword, CASE WHEN p_size = 1 THEN '' ELSE p_name END AS definition, p_type AS source, 100 * (p_size % 2) + least(3 * (p_size % 10), 24) AS score, p_size > 30 AS restricted FROM part),
u AS (SELECT *, row_number() OVER (PARTITION BY headword, definition, source ORDER BY seq) AS n FROM r WHERE definition <> '')
SELECT seq, headword, score, row_number() OVER (ORDER BY score DESC, restricted, source, definition, seq) AS rank FROM u WHERE n = 1
""", "W-19")
def definition_ranking(spark, sf_dir):
    size = F.col("p_size")
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("headword"), F.when(size == 1, "").otherwise(F.col("p_name")).alias("definition"), F.col("p_type").alias("source"), "p_size")
    d = R.ranked_definitions(rows, ["headword", "definition", "source"], 100 * (size % 2) + F.least(3 * (size % 10), F.lit(24)), size > 30)
    return d.select("seq", "headword", "score", "rank")


@query("""
WITH c AS (SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS BIGINT) AS score FROM customer), k AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT replace(s_name, 'Supplier', 'Customer') AS name FROM supplier),
d AS (SELECT *, id IN (FROM k) OR name IN (FROM n) AS existing, list_filter(['7', '00009'], lambda t: contains(name, t)) AS warnings FROM c)
SELECT id, existing, array_to_string(warnings, ',') AS warnings, row_number() OVER (ORDER BY existing, len(warnings) > 0, score DESC, name, id) AS place FROM d
""", "W-18 SRC-11")
def discovery_order(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.rint("c_acctbal").cast("long").alias("score"))
    ids = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    names = load(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return R.discovery_order(c, ids, names, ["7", "00009"]).select("id", "existing", F.array_join("warnings", ",").alias("warnings"), "place")


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) AS w FROM conversations), t AS (SELECT conv_id, turn, unnest(w) AS term FROM w)
SELECT conv_id, turn, string_agg(term, ',' ORDER BY -length(term), term) AS terms FROM t GROUP BY ALL
""", "TOP-7")
def field_match_order(spark, sf_dir):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.in_match_order(words), ",").alias("terms")).where("terms <> ''")


@query("SELECT l.doc_id, l.quality * 2 + l.toxic AS relevance, d.source, d.lang, d.n_chars FROM labels l LEFT JOIN documents d USING (doc_id)", "JOIN-6")
def chunk_enrichment(spark, sf_dir):
    meta = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("relevance")).join(meta, "doc_id", "left")


@query("""
WITH f AS (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey AS query_id, o_custkey AS doc_id, c_name AS name, o_custkey IN (FROM f) AS favourite FROM orders JOIN customer ON c_custkey = o_custkey
""", "JOIN-20")
def search_items(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    store = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("own_id"), F.col("c_name").alias("name"))
    d = R.search_items(o.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id")), store, o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("doc_id")))
    return d.select("query_id", "doc_id", "name", "favourite")


@query("""
WITH s AS (SELECT doc_id, [struct_pack(t := 'source', c := trim(coalesce(source, ''))), struct_pack(t := 'lang', c := trim(CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE coalesce(lang, '') END)), struct_pack(t := 'chars', c := n_chars::VARCHAR)] AS s FROM documents),
k AS (SELECT doc_id, list_filter(s, lambda x: x.c <> '') AS s FROM s), p AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS position, unnest(s) AS x FROM k)
SELECT doc_id, CAST(position AS INTEGER) AS position, x.t AS title, x.c AS content FROM p
""", "PRJ-4")
def full_text(spark, sf_dir):
    fields = [("source", F.col("source")), ("lang", F.when(F.col("n_chars") % 3 == 0, " ").otherwise(F.col("lang"))), ("chars", F.col("n_chars"))]
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(R.full_text(fields)).alias("x")).select("doc_id", "x.*")


@query(None, "SMP-5")
def preferred_sample(spark, sf_dir):
    """40 orders: cells of status and urgency in turn, no customer twice more, then the first ones."""
    cell = F.concat_ws("/", "o_orderstatus", F.substring("o_orderpriority", 1, 1))
    d = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return S.preferred(d, cell, [f"{s}/{p}" for p in "123" for s in "FOP"], 40, "o_custkey", ["o_orderkey"])


@query("SELECT vec_id, len(embedding) AS dimension, len(embedding) = (SELECT mode(len(embedding)) FROM embeddings) AS good FROM embeddings", "VEC-5")
def embedding_dimensions(spark, sf_dir):
    """Vectors by whether they have the store's dimension, the commonest."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dimension"))
    usual = e.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("dimension", "n").alias("usual"))
    return e.join(F.broadcast(usual)).select("vec_id", "dimension", (F.col("dimension") == F.col("usual")).alias("good"))  # one row


@query("""
WITH c AS (SELECT len(regexp_extract_all(text, '[a-z]+')) AS a, len(regexp_extract_all(lower(text), '[a-z]+')) AS b, len(regexp_extract_all(text, '[a-zA-Z]+')) AS c FROM documents)
SELECT 'a' AS "left", 'b' AS "right", bool_and(a = b) AS identical FROM c UNION ALL SELECT 'a', 'c', bool_and(a = c) FROM c UNION ALL SELECT 'b', 'c', bool_and(b = c) FROM c
""", "AGG-24")
def token_count_pairs(spark, sf_dir):
    count = lambda text, p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    t = F.col("text")
    d = load(spark, sf_dir, "documents").select("doc_id", count(t, "[a-z]+").alias("a"), count(F.lower(t), "[a-z]+").alias("b"), count(t, "[a-zA-Z]+").alias("c"))
    return R.equal_sequences(d, ["a", "b", "c"], "doc_id")


@query("""
SELECT source, count(*) AS chunks, CAST(sum(n_chars // 4) AS BIGINT) AS tokens, max(n_chars // 4) AS longest, count(*) FILTER (n_chars // 4 > 2000) AS too_long, round(sum(n_chars // 4) * 0.13 / 1000000, 6) AS cost_usd FROM documents GROUP BY source
""", "AGG-25")
def embedding_cost(spark, sf_dir):
    n = F.floor(F.col("n_chars") / 4)
    g = load(spark, sf_dir, "documents").withColumn("n", n).groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count_if(F.col("n") > 2000).alias("too_long"), F.round(F.sum("n") * 0.13 / 1_000_000, 6).alias("cost_usd"))


@query("""
WITH q AS (SELECT l_suppkey, l_orderkey, CAST(round(avg(CAST(l_discount AS DECIMAL(12, 4))), 6) AS DECIMAL(18, 6)) AS m FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey, CAST(round(CAST(sum(m) AS DOUBLE) / count(*), 6) AS DECIMAL(18, 6)) AS m FROM q GROUP BY 1)
SELECT l_suppkey, CAST(m AS DOUBLE) AS mean, (SELECT round(CAST(sum(m) AS DOUBLE) / count(*), 6) FROM s) AS overall FROM s
""", "AGG-11")
def cascaded_means(spark, sf_dir):
    """Means of means, rounded at each level; sums are of decimals, so they do not hang on the rows' order."""
    mean = lambda c, kind: F.round(F.sum(F.col(c).cast(kind)).cast("double") / F.count(F.lit(1)), 6)
    q = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(mean("l_discount", "decimal(12,4)").alias("m"))
    s = q.groupBy("l_suppkey").agg(mean("m", "decimal(18,6)").alias("mean"))
    return s.join(F.broadcast(s.agg(mean("mean", "decimal(18,6)").alias("overall"))))  # one row


@query("""
SELECT event_type, count(*) AS attempts, round(avg(CAST(value > 50 AS INT)), 6) AS accuracy, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(max(value), 3) AS max FROM events GROUP BY 1
""", "AGG-13")
def classifier_latency(spark, sf_dir):
    """Nearest-rank percentiles from counts of distinct values."""
    e = load(spark, sf_dir, "events")
    counts = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    c = counts.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda r: F.round(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(r)), F.col("value"))), 3)
    p = c.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("accuracy"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 3).alias("max"))
    return g.join(p, "event_type")

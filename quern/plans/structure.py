"""Queries over trees, intervals and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import order as O
from quern.operators import structure as S
from quern.plans.catalog import query
from quern.tables import load


@query("""
WITH c AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 END AS lv, role || turn AS label FROM conversations),
m AS (SELECT *, max(CASE WHEN lv = 0 THEN turn END) OVER w AS a, max(CASE WHEN lv = 1 THEN turn END) OVER w AS b FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws('/', 'system' || a, CASE WHEN a IS NULL OR a < b THEN 'user' || b END) AS path FROM m
""")
def heading_path(spark, sf_dir):
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1)
    label = F.concat("role", F.col("turn").cast("string"))
    return S.heading_path(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", level, label, 2).select("conv_id", "turn", F.array_join("path", "/").alias("path"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ': ' || l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_linenumber || ': ' || l_returnflag || l_linestatus) AS body FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'fallback' ELSE 'article' END AS chunk_type, coalesce(n, 0) AS children, concat_ws(chr(10), 'order ' || o_orderkey || ' ' || o_orderstatus, body) AS retrieval_text FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def article_chunk(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    head = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(": "), "l_returnflag", "l_linestatus")
    return S.chunks(load(spark, sf_dir, "orders"), lines, "o_orderkey", "l_linenumber", head, line)


@query("""
WITH i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + CAST(round_even(value * 60, 0) AS BIGINT) AS z FROM events),
m AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS a, max(z) AS z, count(*) AS parts FROM g GROUP BY user_id, g
""")
def merge_intervals(spark, sf_dir):
    a = F.unix_timestamp("ts")
    i = load(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + F.bround(F.col("value") * 60, 0).cast("long")).alias("z"))
    return S.merge_intervals(i, ["user_id"], "a", "z")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, t, i, t AS o, 1 AS n FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.t, e.i, CASE WHEN s.o + 1800000000 <= e.t THEN e.t ELSE s.o END, s.n + CASE WHEN s.o + 1800000000 <= e.t THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, n AS session FROM s
""")
def session_ttl(spark, sf_dir):
    return O.greedy_sessions(load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", 1_800_000_000).select("user_id", "event_id", "session")


@query("""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
l AS (SELECT *, lead(t, 100) OVER (ORDER BY t, event_id) AS later FROM c)
SELECT user_id, event_id, CASE WHEN later < t + 1800000000 THEN later ELSE t + 1800000000 END AS ends, coalesce(later < t + 1800000000, false) AS evicted FROM l
""", "STM-1")
def session_store(spark, sf_dir):
    """Searches that a store of 100 open sessions keeps for 30 minutes: when each is over, and whether a later search pushed it out."""
    opens = load(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return O.evicted(opens, ["t", "event_id"], F.col("t"), 1_800_000_000, 100).select("user_id", "event_id", "ends", "evicted")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
s AS (SELECT doc_id, i, 1 AS items, n AS total, 1::BIGINT AS batch FROM d WHERE i = 1 UNION ALL
      SELECT d.doc_id, d.i, CASE WHEN items >= 64 OR total + n > 30000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 64 OR total + n > 30000 THEN n ELSE total + n END,
             batch + CASE WHEN items >= 64 OR total + n > 30000 THEN 1 ELSE 0 END FROM s JOIN d ON d.i = s.i + 1)
SELECT doc_id, batch FROM s
""", "SET-8")
def corpus_batches(spark, sf_dir):
    """All documents as one sequence of requests of at most 64 items and 30,000 words."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long")
    return O.greedy_batches(d.select("doc_id", words.alias("words")), ["doc_id"], F.col("words"), 64, 30_000).select("doc_id", "batch")


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS asked FROM events GROUP BY ALL")
def favourite_dedupe(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("asked"))


@query()
def greedy_pack(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.packed("text")).alias("part", "chunk"))
    return d.select("doc_id", F.col("part") + 1, F.length("chunk").alias("chars"), "chunk").toDF("doc_id", "part", "chars", "chunk")


@query("""
SELECT conv_id, trim(regexp_replace(list_sort(list({'t': turn, 'x': text}))[1].x, '[ \t\r]*\n[ \t\r]*', ' ', 'g'), ' ') AS reason FROM conversations GROUP BY conv_id
""".replace("\\n", "\\n"))
def first_section(spark, sf_dir):
    one = F.regexp_replace("text", "[ \t\r]*\n[ \t\r]*", " ")
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "【이 유】").otherwise("【주 문】"), one).alias("t"))
    whole = d.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "").alias("t"))
    return whole.select("conv_id", S.section_until(F.col("t"), "이유", ["주문", "이유"]).alias("reason"))

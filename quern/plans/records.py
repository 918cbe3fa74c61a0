"""Queries over records: lookups, costs, states, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import sampling as S
from quern.operators import validate as V
from quern.operators.generation import generation
from quern.plans.catalog import query
from quern.tables import load


@query("""
WITH c AS (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS valid FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS matches, CASE WHEN coalesce(n, 0) = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN valid = 0 THEN 'invalid_detail' ELSE 'collected' END AS status FROM customer LEFT JOIN c USING (c_custkey)
""")
def lookup_status(spark, sf_dir):
    """Customers looked up among the orders: exactly one match, of the right kind, is collected."""
    found = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("valid"))
    d = load(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left").withColumn("matches", F.coalesce("n", F.lit(0)))
    status = V.first_failing([("not_found", F.col("matches") == 0), ("ambiguous", F.col("matches") > 1), ("invalid_detail", F.col("valid") == 0)], "collected")
    return d.select("c_custkey", "matches", status.alias("status"))


@query("""
WITH j AS (SELECT doc_id, quality * 2 + toxic AS before, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE quality * 2 + toxic END AS after FROM labels)
SELECT before AS grade, count(*) AS rows, count(*) FILTER (before <> after) AS changed, count(*) FILTER (before >= 2 AND after < 2) AS lost, count(*) FILTER (after >= 2) AS positive FROM j GROUP BY before
""")
def label_readiness(spark, sf_dir):
    before = F.col("quality") * 2 + F.col("toxic")
    j = load(spark, sf_dir, "labels").select(before.alias("grade"), F.when(F.col("doc_id") % 13 == 0, 0).otherwise(before).alias("after"))
    g, a = F.col("grade"), F.col("after")
    return j.groupBy("grade").agg(F.count(F.lit(1)).alias("rows"), F.count_if(g != a).alias("changed"), F.count_if((g >= 2) & (a < 2)).alias("lost"), F.count_if(a >= 2).alias("positive"))


@query("""
SELECT regexp_extract(o_orderpriority, '^([0-9])', 1) AS tier, count(*) AS orders,
       round(sum(o_totalprice * CASE regexp_extract(o_orderpriority, '^([0-9])', 1) WHEN '1' THEN 3.0 WHEN '2' THEN 1.5 WHEN '3' THEN 0.3 ELSE NULL END) / 1000000, 6) AS cost FROM orders GROUP BY 1
""")
def tiered_cost(spark, sf_dir):
    tier = F.regexp_extract("o_orderpriority", "^([0-9])", 1)
    price = F.when(tier == "1", 3.0).when(tier == "2", 1.5).when(tier == "3", 0.3)
    return load(spark, sf_dir, "orders").withColumn("tier", tier).groupBy("tier").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice") * price) / 1_000_000, 6).alias("cost"))


@query("""
SELECT CAST(string_split(c_name, '#')[-1] AS INT) AS number, c_custkey FROM customer ORDER BY number DESC, c_custkey LIMIT 25
""")
def numeric_suffix_order(spark, sf_dir):
    n = F.substring_index("c_name", "#", -1).cast("int")
    return load(spark, sf_dir, "customer").select(n.alias("number"), "c_custkey").orderBy(F.desc("number"), "c_custkey").limit(25)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 30")
def newest_first(spark, sf_dir):
    return load(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id")


@query("""
SELECT doc_id, CASE WHEN n_chars = 0 THEN 'remote' WHEN n_chars < 1800 THEN 'local' ELSE 'remote' END AS provider FROM documents
""")
def provider_routing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") == 0, "remote").when(F.col("n_chars") < 1800, "local").otherwise("remote").alias("provider"))


@query("""
SELECT t.term, count(*) FILTER (contains(text, t.term)) AS pages, round(count(*) FILTER (contains(text, t.term)) * 100 / count(*), 2) AS rate FROM documents, (VALUES ('the'), ('que'), ('und'), ('licens'), ('%%%')) t(term) GROUP BY t.term
""")
def keyword_counts(spark, sf_dir):
    terms = ["the", "que", "und", "licens", "%%%"]
    one = load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.contains("text", F.lit(t))).alias(f"t{k}") for k, t in enumerate(terms)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{k}").alias("pages")) for k, t in enumerate(terms))))
    return one.select("n", rows.alias("r")).select("r.term", "r.pages", F.round(F.col("r.pages") * 100 / F.col("n"), 2).alias("rate"))


@query("""
WITH s AS (SELECT p_name, count(DISTINCT p_type) AS senses, length(p_name) AS n FROM part GROUP BY 1),
m AS (SELECT * FROM s WHERE senses >= 3 ORDER BY senses DESC, n, p_name LIMIT 30), k AS (SELECT 30 - count(*) AS spare FROM m),
t AS (SELECT *, row_number() OVER (ORDER BY n, p_name) - 1 AS i, count(*) OVER () AS total FROM s WHERE senses = 2),
w AS (SELECT DISTINCT CASE WHEN spare = 1 THEN total // 2 ELSE round_even(j * (total - 1) / (spare - 1), 0) END AS i FROM (SELECT unnest(range(spare)) AS j, spare FROM k WHERE spare > 0), (SELECT count(*) AS total FROM t))
SELECT p_name, senses FROM m UNION ALL SELECT p_name, senses FROM t WHERE i IN (SELECT i FROM w)
""", "SMP-9")
def multi_sense_sample(spark, sf_dir):
    s = load(spark, sf_dir, "part").groupBy("p_name").agg(F.countDistinct("p_type").alias("senses"))
    return S.most_senses_then_spaced(s.withColumn("n", F.length("p_name")), "senses", 30, "n", "p_name").select("p_name", "senses")


@query("""
WITH r AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS results, bool_or(role = 'system') AS message FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN results > 0 THEN 'completed' ELSE 'empty' END AS state, results > 0 OR message AS valid, results AS count FROM r
""")
def response_state(spark, sf_dir):
    r = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("count"), F.bool_or(F.col("role") == "system").alias("message"))
    return r.select("conv_id", F.when(F.col("count") > 0, "completed").otherwise("empty").alias("state"), ((F.col("count") > 0) | F.col("message")).alias("valid"), "count")


#: What the events of a user do to an explanation; the states are not generated, generating, generated, failed.
ACTIONS = {"view": "start", "purchase": "request", "signup": "complete", "error": "fail"}


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'request' WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'none' END AS action,
                     row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 'none' AS action, 0 AS before, 0 AS state FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, e.event_id, e.action, s.state, CASE WHEN e.action = 'complete' THEN 2 WHEN e.action = 'fail' THEN 3 WHEN e.action IN ('start', 'request') AND s.state IN (0, 3) THEN CASE e.action WHEN 'start' THEN 1 ELSE 2 END ELSE s.state END
      FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, CASE WHEN action = 'complete' THEN 'completed' WHEN action = 'fail' THEN 'failed' WHEN action = 'none' THEN 'none' WHEN before = 1 THEN 'in_progress' WHEN before = 2 THEN 'idempotent'
                      WHEN action = 'start' THEN 'started' ELSE 'generated' END AS transition, before AS state FROM s WHERE i > 0
""")
def generation_state(spark, sf_dir):
    """What each event does to its user's explanation: a request for one that is there is idempotent, one for one in progress is refused."""
    e = load(spark, sf_dir, "events")
    action = F.coalesce(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[F.col("event_type")], F.lit("none"))
    return generation(e.select("user_id", "event_id", action.alias("action")), "user_id", "event_id").select("event_id", "transition", "state")


@query("""
SELECT l_returnflag AS flag, count(*) AS rows, count(DISTINCT l_orderkey) AS orders, round(avg(l_extendedprice), 6) AS price, round(sum(l_quantity * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1
""")
def run_aggregate(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.avg("l_extendedprice"), 6).alias("price"), F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))), 2).alias("net"))

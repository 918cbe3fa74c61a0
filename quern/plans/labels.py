"""Queries over labels, and the joins that merge sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import labels as L
from quern.plans.catalog import query
from quern.tables import load


def raters(spark, sf_dir):
    """Three raters' grades 0..3 of each labelled document."""
    d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return d.select("doc_id", "source", (F.col("quality") * 2).alias("a"), (F.col("quality") * 2 + F.col("toxic")).alias("b"), (F.col("n_chars") % 4).cast("int").alias("c"))


RATERS = "WITH r AS (SELECT doc_id, source, quality * 2 AS a, quality * 2 + toxic AS b, CAST(n_chars % 4 AS INTEGER) AS c FROM labels JOIN documents USING (doc_id)) "


@query(RATERS + "SELECT source, count(*) AS rows, round(avg(CAST(a = b AS INT)), 6) AS exact, round(avg(CAST((a >= 2) = (b >= 2) AS INT)), 6) AS binary FROM r GROUP BY source")
def agreement(spark, sf_dir):
    d = raters(spark, sf_dir)
    return L.agreement(L.strict_join(d.select("doc_id", "source", "a"), d.select("doc_id", "b"), ["doc_id"]), "a", "b", ["source"])


@query(RATERS + """
SELECT doc_id, a, b, c, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS vote, (CAST(a >= 2 AS INT) + CAST(b >= 2 AS INT) + CAST(c >= 2 AS INT)) * 2 > CASE WHEN c IS NULL THEN 2 ELSE 3 END AS positive
FROM (SELECT doc_id, a, b, CASE WHEN doc_id % 3 = 0 THEN c END AS c FROM r)
""".replace("CAST(c >= 2 AS INT)", "coalesce(CAST(c >= 2 AS INT), 0)"))
def vote_merge(spark, sf_dir):
    d = raters(spark, sf_dir)
    d = L.strict_join(d.select("doc_id", "a"), d.select("doc_id", "b"), ["doc_id"]).join(d.where("doc_id % 3 = 0").select("doc_id", "c"), "doc_id", "left")
    votes = [F.col(x) for x in "abc"]
    return d.select("doc_id", "a", "b", "c", L.majority(votes).alias("vote"), L.binary_majority(votes).alias("positive"))


@query(RATERS + """
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 7 = 0 THEN c END, CASE WHEN d.doc_id % 3 = 0 THEN b END, a) AS grade,
       CASE WHEN d.doc_id % 7 = 0 AND c IS NOT NULL THEN 'human' WHEN d.doc_id % 3 = 0 AND b IS NOT NULL THEN 'calibrated' WHEN a IS NOT NULL THEN 'first' END AS label_source
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
""")
def label_precedence(spark, sf_dir):
    d = raters(spark, sf_dir)
    sources = [("human", d.where("doc_id % 7 = 0").withColumnRenamed("c", "grade")), ("calibrated", d.where("doc_id % 3 = 0").withColumnRenamed("b", "grade")), ("first", d.withColumnRenamed("a", "grade"))]
    return L.by_precedence(load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], sources)


@query(RATERS + "SELECT doc_id, a AS grade, CASE WHEN doc_id % 5 = 0 THEN c ELSE a END AS final, doc_id % 5 = 0 AND a <> c AS changed FROM r")
def label_override(spark, sf_dir):
    d = raters(spark, sf_dir)
    return L.override(d.select("doc_id", F.col("a").alias("grade")), d.where("doc_id % 5 = 0").select("doc_id", F.col("c").alias("grade"), F.col("a").alias("expected")), ["doc_id"])


@query("""
WITH d AS (SELECT source, quality AS t, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars > 1500 THEN 1 END AS d FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS rows, count(d) AS decided, round(coalesce(count(d) / nullif(count(*), 0), 0), 6) AS coverage, round(coalesce(count(*) FILTER (t = d) / nullif(count(d), 0), 0), 6) AS accuracy,
       round(count(*) FILTER (t = 1 AND d = 1) / nullif(count(*) FILTER (d = 1), 0), 6) AS include_precision, round(count(*) FILTER (t = 0 AND d = 0) / nullif(count(*) FILTER (d = 0), 0), 6) AS exclude_precision FROM d GROUP BY source
""")
def confusion_coverage(spark, sf_dir):
    d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return L.confusion(d, F.col("quality"), F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") > 1500, 1), ["source"])


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, n_name AS name,
       CASE WHEN c.nation IS NULL THEN 'supplier_only' WHEN s.nation IS NULL THEN 'customer_only' WHEN balance < 0 THEN 'review' ELSE 'integrated' END AS status
FROM c FULL JOIN s ON c.nation = s.nation LEFT JOIN nation ON n_nationkey = coalesce(c.nation, s.nation)
""")
def full_outer_integrate(spark, sf_dir):
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    status = F.when(F.col("customers").isNull(), "supplier_only").when(F.col("suppliers").isNull(), "customer_only").when(F.col("balance") < 0, "review").otherwise("integrated")
    d = c.join(s, "nation", "full_outer").withColumn("status", status)
    return d.join(n, "nation", "left").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "name", "status")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unprocessed_anti(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""
WITH p AS (SELECT DISTINCT p_name AS name, p_type AS decision FROM part), e AS (SELECT DISTINCT p_name || s AS name, p_name AS own FROM part, unnest([' rule', ' decree', '']) u(s)),
j AS (SELECT e.name, p.name AS parent, p.decision, row_number() OVER (PARTITION BY e.name ORDER BY length(p.name) DESC, p.name DESC, p.decision DESC) AS n
      FROM e JOIN p ON e.name IN (p.name || ' rule', p.name || ' decree'))
SELECT name, parent, decision FROM j WHERE n = 1
""")
def prefix_parent(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    rules = part.select(F.explode(F.array(*(F.concat(F.col("p_name"), F.lit(x)) for x in (" rule", " decree", "")))).alias("name")).distinct()
    ends = F.explode(F.array(*(F.concat(F.col("p_name"), F.lit(x)) for x in (" rule", " decree")))).alias("name")
    parents = part.select("p_name", F.col("p_type").alias("decision")).distinct().select("p_name", "decision", ends)  # an equi-join on the name with its ending
    best = parents.groupBy("name").agg(F.max(F.struct(F.length("p_name").alias("n"), F.col("p_name"), F.col("decision"))).alias("b"))
    return rules.join(best, "name").select("name", F.col("b.p_name").alias("parent"), F.col("b.decision").alias("decision"))


@query("""
WITH a AS (SELECT user_id, event_type, min(event_id) AS event_id, 0 AS source_no FROM events WHERE value > 200 GROUP BY ALL), b AS (SELECT user_id, event_type, min(event_id) AS event_id, 1 AS source_no FROM events WHERE value <= 200 GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY source_no, event_id) AS n FROM (FROM a UNION ALL FROM b))
SELECT user_id, event_type, event_id, source_no FROM u WHERE n = 1
""")
def priority_union(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return L.first_by_source([e.where("value > 200").drop("value"), e.where("value <= 200").drop("value")], ["user_id", "event_type"], ["event_id"])


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL)
SELECT DISTINCT user_id, event_type FROM events JOIN l USING (user_id, event_type) WHERE l.value > 100
""")
def latest_error_keys(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    bad = L.latest(e, ["user_id", "event_type"], "event_id", "value").where("value > 100")
    return e.select("user_id", "event_type").distinct().join(bad, ["user_id", "event_type"], "left_semi")


@query("""
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS component FROM part)
SELECT component, p_partkey AS parent, row_number() OVER (PARTITION BY component ORDER BY p_partkey) AS place, count(*) OVER (PARTITION BY component) AS n FROM w
""")
def component_parents(spark, sf_dir):
    w = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("component"))
    by = Window.partitionBy("component")
    return w.select("component", F.col("p_partkey").alias("parent"), F.row_number().over(by.orderBy("p_partkey")).alias("place"), F.count(F.lit(1)).over(by).alias("n"))


@query("""
WITH h AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k, event_id FROM events)
SELECT user_id, count(DISTINCT (event_type, k)) AS hits, arg_min(event_type, event_id) AS first_type, array_to_string(list_sort(list(DISTINCT event_type)), ' | ') AS types,
       sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) + 2 * count(*) FILTER (k = 1) AS score FROM h GROUP BY user_id
""")
def merge_hits(spark, sf_dir):
    h = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return h.groupBy("user_id").agg(F.countDistinct("event_type", "k").alias("hits"), F.min_by("event_type", "event_id").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), " | ").alias("types"), (F.sum(weight) + 2 * F.count_if(F.col("k") == 1)).alias("score"))


@query("""
WITH d AS (SELECT s_nationkey, s_name, round(s_acctbal) AS r, min(s_suppkey) AS id FROM supplier WHERE s_name <> '' GROUP BY ALL)
SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY r DESC, s_name, id) AS review_rank FROM d
""")
def sense_ranking(spark, sf_dir):
    d = load(spark, sf_dir, "supplier").where("s_name <> ''").groupBy("s_nationkey", "s_name", F.round("s_acctbal").alias("r")).agg(F.min("s_suppkey").alias("id"))
    return d.select("s_nationkey", "s_name", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("r"), "s_name", "id")).alias("review_rank"))


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem), r AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_suppkey) AS suppliers,
       sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT l_orderkey, flags, suppliers, quantity, CASE WHEN quantity > 150 THEN 'defined' WHEN flags LIKE '%R%' THEN 'error' WHEN suppliers = 1 THEN 'none_returned' ELSE 'no_official' END AS status FROM r
""")
def definition_status(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity"))
    status = F.when(F.col("quantity") > 150, "defined").when(F.contains("flags", F.lit("R")), "error").when(F.col("suppliers") == 1, "none_returned").otherwise("no_official")
    return g.withColumn("status", status)

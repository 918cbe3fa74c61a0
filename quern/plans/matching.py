"""Queries over terms: lexical scores, dictionary matches, cascades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import matching as M
from quern.operators import spans as P
from quern.operators.lexical import best_bm25
from quern.operators.lexical import bm25 as bm25_scores
from quern.operators.order import written
from quern.operators.validate import all_failing
from quern.operators.vectors import top
from quern.plans.catalog import query
from quern.tables import load

TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9가-힣]+'), lambda x: length(x) >= 2)"
BM25 = f"""
WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT item_id AS query_id, {TOKENS} AS t FROM benchmark),
n AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d), qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(t) AS token FROM q) GROUP BY ALL),
tf AS (SELECT token, doc_id, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score
      FROM tf JOIN df USING (token) JOIN qt USING (token), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def texts(spark, sf_dir):
    """Tokens of the items as queries and of all documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens")), docs


@query(BM25 + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25(spark, sf_dir):
    return best_bm25(*texts(spark, sf_dir), 5)


@query(BM25 + """, p AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN labels ON doc_id % 40 = item_id % 40),
u AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s ANTI JOIN p USING (query_id, doc_id))
SELECT query_id, doc_id, score, rank FROM u WHERE rank <= 5""")
def bm25_unseen(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m"))
    pooled = items.join(load(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 40).alias("m")), "m").select("query_id", "doc_id").distinct()
    most = pooled.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    best = best_bm25(*texts(spark, sf_dir), 5 + most).drop("rank")
    return top(best.join(pooled, ["query_id", "doc_id"], "left_anti"), ["query_id"], 5, F.desc("score"), F.col("doc_id"))


@query(BM25 + """,
c AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9가-힣]+'), lambda x: length(x) >= 6))) AS concept FROM benchmark),
m AS (SELECT item_id, doc_id, count(*) AS coverage FROM c JOIN documents ON contains(lower(text), concept) GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT m.*, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, coalesce(score, 0) DESC, m.doc_id) AS place FROM m LEFT JOIN s ON s.query_id = item_id AND s.doc_id = m.doc_id)
SELECT item_id, doc_id, coverage, place FROM o WHERE place <= 3
""")
def concept_coverage(spark, sf_dir):
    """How many of an item's concepts a text contains, as part of longer words too: two or more, the best three texts, ties by BM25, then id."""
    c = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text"), 6))).alias("key"))
    found = M.match_terms(load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), c.select("key").distinct(), longest=False)
    d = found.select(F.col("id").alias("doc_id"), "key").distinct().join(F.broadcast(c), "key")  # a stated set of items, whose terms match_terms bounds
    covered = d.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("coverage")).where("coverage >= 2")
    # only texts that could still be among the three are scored
    close = covered.withColumn("_r", F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("coverage")))).where("_r <= 3").drop("_r")
    close = written(close.withColumnRenamed("item_id", "query_id"), "covered")
    scored = close.join(bm25_scores(*texts(spark, sf_dir), pairs=close), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).where("place <= 3").select(F.col("query_id").alias("item_id"), "doc_id", "coverage", "place")


@query(f"""
WITH k AS (SELECT DISTINCT unnest({TOKENS}) AS key FROM benchmark), t AS (SELECT doc_id, lang, unnest({TOKENS}) AS key FROM documents)
SELECT key, count(DISTINCT doc_id) AS docs, count(*) AS occurrences, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es,
       row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, count(*) DESC, -length(key), key) AS place FROM t JOIN k USING (key) GROUP BY key
""")
def term_stats(spark, sf_dir):
    k = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("key")).distinct()
    t = load(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(T.tokens(F.col("text"))).alias("key")).join(k, "key", "left_semi")
    per_doc = t.groupBy("key", "doc_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    langs = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("en", "fr", "de", "es")]
    g = per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("occurrences"), *langs)
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("docs"), F.desc("occurrences"), -F.length("key"), "key")))  # a row a term of the dictionary


@query("""
WITH s AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) % 1000 AS a FROM events), sp AS (SELECT id, user_id, a AS "start", a + 5 + id % 20 AS "end" FROM s WHERE id % 5 = 0),
tk AS (SELECT user_id, a - a % 10 AS t0, a - a % 10 + 10 AS t1, CASE WHEN a % 20 < 10 THEN 'N' ELSE 'V' END AS tag FROM s WHERE id % 5 <> 0 GROUP BY ALL),
j AS (SELECT sp.id, sp.user_id, "start", "end", count(t0) AS n, min(t0) AS f, max(t1) AS l, arg_max(tag, (t1, tag)) AS tag FROM sp LEFT JOIN tk ON sp.user_id = tk.user_id AND "start" < t1 AND t0 < "end" GROUP BY ALL)
SELECT id AS span_id, CASE WHEN n = 0 THEN 'no_morpheme' WHEN f <> "start" OR l <> "end" THEN 'not_token_aligned' WHEN tag NOT IN ('N') THEN 'non_nominal_morpheme' END AS reason FROM j
""")
def span_align(spark, sf_dir):
    s = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), (F.unix_timestamp("ts") % 1000).alias("a"))
    spans = s.where("event_id % 5 = 0").select("event_id", "id", F.col("a").alias("start"), (F.col("a") + 5 + F.col("event_id") % 20).alias("end"))
    low = F.col("a") - F.col("a") % 10
    tokens = s.where("event_id % 5 <> 0").select("id", low.alias("start"), (low + 10).alias("end"), F.when(F.col("a") % 20 < 10, "N").otherwise("V").alias("tag")).distinct()
    return P.aligned(spans.withColumnRenamed("event_id", "span"), tokens, lambda tag: tag == "N").select(F.col("span").alias("span_id"), "reason")


@query("""
WITH h AS (SELECT doc_id, CAST(contains(text, 'licens') AS INT) + CAST(contains(text, 'rights') AS INT) AS a, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'que') AS INT) + CAST(contains(text, 'und') AS INT) AS b FROM documents)
SELECT doc_id, CASE WHEN a >= 1 AND b >= 2 THEN 'mixed' WHEN a >= 1 THEN 'strong_for' WHEN b >= 2 THEN 'strong_against' ELSE 'neutral' END AS signal FROM h
""")
def keyword_diagnosis(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", M.group_signal(F.col("text"), ["licens", "rights"], ["the", "que", "und"]).alias("signal"))


@query("""
WITH t AS (SELECT item_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
k AS (SELECT *, lower(regexp_replace(term, '[.,]', '', 'g')) AS key FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY item_id, pos) AS n FROM k)
SELECT item_id, pos, term, array_to_string(list_filter([CASE WHEN length(term) < 3 THEN 'short' END, CASE WHEN regexp_matches(term, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(term, '[.,]$') THEN 'punctuation' END,
       CASE WHEN n > 1 THEN 'duplicate_key' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r
""")
def noise_filter(spark, sf_dir):
    t = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)
    t = t.withColumn("n", F.row_number().over(Window.partitionBy(F.lower(F.regexp_replace("term", "[.,]", ""))).orderBy("item_id", "pos")))
    rules = [("short", F.length("term") < 3), ("digit", F.col("term").rlike("[0-9]")), ("punctuation", F.col("term").rlike("[.,]$")), ("duplicate_key", F.col("n") > 1)]
    return t.select("item_id", "pos", "term", F.array_join(all_failing(rules), ",").alias("reasons"))


@query("""
WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part), p AS (SELECT DISTINCT p_name || ' ' || p_type AS parent FROM part)
SELECT parent, key FROM p JOIN k ON contains(parent, key) AND parent <> key AND length(key) >= 2
""")
def substring_join(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    keys = part.select(F.explode(F.split("p_name", " ")).alias("key")).where("length(key) >= 2").distinct()
    parents = part.select(F.concat_ws(" ", "p_name", "p_type").alias("parent")).distinct().withColumn("id", F.xxhash64("parent"))
    found = M.match_terms(parents, keys, "id", "parent", longest=False).select("id", "key").distinct()
    return found.join(parents, "id").where(F.contains("parent", F.col("key")) & (F.col("parent") != F.col("key"))).select("parent", "key")


@query()
def longest_spans(spark, sf_dir):
    terms = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), 4)).alias("key"))
    return M.match_terms(load(spark, sf_dir, "documents").withColumn("text", F.lower("text")), terms)


@query("""
SELECT conv_id, turn, array_to_string(list_filter(range(0, greatest(length(text) - 1, 0)), lambda i: substring(text, CAST(i AS INT) + 1, 2) = 'en'), ',') AS places FROM conversations WHERE length(text) >= 2
""")
def overlapping_occurrences(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where("length(text) >= 2").select("conv_id", "turn", F.array_join(M.occurrences(F.col("text"), "en"), ",").alias("places"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size > 45 THEN 'excluded' WHEN p_type = 'ECONOMY' AND p_size < 10 THEN 'ready' WHEN p_brand = 'Brand#1' THEN 'review' ELSE 'lookup' END AS status,
       p_size <= 45 AND (p_type = 'ECONOMY' AND p_size < 10) AS ready,
       (CASE WHEN p_type = 'ECONOMY' THEN 100 ELSE 60 END) + (CASE p_brand WHEN 'Brand#1' THEN 30 WHEN 'Brand#2' THEN 18 ELSE 0 END) + least(3 * (p_size % 10), 24) AS score FROM p
""")
def status_cascade(spark, sf_dir):
    size, kind, brand = F.col("p_size"), F.col("p_type"), F.col("p_brand")
    ready = (kind == "ECONOMY") & (size < 10)
    status = F.when(size > 45, "excluded").when(ready, "ready").when(brand == "Brand#1", "review").otherwise("lookup")
    score = F.when(kind == "ECONOMY", 100).otherwise(60) + F.when(brand == "Brand#1", 30).when(brand == "Brand#2", 18).otherwise(0) + F.least(3 * (size % 10), F.lit(24))
    return load(spark, sf_dir, "part").select("p_partkey", status.alias("status"), ((size <= 45) & ready).alias("ready"), score.alias("score"))


#: Terms looked for in the turns, of which some contain others or end within a word.
VALIDATED = ["the", "and", "in the", "the and", "there", "tion", "er", "is", "nowhere found"]


@query(f"""
WITH w AS (SELECT conv_id * 1000 + turn AS id, text, string_split(text, ' ') AS w FROM conversations),
tk AS (SELECT id, coalesce(list_sum([length(x) + 1 FOR x IN w[:i - 1]]), 0)::BIGINT AS a, length(w[i]) AS n, CASE WHEN length(w[i]) % 3 = 0 THEN 'NNG' ELSE 'VV' END AS tag FROM w, range(1, 2000) AS r(i) WHERE i <= len(w) AND w[i] <> ''),
k AS (SELECT unnest({VALIDATED}) AS key),
s AS (SELECT id, i - 1 AS a, i - 1 + length(key) AS z, key FROM w, k, range(1, 4000) AS r(i) WHERE i <= length(text) AND substring(text, i, length(key)) = key),
j AS (SELECT s.id, s.a, s.z, key, min({{'a': tk.a, 'z': tk.a + n, 't': tag}}) AS f, max({{'a': tk.a, 'z': tk.a + n, 't': tag}}) AS l FROM s LEFT JOIN tk ON tk.id = s.id AND s.a < tk.a + n AND tk.a < s.z GROUP BY ALL),
v AS (SELECT id, a, z, key, CASE WHEN f.a IS NULL THEN 'no_morpheme' WHEN f.a <> a OR l.z <> z THEN 'not_token_aligned' WHEN l.t <> 'NNG' THEN 'non_nominal_morpheme' END AS reason FROM j),
c AS (SELECT v.*, reason IS NULL AND NOT EXISTS (SELECT 1 FROM v o WHERE o.reason IS NULL AND o.id = v.id AND o.a < v.z AND v.a < o.z AND (o.z - o.a > v.z - v.a OR (o.z - o.a = v.z - v.a AND o.a < v.a))) AS kept FROM v),
x AS (SELECT key, string_agg(id || ':' || a || ':' || reason, ',' ORDER BY id, a) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, a) AS n FROM v WHERE reason IS NOT NULL) WHERE n <= 5 GROUP BY key)
SELECT key, count(DISTINCT id) FILTER (kept) AS texts, count(*) FILTER (kept) AS occurrences, count(*) FILTER (reason = 'not_token_aligned') AS not_token_aligned, count(*) FILTER (reason = 'non_nominal_morpheme') AS non_nominal_morpheme,
       CASE WHEN count(*) FILTER (kept) = 0 THEN 'excluded' WHEN count(reason) > 0 THEN 'partial' ELSE 'valid' END AS status, coalesce(any_value(examples), '') AS examples
FROM c LEFT JOIN x USING (key) GROUP BY key
""", "MAT-4 MAT-5 MAT-1 MAT-2")
def validated_terms(spark, sf_dir):
    """Terms found in turns, checked against the words' borders and tags; overlaps go to the longest, with rejects and examples by term."""
    d = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    words = d.withColumn("w", F.split("text", " ", -1)).select("id", F.posexplode(F.transform("w", lambda x, i: F.struct(F.aggregate(F.slice("w", 1, i), F.lit(0), lambda a, y: a + F.length(y) + 1).alias("start"), F.length(x).alias("n")))).alias("i", "x"))
    tokens = words.select("id", "x.start", (F.col("x.start") + F.col("x.n")).alias("end"), F.when(F.col("x.n") % 3 == 0, "NNG").otherwise("VV").alias("tag")).where("end > start")
    found = M.match_terms(d, spark.createDataFrame([(t,) for t in VALIDATED], "key string"), "id", "text", longest=False)
    spans = found.withColumn("span", F.concat_ws(":", "id", "start", "key"))
    g = P.term_validation(spans, tokens)
    examples = F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["id"], x["start"], x["reason"])), ",")
    return g.select("key", "texts", "occurrences", "not_token_aligned", "non_nominal_morpheme", "status", F.coalesce(examples, F.lit("")).alias("examples"))

"""Queries over term dictionaries. Parts stand for catalogue entries, their names' words for components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import labels as L
from quern.operators import sampling as S
from quern.operators import terms as K
from quern.operators import validate as V
from quern.operators.order import numbered
from quern.plans.catalog import query
from quern.tables import load

#: A part's name as three spellings: in capitals, without the space, as it is.
SPELT = "CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '') ELSE p_name END"
ENTRIES = f"WITH e AS (SELECT p_partkey, {SPELT} AS term, lower(replace(p_name, ' ', '')) AS key, p_type || ', ' || p_brand AS codes FROM part) "
SPACED, OPENINGS = "[A-Za-z] +[A-Za-z]", "[()·ㆍ-]"


def entries(spark, sf_dir):
    spelt = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", spelt.alias("term"), F.concat_ws(", ", "p_type", "p_brand").alias("codes"))


@query(ENTRIES + """, v AS (SELECT key, term, NOT regexp_matches(term, '[A-Za-z] +[A-Za-z]') AS a, regexp_matches(term, '^[()·ㆍ-]') AS b FROM e GROUP BY ALL),
r AS (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY a, b, length(term), term) AS n FROM v),
c AS (SELECT DISTINCT key, trim(unnest(string_split(codes, ','))) AS code FROM e), c2 AS (SELECT key, string_agg(code, ',' ORDER BY code) AS codes FROM c GROUP BY key)
SELECT e.key, max(r.term) AS term, string_agg(DISTINCT e.term, ',' ORDER BY e.term) AS variants, max(c2.codes) AS codes, count(*) AS entries FROM e JOIN r ON r.key = e.key AND n = 1 JOIN c2 ON c2.key = e.key GROUP BY e.key
""", "AGG-1 W-14")
def term_groups(spark, sf_dir):
    g = K.term_groups(entries(spark, sf_dir), T.term_key(F.col("term")), SPACED, OPENINGS)
    return g.select("key", "term", F.array_join("variants", ",").alias("variants"), F.array_join("codes", ",").alias("codes"), "entries")


@query("""
WITH i AS (SELECT p_name AS key, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_partkey::VARCHAR END AS id FROM part), d AS (SELECT DISTINCT key, id FROM i)
SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY NOT regexp_matches(id, '^[0-9]+$'), CASE WHEN regexp_matches(id, '^[0-9]+$') THEN id::BIGINT END, id) AS place FROM d
""", "AGG-1")
def term_ids(spark, sf_dir):
    """A group's ids, numbers first."""
    d = load(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string")).alias("id")).distinct()
    return d.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*K.numeric_first(F.col("id")))))


@query("""
WITH t AS (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark), k AS (SELECT term, lower(trim(term, '.,!?')) AS key FROM t)
SELECT CASE WHEN term = '' THEN 'empty_term' WHEN length(key) < 2 THEN 'too_short' WHEN NOT regexp_matches(key, '[a-z]') THEN 'no_letter' ELSE 'kept' END AS status, count(*) AS terms FROM k GROUP BY ALL
""", "FLT-5 AGG-1")
def term_exclusions(spark, sf_dir):
    k = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).withColumn("key", F.lower(F.btrim("term", F.lit(".,!?"))))
    rules = [("empty_term", F.col("term") == ""), ("too_short", F.length("key") < 2), ("no_letter", ~K.matchable(F.col("key"), "[a-z]"))]
    return k.groupBy(V.first_failing(rules, "kept").alias("status")).agg(F.count(F.lit(1)).alias("terms"))


@query("SELECT s_suppkey, lower(replace(s_name, '#', '')) AS key FROM supplier", "STR-7")
def term_key(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.term_key(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("key"))


@query("""
WITH s AS (SELECT l_returnflag || l_linestatus AS term, lower(l_returnflag) AS key, l_orderkey AS source_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
       CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS place, CASE WHEN l_linenumber > 4 THEN '' ELSE l_linenumber::VARCHAR END AS article, CAST(l_quantity AS BIGINT) AS occurrences FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY key, source_id ORDER BY seq) AS n FROM s)
SELECT key, (SELECT string_agg(DISTINCT term, ',' ORDER BY term) FROM s WHERE s.key = f.key) AS variants, count(DISTINCT nullif(place, '')) AS documents,
       count(DISTINCT CASE WHEN place <> '' OR article <> '' THEN (place, article) END) AS articles, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM f WHERE n = 1 GROUP BY key
""", "AGG-6")
def merged_sources(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    text = lambda c, hidden: F.when(hidden, "").otherwise(F.col(c).cast("string"))
    rows = l.select(F.lower("l_returnflag").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("term"), F.col("l_orderkey").alias("source_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), text("l_suppkey", F.col("l_suppkey") % 7 == 0).alias("place"), text("l_linenumber", F.col("l_linenumber") > 4).alias("article"), F.col("l_quantity").cast("long").alias("occurrences"))
    return K.merged_sources(rows).select("key", F.array_join("variants", ",").alias("variants"), "documents", "articles", "occurrences")


@query("""
SELECT p_name AS text, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(DISTINCT nullif(CASE WHEN p_size > 40 THEN '' ELSE p_brand END, ''), ',' ORDER BY nullif(CASE WHEN p_size > 40 THEN '' ELSE p_brand END, '')) AS brands FROM part GROUP BY p_name
""", "AGG-7")
def identical_definitions(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("types"), F.when(F.col("p_size") > 40, "").otherwise(F.col("p_brand")).alias("brands"))
    return K.identical_texts(rows, "text", ["types", "brands"]).select("text", F.array_join("types", ",").alias("types"), F.array_join("brands", ",").alias("brands"))


@query("""
WITH a AS (SELECT p_name AS key, min(p_partkey) AS id FROM part WHERE p_type = 'PROMO' GROUP BY 1), b AS (SELECT p_name AS key, min(p_partkey) AS id FROM part WHERE p_brand IN ('Brand#3', 'Brand#7') GROUP BY 1)
SELECT coalesce(b.key, a.key) AS key, coalesce(b.id, a.id) AS id, CASE WHEN b.key IS NOT NULL THEN 'lookup' ELSE 'glossary' END AS definition_source FROM a FULL JOIN b ON a.key = b.key
""", "JOIN-16")
def definition_index(spark, sf_dir):
    """Definitions by key of two sources, the later one first."""
    part = load(spark, sf_dir, "part")
    of = lambda rows: rows.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    d = L.first_by_source([of(part.where(F.col("p_brand").isin("Brand#3", "Brand#7"))), of(part.where("p_type = 'PROMO'"))], ["key"], ["id"])
    return d.select("key", "id", F.when(F.col("source_no") == 0, "lookup").otherwise("glossary").alias("definition_source"))


@query("""
SELECT DISTINCT p_name || ' ' || p_brand AS key FROM part WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_type = 'PROMO') AND p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_size > 40)
""", "FLT-9")
def lookup_needed(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_brand"))
    return K.not_known(part.select("key").distinct(), part.where("p_type = 'PROMO'"), part.where("p_size > 40"))


@query("""
WITH n AS (SELECT p_partkey, p_name || CASE p_type WHEN 'PROMO' THEN ' act' WHEN 'LARGE' THEN ' statute' ELSE '' END AS name FROM part)
SELECT p_partkey, length(name) >= 3 AND regexp_matches(name, '(act|statute)$') AS statute FROM n
""", "FLT-10")
def statute_names(spark, sf_dir):
    kind = F.col("p_type")
    name = F.concat("p_name", F.when(kind == "PROMO", " act").when(kind == "LARGE", " statute").otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", T.ends_as_statute(name, ["act", "statute"]).alias("statute"))


@query("""
WITH p AS (SELECT o_custkey AS c_custkey, count(*) AS cases, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT c_custkey, c_name AS term, coalesce(cases, 0) AS case_count, round(coalesce(total, 0), 2) AS occurrence_count FROM customer LEFT JOIN p USING (c_custkey)
""", "PRJ-3")
def lookup_projection(spark, sf_dir):
    stats = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.struct(F.count(F.lit(1)).alias("cases"), F.sum("o_totalprice").alias("total")).alias("source"))
    d = load(spark, sf_dir, "customer").join(stats, "c_custkey", "left")
    return d.select("c_custkey", F.col("c_name").alias("term"), F.coalesce("source.cases", F.lit(0)).alias("case_count"), F.round(F.coalesce("source.total", F.lit(0.0)), 2).alias("occurrence_count"))


@query(ENTRIES + """, p AS (SELECT key AS pattern, key FROM e UNION ALL SELECT lower(term), key FROM e WHERE term <> '')
SELECT pattern, max(key) AS key FROM p GROUP BY pattern
""", "MAT-3")
def match_patterns(spark, sf_dir):
    g = K.term_groups(entries(spark, sf_dir), T.term_key(F.col("term")), SPACED, OPENINGS)
    return K.patterns(g, F.lower("variant"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS w, list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: CASE WHEN length(x) >= 4 THEN 'NN' ELSE 'JJ' END) AS t FROM part),
s AS (SELECT p_partkey, w, t, unnest(range(1, len(w) + 1)) AS a FROM w), g AS (SELECT *, unnest(range(1, 5)) AS n FROM s),
c AS (SELECT p_partkey, array_to_string(w, '') AS whole, array_to_string(w[a:a + n - 1], '') AS component, n FROM g WHERE a + n - 1 <= len(w) AND len(list_filter(t[a:a + n - 1], lambda x: x <> 'NN')) = 0)
SELECT p_partkey, component, CASE WHEN min(n) > 1 THEN 'ngram' WHEN max(n) = 1 THEN 'token' ELSE 'ngram,token' END AS methods FROM c WHERE length(component) >= 2 AND component <> whole GROUP BY p_partkey, component
""", "MAT-7")
def morpheme_ngrams(spark, sf_dir):
    words = F.split(F.concat_ws(" ", F.col("p_name"), F.lower("p_type")), " ")
    tags = F.transform(words, lambda w: F.when(F.length(w) >= 4, "NN").otherwise("JJ"))
    terms = load(spark, sf_dir, "part").withColumn("key", F.col("p_partkey"))
    d = K.components(terms, tags, words, F.array_join(words, ""), "^NN")
    return d.select(F.col("key").alias("p_partkey"), "component", F.array_join("methods", ",").alias("methods"))


@query("""
WITH w AS (SELECT lower(unnest(string_split(text, ' '))) AS term, item_id FROM benchmark), t AS (SELECT term, count(DISTINCT item_id) AS items FROM w WHERE term <> '' GROUP BY 1)
SELECT term, CASE WHEN term IN ('the', 'licence') THEN 'selected' WHEN term IN ('water', 'und') THEN 'excluded' WHEN items < 2 THEN 'excluded' WHEN term IN ('of', 'and', 'de') THEN 'excluded' WHEN regexp_matches(term, '(act|law|ung)$') THEN 'excluded' ELSE 'selected' END AS decision,
       CASE WHEN term IN ('the', 'licence') THEN 'user_selected' WHEN term IN ('water', 'und') THEN 'user_excluded' WHEN items < 2 THEN 'excluded_before' WHEN term IN ('of', 'and', 'de') THEN 'common_word' WHEN regexp_matches(term, '(act|law|ung)$') THEN 'statute_name' ELSE 'kept_in_doubt' END AS reason FROM t
""", "MAT-12")
def user_selection(spark, sf_dir):
    """Words of the benchmark as terms; those of one item alone were excluded before."""
    w = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("term")).select("item_id", F.lower("term").alias("term"))
    t = w.where("term <> ''").groupBy("term").agg((F.countDistinct("item_id") >= 2).alias("included"))
    got = K.user_selection(F.col("term"), F.col("included"), ["the", "licence"], ["water", "und"], ["of", "and", "de"], F.col("term").rlike("(act|law|ung)$"))
    return t.select("term", got.alias("x")).select("term", "x.*")


@query(None, "MAT-8")
def component_cover(spark, sf_dir):
    """Each part's name and type, covered by the longest words and word pairs of all parts that it contains."""
    part = load(spark, sf_dir, "part")
    parents = part.select(F.lower(F.concat("p_name", "p_type")).alias("parent"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w")).distinct()
    return K.cover(parents.select(F.regexp_replace("parent", " ", "").alias("parent"), F.concat("w", F.array(F.array_join(F.slice("w", 2, 2), ""))).alias("components")))


@query("""
WITH d AS (SELECT p_brand AS key, p_name AS definition, count(*) AS matches, min(p_partkey) AS definition_id FROM part GROUP BY ALL), r AS (SELECT p_partkey, p_brand AS key, CASE WHEN p_size > 45 THEN p_name || ' x' ELSE p_name END AS definition FROM part)
SELECT p_partkey, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN definition_id END AS definition_id FROM r LEFT JOIN d USING (key, definition)
""", "JOIN-17")
def manual_definitions(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    dictionary = part.select(F.col("p_brand").alias("key"), F.col("p_name").alias("definition"), F.col("p_partkey").alias("definition_id"))
    rows = part.select("p_partkey", F.col("p_brand").alias("key"), F.when(F.col("p_size") > 45, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("definition"))
    return K.one_match(rows, dictionary, "key", "definition").select("p_partkey", "matches", "definition_id")


@query("SELECT 'c' || c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier", "SET-5")
def glossary_union(spark, sf_dir):
    """Two lists as one; a key that both have fails the job."""
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("customer").alias("source"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.lit("supplier").alias("source"))
    return V.require_unique(c.unionByName(s), ["key"])


@query("""
WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg(n || '. [' || role || '] ' || trim(text), chr(10) ORDER BY n) AS definitions FROM r GROUP BY conv_id
""", "STR-33")
def numbered_definitions(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("category"), F.col("text").alias("definition"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.numbered(turns).alias("definitions"))


@query("""
WITH o AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
q AS (SELECT p_partkey FROM o WHERE p_partkey IN (5, 17, 42)),
w AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / 26.0, 0) AS BIGINT) AS i FROM (SELECT unnest(range(0, 27)) AS k), (SELECT max(n) AS n FROM o)),
a AS (SELECT p_partkey, 0 AS step, i FROM o WHERE p_partkey IN (FROM q) UNION ALL SELECT p_partkey, 1, i FROM o WHERE i IN (SELECT i FROM w) AND p_partkey NOT IN (FROM q)),
f AS (SELECT p_partkey, 2 AS step, i FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY i LIMIT (30 - (SELECT count(*) FROM a)))
SELECT p_partkey, step FROM a UNION ALL SELECT p_partkey, step FROM f
""", "SMP-8")
def dictionary_sample(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return S.required_then_spaced(d, "p_partkey", [5, 17, 42], 30, [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "step")


@query("""
WITH g AS (SELECT p_name AS term, count(DISTINCT p_type) AS definitions FROM part GROUP BY 1), l AS (SELECT unnest(['red bolt', 'blue bolt', 'hot gear', 'large widget']) AS term, unnest(range(0, 4)) AS place)
SELECT l.term, CAST(place AS INTEGER) AS place, coalesce(definitions, 0) AS definitions, coalesce(definitions, 0) >= CASE WHEN place < 2 THEN 2 ELSE 1 END AS fits FROM l LEFT JOIN g USING (term)
""", "SMP-10")
def final_sample(spark, sf_dir):
    """A fixed list of terms in its order, the first two of which need several definitions."""
    terms = ["red bolt", "blue bolt", "hot gear", "large widget"]
    g = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.countDistinct("p_type").alias("definitions"))
    d = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int").join(g, "term", "left").withColumn("definitions", F.coalesce("definitions", F.lit(0)))
    return d.select("term", "place", "definitions", (F.col("definitions") >= F.when(F.col("place") < 2, 2).otherwise(1)).alias("fits"))


@query("""
WITH r AS (SELECT p_partkey, p_size % 4 AS definitions, p_size % 2 = 0 AS ready, p_size % 3 <> 0 AS included FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN definitions < 1 THEN 'no_definition' END, CASE WHEN ready AND NOT included THEN 'ready_but_excluded' END, CASE WHEN ready AND definitions <> 1 THEN 'ready_but_several' END], lambda x: x IS NOT NULL), ',') AS faults FROM r
""", "V-8")
def review_rows(spark, sf_dir):
    size = F.col("p_size")
    n, ready, included = size % 4, size % 2 == 0, size % 3 != 0
    rules = [("no_definition", n < 1), ("ready_but_excluded", ready & ~included), ("ready_but_several", ready & (n != 1))]
    return V.require_unique(load(spark, sf_dir, "part"), ["p_partkey"]).select("p_partkey", F.array_join(V.all_failing(rules), ",").alias("faults"))


@query("""
WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, row_number() OVER (PARTITION BY p_name, p_type, p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_type, p_brand) AS place FROM p WHERE n = 1
""", "SRC-12")
def term_catalogue(spark, sf_dir):
    """Pages of terms as one catalogue: of rows that agree in all naming fields the first one read."""
    fields = ["p_name", "p_type", "p_brand"]
    d = load(spark, sf_dir, "part").groupBy(*fields).agg(F.min("p_partkey").alias("p_partkey"))
    return numbered(d, fields).select("p_partkey", "p_name", "place")


@query("""
WITH s AS (SELECT conv_id, turn, trim(text) AS definition, role FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, definition, role ORDER BY turn) AS n FROM s WHERE definition <> ''),
c AS (SELECT conv_id, count(*) AS senses, count(*) FILTER (role = 'assistant') AS own FROM u WHERE n = 1 GROUP BY 1), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(senses, 0) AS senses, coalesce(own, 0) AS own, CASE WHEN coalesce(senses, 0) > 0 THEN 'exact' ELSE 'not_found' END AS status FROM a LEFT JOIN c USING (conv_id)
""", "SRC-14")
def dictionary_senses(spark, sf_dir):
    """Items of senses as one row an item: distinct senses, those of one category, and the lookup's status."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.trim("text").alias("definition"), "role")).alias("senses"))
    s = c.select("conv_id", F.explode("senses").alias("s")).select("conv_id", "s.*").where("definition <> ''").distinct()
    n = s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("senses"), F.count_if(F.col("role") == "assistant").alias("own"))
    d = c.select("conv_id").join(n, "conv_id", "left").na.fill(0, ["senses", "own"])
    return d.withColumn("status", F.when(F.col("senses") > 0, "exact").otherwise("not_found"))

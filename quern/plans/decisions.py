"""Queries of decisions: rule cascades over documents and pages, checks of verdicts, labels that later decisions change."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import decisions as D
from quern.operators import validate as V
from quern.operators.order import numbered
from quern.plans.catalog import query
from quern.tables import load

GRADES = "SELECT doc_id, quality * 2 + toxic AS grade FROM labels"


def grades(spark, sf_dir):
    return load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("grade"))


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE o_orderpriority END AS issue, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderstatus END AS summary FROM orders)
SELECT o_orderkey, trim(coalesce(issue, '')) <> '' OR trim(coalesce(summary, '')) <> '' AS either, trim(coalesce(issue, '')) <> '' AND trim(coalesce(summary, '')) <> '' AS both FROM f
""", "FLT-1")
def core_fields(spark, sf_dir):
    issue, summary = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderpriority")), F.when(F.col("o_totalprice") >= 100000, F.col("o_orderstatus"))
    return load(spark, sf_dir, "orders").select("o_orderkey", D.core_fields(issue, summary).alias("either"), D.core_fields(issue, summary, "issue_and_summary").alias("both"))


@query("""
SELECT conv_id, turn, (length(text) <= 120 AND regexp_matches(text, '(the|and) .*(of|is)')) OR (length(text) <= 150 AND regexp_matches(text, 'que|und')) AS low FROM conversations
""", "FLT-3")
def low_substance(spark, sf_dir):
    rules = ((120, "(the|and) .*(of|is)"), (150, "que|und"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.low_substance(F.col("text"), rules).alias("low"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(coalesce(text, '')) < 3000 AND length(coalesce(text, '')) >= 300", "FLT-4")
def reason_range(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(D.in_length_range(F.col("text"), 3000, 300)).select("doc_id", "n_chars")


@query("""
WITH t AS (SELECT 'q' || lpad((conv_id % 1000)::VARCHAR, 3, '0') AS query_id, conv_id, turn FROM conversations), n AS (SELECT *, CAST(regexp_extract(query_id, 'q([0-9]+)$', 1) AS INTEGER) AS number FROM t)
SELECT query_id, number, count(*) AS candidates, row_number() OVER (ORDER BY number) AS place FROM n WHERE number BETWEEN 3 AND 60 GROUP BY query_id, number
""", "FLT-12 TOP-5")
def target_cases(spark, sf_dir):
    """Targets by query in a range of question numbers, in their order; a candidate that is there twice fails the job."""
    from pyspark.sql import Window

    t = load(spark, sf_dir, "conversations").select(F.concat(F.lit("q"), F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0")).alias("query_id"), "conv_id", "turn")
    n = V.require_unique(t, ["query_id", "conv_id", "turn"]).withColumn("number", F.regexp_extract("query_id", "q([0-9]+)$", 1).cast("int")).where(F.col("number").between(3, 60))
    g = n.groupBy("query_id", "number").agg(F.count(F.lit(1)).alias("candidates"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("number")))


@query("SELECT conv_id AS query_id, turn AS candidate_id, role AS assessment FROM conversations", "PRJ-1")
def flat_reviews(spark, sf_dir):
    """A row an assessment of nested reviews; a candidate assessed twice fails the job."""
    nested = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("candidate_id"), F.col("role").alias("assessment"))).alias("assessments"))
    d = nested.select(F.col("conv_id").alias("query_id"), F.explode("assessments").alias("a")).select("query_id", "a.*")
    return V.require_unique(d, ["query_id", "candidate_id"])


TERMS = "list_filter(['page', 'lang', 'table', 'cookie'], lambda t: contains(html, t))"
PAGES = f"WITH p AS (SELECT page_id, url, html, {TERMS} AS terms, list_filter(['fr', 'de', 'es'], lambda t: contains(url, '/' || t || '/')) AS title, length(html) % 9 AS score FROM pages) "


def page_signals(spark, sf_dir):
    html, url = F.col("html"), F.col("url")
    title = F.filter(F.array(*map(F.lit, ["fr", "de", "es"])), lambda t: F.contains(url, F.concat(F.lit("/"), t, F.lit("/"))))
    return load(spark, sf_dir, "pages").select("page_id", "url", "html", T.found_terms(html, ["page", "lang", "table", "cookie"]).alias("terms"), title.alias("title"), (F.length("html") % 9).alias("score"))


@query(PAGES + "SELECT page_id, url, score, array_to_string(terms, ', ') AS terms, array_to_string(title, ', ') AS title, '' AS decision FROM p", "PRJ-2")
def review_record(spark, sf_dir):
    return page_signals(spark, sf_dir).select("page_id", "url", "score", F.array_join("terms", ", ").alias("terms"), F.array_join("title", ", ").alias("title"), F.lit("").alias("decision"))


TRIAGE = """, t AS (SELECT *, array_to_string(list_filter([CASE WHEN score >= 6 THEN 'score ' || score END, CASE WHEN contains(html, 'table') AND contains(html, 'cookie') THEN 'purpose and context' END,
      CASE WHEN len(title) > 0 THEN 'title: ' || array_to_string(title, ', ') END], lambda x: x IS NOT NULL), '; ') AS reasons FROM p) """


def triaged(spark, sf_dir):
    both = F.array_contains("terms", "table") & F.array_contains("terms", "cookie")
    reasons = D.joined_reasons([(F.col("score") >= 6, F.concat(F.lit("score "), F.col("score").cast("string"))), (both, F.lit("purpose and context")), (F.size("title") > 0, F.concat(F.lit("title: "), F.array_join("title", ", ")))])
    return page_signals(spark, sf_dir).withColumn("reasons", reasons)


@query(PAGES + TRIAGE + "SELECT page_id, CASE WHEN reasons <> '' THEN 'review' ELSE 'exclude' END AS decision, CASE WHEN reasons <> '' THEN reasons ELSE 'no signal' END AS reason FROM t", "V-15")
def triage(spark, sf_dir):
    d = triaged(spark, sf_dir)
    pair = D.first_reason([(F.col("reasons") != "", "review", F.col("reasons"))], ("exclude", F.lit("no signal")))
    return d.select("page_id", pair.alias("p")).select("page_id", "p.decision", "p.reason")


@query(PAGES + TRIAGE + """
SELECT count(*) FILTER (page_id % 3 < 2) AS labelled, count(*) FILTER (page_id % 3 < 2 AND reasons = '') AS evaluated, count(*) FILTER (page_id % 3 = 0 AND reasons = '') AS correct,
       round(count(*) FILTER (page_id % 3 = 0 AND reasons = '') / nullif(count(*) FILTER (page_id % 3 < 2 AND reasons = ''), 0), 4) AS precision FROM t
""", "AGG-15")
def exclusion_precision(spark, sf_dir):
    m = F.col("page_id") % 3
    return D.rule_precision(triaged(spark, sf_dir), m < 2, F.col("reasons") == "", m == 0)


@query("""
WITH a AS (SELECT conv_id, turn, list_filter(['the', 'und'], lambda t: contains(text, t)) AS core, list_filter(['que', 'is', 'der'], lambda t: contains(text, t)) AS anchor, turn = 0 AS purpose, text FROM conversations)
SELECT conv_id, array_to_string(list_filter(['the', 'que', 'der'], lambda t: contains(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (purpose), ''), t)), ',') AS purpose_terms,
       count(*) FILTER (len(core) > 0 AND len(anchor) > 0) AS same_context FROM a GROUP BY conv_id
""", "V-14")
def detail_analysis(spark, sf_dir):
    """Terms of the purpose articles' text, and articles that have a core term and an anchor."""
    text = F.col("text")
    both = (F.size(T.found_terms(text, ["the", "und"])) > 0) & (F.size(T.found_terms(text, ["que", "is", "der"])) > 0)
    purpose = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") == 0, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    g = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(purpose.alias("purpose"), F.count_if(both).alias("same_context"))
    return g.select("conv_id", F.array_join(T.found_terms(F.col("purpose"), ["the", "que", "der"]), ",").alias("purpose_terms"), "same_context")


@query(PAGES + """, s AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' END AS parent, len(title) > 0 AS direct, contains(html, 'table') AS context, contains(html, 'lang') AS purpose FROM p)
SELECT page_id, CASE WHEN contains(url, 'ref=x') THEN 'exclude' WHEN parent = 'exclude' AND direct AND context THEN 'review' WHEN parent = 'exclude' THEN 'exclude'
       WHEN parent = 'include' AND direct AND (purpose OR context) THEN 'include' WHEN parent = 'include' THEN 'review' WHEN direct AND context THEN 'include' WHEN NOT direct AND NOT context AND NOT purpose THEN 'exclude' ELSE 'review' END AS decision,
       CASE WHEN contains(url, 'ref=x') THEN 'other domain' WHEN parent = 'exclude' AND direct AND context THEN 'parent excluded, own evidence' WHEN parent = 'exclude' THEN 'parent excluded'
       WHEN parent = 'include' AND direct AND (purpose OR context) THEN 'parent included, own evidence' WHEN parent = 'include' THEN 'parent included, no evidence' WHEN direct AND context THEN 'title and context' WHEN NOT direct AND NOT context AND NOT purpose THEN 'no evidence' ELSE 'undecided' END AS reason FROM s
""", "V-13 V-12")
def suggestion(spark, sf_dir):
    """The second selection cascade: domain, then the parent's decision with the record's own evidence, then the record alone."""
    m = F.col("page_id") % 4
    parent = F.when(m == 0, "include").when(m == 1, "exclude")
    direct, context, purpose = F.size("title") > 0, F.array_contains("terms", "table"), F.array_contains("terms", "lang")
    no, yes = F.coalesce(parent == "exclude", F.lit(False)), F.coalesce(parent == "include", F.lit(False))
    rules = [
        (F.contains("url", F.lit("ref=x")), "exclude", F.lit("other domain")),
        (no & direct & context, "review", F.lit("parent excluded, own evidence")),
        (no, "exclude", F.lit("parent excluded")),
        (yes & direct & (purpose | context), "include", F.lit("parent included, own evidence")),
        (yes, "review", F.lit("parent included, no evidence")),
        (direct & context, "include", F.lit("title and context")),
        (~direct & ~context & ~purpose, "exclude", F.lit("no evidence")),
    ]
    d = page_signals(spark, sf_dir).select("page_id", D.first_reason(rules, ("review", F.lit("undecided"))).alias("p"))
    return d.select("page_id", "p.decision", "p.reason")


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'human_include' WHEN 'P' THEN 'human_exclude' ELSE CASE WHEN o_totalprice > 200000 THEN 'auto_include' WHEN o_totalprice > 100000 THEN 'auto_exclude' ELSE 'review' END END AS status,
  CASE o_custkey % 3 WHEN 0 THEN 'related' WHEN 1 THEN 'boundary' ELSE 'unlikely' END AS direction, o_orderpriority AS name FROM orders)
SELECT o_orderkey, CASE WHEN status IN ('human_include', 'auto_include') THEN 'include' WHEN status IN ('human_exclude', 'auto_exclude') THEN 'exclude' WHEN direction = 'related' AND name IN ('1-URGENT', '2-HIGH') THEN 'include' ELSE 'exclude' END AS decision,
       CASE WHEN status <> 'review' THEN status ELSE direction END AS reason FROM s
""", "V-16")
def final_decision(spark, sf_dir):
    price, kind = F.col("o_totalprice"), F.col("o_orderstatus")
    status = F.when(kind == "F", "human_include").when(kind == "P", "human_exclude").when(price > 200000, "auto_include").when(price > 100000, "auto_exclude").otherwise("review")
    direction = F.element_at(F.array(*map(F.lit, ["related", "boundary", "unlikely"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    d = load(spark, sf_dir, "orders").withColumn("status", status).withColumn("direction", direction)
    rules = [
        (F.col("status").isin("human_include", "auto_include"), "include", F.col("status")),
        (F.col("status").isin("human_exclude", "auto_exclude"), "exclude", F.col("status")),
        ((F.col("direction") == "related") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "include", F.col("direction")),
    ]
    return d.select("o_orderkey", D.first_reason(rules, ("exclude", F.col("direction"))).alias("p")).select("o_orderkey", "p.decision", "p.reason")


@query(f"""
WITH g AS ({GRADES}), t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [0, 1, 2, 3] WHEN grade >= 2 THEN [2, 3] ELSE [0, 1] END AS allowed FROM g WHERE grade < 3),
d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE grade END AS grade, grade AS independent, CASE WHEN doc_id % 2 = 0 THEN 'not_applicable' WHEN doc_id % 5 = 0 THEN 'unsupported' ELSE 'supported' END AS assessment FROM g WHERE grade > 0)
SELECT doc_id, array_to_string(list_filter([CASE WHEN d.grade IS NULL THEN 'missing' END, CASE WHEN allowed IS NULL THEN 'extra' END, CASE WHEN NOT list_contains(allowed, d.grade) THEN 'not_allowed' END,
  CASE WHEN len(allowed) = 4 AND (d.grade <> independent OR assessment <> 'not_applicable') THEN 'not_independent' END,
  CASE WHEN len(allowed) < 4 AND assessment <> CASE WHEN list_contains(allowed, independent) THEN 'supported' ELSE 'unsupported' END THEN 'wrong_assessment' END], lambda x: x IS NOT NULL), ',') AS faults FROM t FULL JOIN d USING (doc_id)
""", "V-10")
def decision_faults(spark, sf_dir):
    g, i = grades(spark, sf_dir), F.col("doc_id")
    list_of = lambda *xs: F.array(*map(F.lit, xs))
    target = g.where("grade < 3").select("doc_id", F.when(i % 2 == 0, list_of(0, 1, 2, 3)).when(F.col("grade") >= 2, list_of(2, 3)).otherwise(list_of(0, 1)).alias("allowed"))
    made = g.where("grade > 0").select("doc_id", F.when(i % 7 == 0, 3).otherwise(F.col("grade")).alias("grade"), F.col("grade").alias("independent"), F.when(i % 2 == 0, "not_applicable").when(i % 5 == 0, "unsupported").otherwise("supported").alias("assessment"))
    return D.decision_faults(target, made, ["doc_id"]).select("doc_id", F.array_join("faults", ",").alias("faults"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, substring(text, 3, 30) AS a, CASE WHEN turn % 3 = 0 THEN 'zzzz' ELSE substring(text, 1, 12) END AS b FROM conversations),
e AS (SELECT *, regexp_replace(a, '[^\\p{L}\\p{N}]', '', 'g') AS ka, regexp_replace(b, '[^\\p{L}\\p{N}]', '', 'g') AS kb, regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g') AS kt FROM c)
SELECT conv_id, turn, CASE WHEN NOT (length(ka) >= 2 AND contains(kt, ka)) THEN 'first_not_found' WHEN NOT (length(kb) >= 2 AND contains(kt, kb)) THEN 'second_not_found' WHEN trim(text) = '' THEN 'empty'
       WHEN length(text) > 500 THEN 'too_long' WHEN length(text) < 20 OR NOT contains(text, 'th') THEN 'incomplete' END AS fault FROM e
""", "V-11 STR-30")
def explanation_check(spark, sf_dir):
    text = F.col("text")
    a, b = F.substring(text, 3, 30), F.when(F.col("turn") % 3 == 0, "zzzz").otherwise(F.substring(text, 1, 12))
    d = load(spark, sf_dir, "conversations")
    fault = D.explanation_fault(a, T.evidence_in(a, text), b, T.evidence_in(b, text), text, "th")
    return d.select("conv_id", "turn", fault.alias("fault"))


@query("""
WITH s AS (SELECT doc_id, text AS t, doc_id % 10 <> 0 AS same FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT same THEN 'id_mismatch' END, CASE WHEN t = '' THEN 'empty' END, CASE WHEN length(t) > 350 THEN 'too_long:' || length(t) END, CASE WHEN starts_with(t, 'Th') THEN 'banned_opening' END,
       CASE WHEN contains(t, 'que') OR contains(t, 'und') THEN 'polite_style' END], lambda x: x IS NOT NULL), ',') AS errors, CASE WHEN t <> '' AND length(t) < 200 THEN 'too_short:' || length(t) ELSE '' END AS warnings FROM s
""", "V-19")
def easy_summary_check(spark, sf_dir):
    t = F.col("text")
    n = F.length(t).cast("string")
    errors = F.array(F.when(F.col("doc_id") % 10 == 0, "id_mismatch"), F.when(t == "", "empty"), F.when(F.length(t) > 350, F.concat(F.lit("too_long:"), n)), F.when(F.startswith(t, F.lit("Th")), "banned_opening"), F.when(F.contains(t, F.lit("que")) | F.contains(t, F.lit("und")), "polite_style"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"), F.when((t != "") & (F.length(t) < 200), F.concat(F.lit("too_short:"), n)).otherwise("").alias("warnings"))


@query("""
WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Related' WHEN 'view' THEN ' unrelated ' WHEN 'error' THEN 'maybe' ELSE 'related/uncertain' END AS related, CASE user_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '?' END AS confidence,
  CASE WHEN value > 50 THEN true WHEN value > 20 THEN false END AS asked, CASE WHEN user_id % 9 = 0 THEN ' ' ELSE event_type END AS reason FROM events),
n AS (SELECT event_id, CASE trim(lower(related)) WHEN 'related' THEN 'related' WHEN 'unrelated' THEN 'unrelated' WHEN 'related/uncertain' THEN 'related' ELSE 'uncertain' END AS related, CASE lower(confidence) WHEN '?' THEN 'low' ELSE lower(confidence) END AS confidence, asked, reason FROM r)
SELECT event_id, related, confidence, related = 'uncertain' OR confidence = 'low' OR coalesce(asked, false) AS needs_review, CASE WHEN related = 'unrelated' THEN reason END AS exclusion, CASE WHEN trim(reason) = '' THEN 'missing_reason' END AS fault FROM n
""", "V-20")
def basic_verdicts(spark, sf_dir):
    kind, user, value = F.col("event_type"), F.col("user_id") % 4, F.col("value")
    raw = load(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "Related").when(kind == "view", " unrelated ").when(kind == "error", "maybe").otherwise("related/uncertain").alias("related"), F.when(user == 0, "HIGH").when(user == 1, "medium").when(user == 2, "low").otherwise("?").alias("confidence"), F.when(value > 50, True).when(value > 20, False).alias("needs_review"), F.when(F.col("user_id") % 9 == 0, " ").otherwise(kind).alias("reason"), F.lit("").alias("exclusion"))
    return D.basic_verdict(raw).select("event_id", "related", "confidence", "needs_review", "exclusion", "fault")


@query("""
SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'fields' WHEN 1 THEN 'no_similarity' WHEN 2 THEN 'blank_point' WHEN 3 THEN 'blank_text' END AS fault FROM events
""", "V-21")
def comparison_check(spark, sf_dir):
    point = '{{"user_point":"{}","case_point":"b","explanation":"c"}}'
    whole = '{{"similarities":[{}],"differences":[],"comparison_text":"{}","notice":"n"}}'
    kinds = ['{"similarities":[]}', whole.format("", "t"), whole.format(point.format(" "), "t"), whole.format(point.format("a"), " "), whole.format(point.format("a"), "t")]
    raw = F.element_at(F.array(*map(F.lit, kinds)), (F.col("user_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", D.structured_fault(raw).alias("fault"))


@query(f"SELECT doc_id, grade, CASE WHEN grade < 2 THEN 'initial' ELSE 'positive_recheck' END AS source FROM ({GRADES})", "SET-6")
def combined_decisions(spark, sf_dir):
    g = grades(spark, sf_dir)
    return D.combined([("initial", g.where("grade < 2")), ("positive_recheck", g.where("grade >= 2"))], ["doc_id"]).select("doc_id", "grade", "source")


@query(f"""
WITH g AS ({GRADES}), j AS (SELECT g.doc_id, g.grade AS a, CASE WHEN n_chars > 800 AND g.grade >= 2 THEN CAST(n_chars % 4 AS INTEGER) END AS b FROM g JOIN documents USING (doc_id))
SELECT count(b) AS rechecked, count(*) FILTER (a >= 2 AND coalesce(b, a) < 2) AS lowered, count(*) FILTER (a >= 2 AND coalesce(b, a) >= 2) AS kept, count(*) FILTER (coalesce(b, a) >= 2) AS remaining FROM j
""", "AGG-27")
def positive_recheck(spark, sf_dir):
    g = grades(spark, sf_dir)
    long = load(spark, sf_dir, "documents").where("n_chars > 800").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("new"))
    after = g.where("grade >= 2").join(long, "doc_id").select("doc_id", F.col("new").alias("grade"))
    return D.changed_positives(g, after, ["doc_id"])


@query(f"""
WITH g AS ({GRADES}), r AS (SELECT doc_id, unnest(list_filter([CASE WHEN grade >= 2 THEN 'positive' END, CASE WHEN grade % 2 = 1 THEN 'toxic' END, CASE WHEN doc_id % 10 = 0 THEN 'control' END], lambda x: x IS NOT NULL)) AS reason FROM g),
s AS (SELECT doc_id, bool_or(reason <> 'control') AS required FROM r GROUP BY 1)
SELECT reason, count(*) AS rows, count(*) FILTER (required) AS required, count(*) FILTER (NOT required) AS control_only FROM r JOIN s USING (doc_id) GROUP BY reason
""", "AGG-30")
def selection_reasons(spark, sf_dir):
    """Rows by reason of selection, and whether a row has any reason beyond control."""
    rules = [("positive", F.col("grade") >= 2), ("toxic", F.col("grade") % 2 == 1), ("control", F.col("doc_id") % 10 == 0)]
    d = grades(spark, sf_dir).withColumn("reasons", V.all_failing(rules)).withColumn("required", F.exists("reasons", lambda r: r != "control"))
    d = d.select(F.explode("reasons").alias("reason"), "required")
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("required")).alias("required"), F.count_if(~F.col("required")).alias("control_only"))


@query(f"""
WITH g AS ({GRADES}), a AS (SELECT doc_id, CAST(n_chars % 4 AS INTEGER) AS independent FROM g JOIN documents USING (doc_id) WHERE grade = 2)
SELECT doc_id, 'majority' AS policy, grade FROM g UNION ALL SELECT doc_id, 'independent', coalesce(independent, grade) FROM g LEFT JOIN a USING (doc_id)
""", "MET-6")
def label_policies(spark, sf_dir):
    g = grades(spark, sf_dir)
    a = g.where("grade = 2").join(load(spark, sf_dir, "documents"), "doc_id").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("independent"))
    return D.policies(g, a, ["doc_id"])


@query(f"SELECT doc_id, grade, CASE WHEN grade = 1 THEN 3 ELSE grade END AS final, grade = 1 AS changed FROM ({GRADES})", "JOIN-11")
def human_resolutions(spark, sf_dir):
    g = grades(spark, sf_dir)
    return D.resolved(g, g.where("grade = 1").select("doc_id", F.lit(3).alias("grade")), ["doc_id"]).select("doc_id", "grade", "final", "changed")


@query(f"""
WITH g AS ({GRADES})
SELECT doc_id, CASE WHEN grade = 3 THEN 0 ELSE grade END AS grade, CASE WHEN grade = 3 THEN 'changed' ELSE 'kept' END AS status FROM g UNION ALL SELECT doc_id, 1, 'added' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
""", "JOIN-10")
def label_additions(spark, sf_dir):
    g = grades(spark, sf_dir)
    changes = g.where("grade = 3").select("doc_id", F.col("grade").alias("from"), F.lit(0).alias("to"))
    added = load(spark, sf_dir, "documents").select("doc_id").join(g, "doc_id", "left_anti").withColumn("grade", F.lit(1))
    return D.with_additions(g, changes, added, ["doc_id"])


SOURCES = """WITH a AS (SELECT user_id::VARCHAR AS id, min(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id::VARCHAR AS id, min(event_id) AS seq FROM events WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT o_custkey::VARCHAR AS id, min(o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), u AS (SELECT 0 AS s, 'clicks' AS source, * FROM a UNION ALL SELECT 1, 'purchases', * FROM b UNION ALL SELECT 2, 'orders', * FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, seq) AS n FROM u) """


def sources(spark, sf_dir):
    e, o = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    of = lambda d, i, seq, v: d.select(F.col(i).cast("string").alias("id"), F.col(seq).alias("seq"), F.when(v, "yes").otherwise("no").alias("verdict"))
    return [("clicks", of(e, "user_id", "event_id", F.col("event_type") == "click")), ("purchases", of(e, "user_id", "event_id", F.col("event_type") == "purchase")), ("orders", of(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P"))]


@query(SOURCES + "SELECT id, source FROM r WHERE n = 1 AND s < 2", "SET-7")
def uncertain_targets(spark, sf_dir):
    """Keys of two sources, each with the first source that names it."""
    return D.priority_sources(sources(spark, sf_dir)[:2], "id", "yes").select("id", "source")


@query(SOURCES + "SELECT id, row_number() OVER (ORDER BY s, seq) AS place FROM r WHERE n = 1", "SET-9")
def related_ids(spark, sf_dir):
    """Keys of three sources, one after another, in the order first met."""
    return numbered(D.priority_sources(sources(spark, sf_dir), "id", "yes"), ["order"]).select("id", "place")


@query("""
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'high' WHEN source = 'src3' THEN 'review' ELSE 'unknown' END AS priority, array_to_string(list_filter(['licens', 'rights', 'copy'], lambda t: contains(text, t)), ',') AS related,
       array_to_string(list_filter(['password', 'the'], lambda t: contains(text, t)), ',') AS out_of_scope FROM documents
""", "MAT-10")
def rule_signals(spark, sf_dir):
    t, s = F.col("text"), F.col("source")
    priority = F.when(s.isin("src1", "src2"), "high").when(s == "src3", "review").otherwise("unknown")
    return load(spark, sf_dir, "documents").select("doc_id", priority.alias("priority"), F.array_join(T.found_terms(t, ["licens", "rights", "copy"]), ",").alias("related"), F.array_join(T.found_terms(t, ["password", "the"]), ",").alias("out_of_scope"))


@query("""
WITH e AS (SELECT 'rows' AS field, '500' AS value UNION ALL SELECT 'dimension', '64' UNION ALL SELECT 'metric', 'cosine'),
a AS (SELECT 'rows' AS field, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'dimension', max(len(embedding))::VARCHAR FROM embeddings UNION ALL SELECT 'labels', count(DISTINCT label)::VARCHAR FROM embeddings)
SELECT field, e.value AS expected, a.value AS actual FROM e FULL JOIN a USING (field) WHERE e.value IS DISTINCT FROM a.value
""", "V-5")
def store_mismatches(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.countDistinct("label").alias("labels"))
    actual = e.select(F.explode(F.create_map(*(x for c in e.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("field", "value"))
    return D.mismatches(spark.createDataFrame([("rows", "500"), ("dimension", "64"), ("metric", "cosine")], "field string, value string"), actual)


@query("""
WITH s AS (SELECT role AS tag, text FROM conversations), o AS (SELECT role AS tag, CASE WHEN length(text) % 11 = 0 THEN text || '!' ELSE text END AS text FROM conversations)
SELECT (SELECT count(*) FROM (FROM s EXCEPT ALL FROM o)) AS missing, (SELECT count(*) FROM (FROM o EXCEPT ALL FROM s)) AS extra,
       CASE WHEN (SELECT count(*) FROM (FROM s EXCEPT ALL FROM o)) = 0 AND (SELECT count(*) FROM (FROM o EXCEPT ALL FROM s)) = 0 THEN 'matched' ELSE 'version_mismatch' END AS comparison
""", "V-3")
def source_comparison(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("role").alias("tag"), "text")
    other = c.withColumn("text", F.when(F.length("text") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return D.source_comparison(c, other, F.lit(False))

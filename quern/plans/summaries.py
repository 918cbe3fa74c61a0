"""Generated summaries of orders: Korean text of many lengths with planted faults, as JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import summaries as R
from quern.plans.catalog import query
from quern.tables import load

PHRASE = "임대차 보증금 반환 "


def texts(spark, sf_dir) -> DataFrame:
    """(k, id, body) of each order: its text, unwanted openings and endings, a case number and blanks at times."""
    k = F.col("o_orderkey")
    body = F.concat(F.when(k % 7 == 0, "이 판례는 ").otherwise(""), F.repeat(F.lit(PHRASE), (k % 90 + 3).cast("int")), F.when(k % 11 == 0, F.concat(F.lit("2020다"), k, F.lit(" "))).otherwise(""), F.when(k % 5 == 0, "인정됩니다.").when(k % 5 == 1, "입니다.").otherwise("인정한다."))
    orders = load(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism)  # one small file, much work a row
    return orders.select(k.alias("k"), F.when(k % 6 == 0, k + 1).otherwise(k).cast("string").alias("given"), F.when(k % 13 == 0, "").otherwise(body).alias("body"))


TEXTS = f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 6 = 0 AS other, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CASE WHEN o_orderkey % 7 = 0 THEN '이 판례는 ' ELSE '' END || repeat('{PHRASE}', (o_orderkey % 90 + 3)::INT)
  || CASE WHEN o_orderkey % 11 = 0 THEN '2020다' || o_orderkey || ' ' ELSE '' END || CASE o_orderkey % 5 WHEN 0 THEN '인정됩니다.' WHEN 1 THEN '입니다.' ELSE '인정한다.' END END AS s FROM orders)
"""


@query(TEXTS + """SELECT k, s AS summary, length(s)::INT AS chars, CASE WHEN s = '' THEN 'empty' END AS error, CASE WHEN s = '' THEN '' ELSE concat_ws(',', CASE WHEN other THEN 'id_corrected' END, CASE WHEN k % 7 = 0 THEN 'banned_opening' END,
  CASE WHEN k % 5 < 2 THEN 'polite_style' END, CASE WHEN length(s) < 150 THEN 'too_short' END, CASE WHEN length(s) > 300 THEN 'too_long' END, CASE WHEN length(s) > 230 THEN 'over_recommended' END, CASE WHEN k % 11 = 0 THEN 'has_case_number' END) END AS warnings FROM t
""", "V-18")
def summary_faults(spark, sf_dir):
    t = texts(spark, sf_dir)
    rough = F.concat(F.lit("<p>\t"), F.replace("body", F.lit(" "), F.lit("&nbsp; <br/>")), F.lit("</p >"))
    payload = F.to_json(F.struct(F.when(F.col("k") % 2 == 0, F.col("given")).alias(R.ID_FIELDS[0]), F.col("given").alias(R.ID_FIELDS[1]), rough.alias(R.SUMMARY_FIELD)))
    got = R.summary_check(payload, F.col("k").cast("string"), F.concat(F.lit("2020다"), "k"), F.lit(" "), F.lit(None).cast("string"))
    d = t.select("k", got.alias("c"))
    return d.select("k", "c.summary", "c.chars", "c.error", F.array_join("c.warnings", ",").alias("warnings"))


@query(TEXTS + """SELECT k, concat_ws(',', CASE WHEN other THEN 'precedent_id_mismatch' END, CASE WHEN s = '' THEN 'empty_easy_summary' END, CASE WHEN length(s) > 700 THEN 'too_long:' || length(s) END, CASE WHEN s <> '' AND k % 7 = 0 THEN 'starts_with_this_precedent' END,
  CASE WHEN s <> '' AND k % 5 = 1 THEN 'formal_polite_style' END, CASE WHEN k % 4 > 0 THEN 'explained_difficult_terms_not_list' END) AS errors, CASE WHEN s <> '' AND length(s) < 80 THEN 'review_too_short:' || length(s) ELSE '' END AS warnings FROM t
""", "V-19")
def easy_summary_faults(spark, sf_dir):
    k = F.col("k")
    head = lambda tail: F.concat(F.lit('{"precedent_id":'), "given", F.lit(',"easy_summary":'), F.to_json(F.array("body")).substr(F.lit(2), F.length(F.to_json(F.array("body"))) - 2), F.lit(tail))
    payload = F.when(k % 4 == 0, head(',"explained_difficult_terms":[]}')).when(k % 4 == 1, head(',"explained_difficult_terms":"[x]"}')).when(k % 4 == 2, head(',"explained_difficult_terms":{"a":1}}')).otherwise(head("}"))
    d = texts(spark, sf_dir).select("k", R.easy_summary_check(payload, k.cast("string")).alias("c"))
    return d.select("k", F.array_join("c.errors", ",").alias("errors"), F.array_join("c.warnings", ",").alias("warnings"))

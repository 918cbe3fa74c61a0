"""Which judged rows people look at: all in doubt, a share of the rest by hash order, and a control of each critical query.

A share by hash order is all rows up to a hash, so it needs no sort of the rows: hash_cuts() finds that hash from counts of the
hashes' first digits and the rows of one digit group. (query_id, candidate_id) is a key; rows that repeat it are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relevance from which on a row counts as positive.
POSITIVE = 2
KEY = ["query_id", "candidate_id"]
#: Hex digits by which hashes are counted: at most a million counts a stratum.
DIGITS = 5


def hash_cuts(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """(stratum, cut): the hash of place `quota` among the rows (stratum, h) of each stratum, of the last row if there are fewer.

    `quotas` has (stratum, quota) of a few strata. A stratum with no row or a quota of 0 has no cut.
    """
    d = rows.select("stratum", "h", F.substring("h", 1, DIGITS).alias("_b"))
    counts = d.groupBy("stratum", "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("stratum")
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_b"))).withColumn("_all", F.sum("_c").over(w))
    placed = counts.join(F.broadcast(quotas), "stratum").withColumn("_at", F.least("quota", "_all"))  # a row a stratum
    border = placed.where("_at > _upto - _c and _at <= _upto").select("stratum", "_b", (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_place"))
    near = d.join(F.broadcast(border), ["stratum", "_b"])  # a row a stratum
    return near.withColumn("_n", F.row_number().over(w.orderBy("h"))).where("_n = _place").select("stratum", F.col("h").alias("cut"))


def _cut(rows: DataFrame, among: Column, rate: float) -> DataFrame:
    """One row (cut) for the banker's-rounded share `rate` of the rows where `among` holds; null if that is none."""
    d = rows.where(among).select(F.lit(0).alias("stratum"), "h")
    quota = d.groupBy("stratum").agg(F.bround(F.count(F.lit(1)) * F.lit(rate), 0).cast("long").alias("quota"))
    return hash_cuts(d, quota).agg(F.max("cut").alias("cut"))


def _controls(rows: DataFrame, among: Column, score: Column) -> DataFrame:
    """Keys of each critical query's first positive and first other row by hash, of the rows where `among` holds."""
    critical = rows.where("critical").select("query_id").distinct()
    first = rows.where(among).groupBy("query_id", (score >= POSITIVE).alias("_p")).agg(F.min(F.struct("h", "candidate_id")).alias("_m"))
    return first.join(critical, "query_id").select("query_id", F.col("_m.candidate_id").alias("candidate_id"), F.lit(True).alias("_control"))


def _hashed(rows: DataFrame, seed: str) -> DataFrame:
    if seed:
        return rows.withColumn("h", F.sha2(F.concat_ws("\0", F.lit(seed), *(F.col(k).cast("string") for k in KEY)), 256))
    return rows.withColumn("h", F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in KEY)), 256))


def _reasons(found: dict[str, Column]) -> Column:
    """The names that hold, in alphabetical order."""
    return F.filter(F.array(*(F.when(found[name], F.lit(name)) for name in sorted(found))), F.isnotnull)


def _checked(rate: float) -> None:
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies between 0 and 1")


def team_review(rows: DataFrame, rate: float = 0.1, seed: str = "team-review") -> DataFrame:
    """Of (query_id, candidate_id, human, ai, confidence, critical) those a team reviews, with selection_reasons.

    Scores that differ about being positive; low confidence; of equal scores the share `rate` by hash order; of a critical
    query's equal scores the first positive and the first other one.
    """
    _checked(rate)
    d = _hashed(rows, seed)
    same = F.col("human") == F.col("ai")
    found = {
        "positive_threshold_disagreement": (F.col("human") >= POSITIVE) != (F.col("ai") >= POSITIVE),
        "ai_low_confidence": F.col("confidence") == "low",
        "agreement_random_sample": same & (F.col("h") <= F.col("cut")),
        "critical_query_control_sample": F.col("_control"),
    }
    d = d.join(F.broadcast(_cut(d, same, rate))).join(_controls(d, same, F.col("human")), KEY, "left")  # one row
    return d.withColumn("selection_reasons", _reasons(found)).where(F.size("selection_reasons") > 0).drop("h", "cut", "_control")


def first_judged(rows: DataFrame, rate: float = 0.1, seed: str = "ai-first") -> DataFrame:
    """Of (query_id, candidate_id, seed, ai, confidence, critical) those people judge after a model did, with selection_reasons.

    Low confidence; positive without a seed score; another score than the seed's, and another side of the threshold. Of what is left,
    the share `rate` of the negatives of high confidence by hash order; then a critical query's first positive and first other row.
    """
    _checked(rate)
    d = _hashed(rows, seed)
    positive, sown = F.col("ai") >= POSITIVE, F.col("seed").isNotNull()
    found = {
        "ai_low_confidence": F.col("confidence") == "low",
        "unseeded_ai_positive": ~sown & positive,
        "seed_ai_score_disagreement": sown & (F.col("seed") != F.col("ai")),
        "seed_ai_threshold_disagreement": sown & ((F.col("seed") >= POSITIVE) != positive),
    }
    free = F.size(_reasons(found)) == 0
    calm = free & ~positive & (F.col("confidence") == "high")
    d = d.join(F.broadcast(_cut(d, calm, rate)))  # one row
    found["high_confidence_negative_control"] = calm & F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
    left = free & ~found["high_confidence_negative_control"]
    d = d.join(_controls(d, left, F.col("ai")), KEY, "left")
    found["critical_query_control"] = F.col("_control")
    return d.withColumn("selection_reasons", _reasons(found)).where(F.size("selection_reasons") > 0).drop("h", "cut", "_control")


def calibrated_review(rows: DataFrame, rate: float = 0.05) -> DataFrame:
    """Of (query_id, candidate_id, seed, ai, confidence, second, second_confidence, critical) those people judge, with tier and reasons.

    Required are rows whose two scores, or whose seed and agreed scores, lie on two sides of the threshold, or of low confidence.
    Of the others a control of ceil(n rate): a quarter of each (positive, critical) by hash order, strata in the order below
    taking the rest of the division; what short strata leave is filled from all others by hash order.
    """
    _checked(rate)
    d = _hashed(rows, "")
    yes = lambda c: F.col(c) >= POSITIVE
    split = yes("ai") != yes("second")
    found = {
        "first_second_threshold_disagreement": split,
        "seed_threshold_conflict_with_ai_consensus": ~split & F.col("seed").isNotNull() & (yes("seed") != yes("second")),
        "ai_low_confidence": (F.col("confidence") == "low") | (F.col("second_confidence") == "low"),
    }
    d = d.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in found.items()))))
    d = d.withColumn("stratum", yes("second").cast("int") + 2 * F.col("critical").cast("int"))
    calm = d.where(F.size("reasons") == 0)
    sizes = calm.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))  # four rows at most
    wanted = sizes.agg(F.ceil(F.coalesce(F.sum("_n"), F.lit(0)) * F.lit(rate)).alias("_all"))
    share = sizes.join(F.broadcast(wanted)).withColumn("quota", F.floor(F.col("_all") / 4) + (F.col("stratum") < F.col("_all") % 4).cast("long"))
    quotas = share.select("stratum", "quota")
    short = share.groupBy("_all").agg(F.sum(F.least("quota", "_n")).alias("_got")).select(F.lit(0).alias("stratum"), (F.col("_all") - F.col("_got")).alias("quota"))
    d = d.join(F.broadcast(hash_cuts(calm, quotas)), "stratum", "left")  # a row a stratum
    own = (F.size("reasons") == 0) & F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
    d = d.withColumn("_own", own)
    rest = hash_cuts(d.where((F.size("reasons") == 0) & ~F.col("_own")).select(F.lit(0).alias("stratum"), "h"), short)
    d = d.join(F.broadcast(rest.agg(F.max("cut").alias("_fill"))))  # one row
    control = (F.size("reasons") == 0) & (F.col("_own") | F.coalesce(F.col("h") <= F.col("_fill"), F.lit(False)))
    d = d.withColumn("tier", F.when(F.size("reasons") > 0, "required").when(control, "control"))
    d = d.withColumn("reasons", F.when(F.col("tier") == "control", F.array(F.lit("quality_control_sample"))).otherwise(F.col("reasons")))
    return d.where(F.col("tier").isNotNull()).drop("h", "stratum", "cut", "_own", "_fill")

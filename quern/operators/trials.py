"""Summaries of trials: scored variants and the winners of each scenario, classifiers that fail open, labels that hang on a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.stats import at_index, counted_values

#: The decision that lets a question through, and the texts of predictions that are truth values.
ALLOW, YES, NO = "ALLOW", "true", "false"


def _share(part: Column, whole: Column) -> Column:
    """A ratio to four places, null of nothing."""
    return F.bround(F.when(whole > 0, part / whole), 4)


def checked_scores(scores: DataFrame) -> DataFrame:
    """`scores`, failing the job at a score that is not 1, 2 or 3."""
    good = F.when(F.col("score").isin(1, 2, 3), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a score is 1, 2 or 3: "), F.coalesce(F.col("score").cast("string"), F.lit("none")))).cast("boolean"))
    return scores.where(good)


def variant_summary(scores: DataFrame) -> DataFrame:
    """Of (variant, rank, score) a row a variant: questions (rows of rank 1), chunks, means, and how many and what share score 3, or 2 and more."""
    top = F.col("rank") == 1
    n, best, fair = F.count(F.lit(1)), F.count_if(F.col("score") == 3), F.count_if(F.col("score") >= 2)
    return checked_scores(scores).groupBy("variant").agg(
        F.count_if(top).alias("question_count"),
        n.alias("scored_chunk_count"),
        _share(F.sum("score"), n).alias("mean_score"),
        _share(F.sum(F.when(top, F.col("score"))), F.count_if(top)).alias("mean_top1_score"),
        best.alias("score_3_count"),
        _share(best, n).alias("score_3_rate"),
        fair.alias("score_2_or_3_count"),
        _share(fair, n).alias("score_2_or_3_rate"),
    )


def scenario_winners(scores: DataFrame, variants: list[str]) -> DataFrame:
    """Of (scenario, variant, query_id, score) a row a scenario: each variant's mean, the best one, and who has it, joined by +.

    A variant's mean is that of its question; of several questions the last by id counts. A variant without one has a null mean.
    """
    by_query = checked_scores(scores).groupBy("scenario", "variant", "query_id").agg(_share(F.sum("score"), F.count(F.lit(1))).alias("mean"))
    mean = [F.max_by(F.when(F.col("variant") == v, F.col("mean")), F.when(F.col("variant") == v, F.col("query_id"))).alias(f"mean_{v}") for v in variants]
    d = by_query.groupBy("scenario").agg(*mean)
    best = F.greatest(*(F.col(f"mean_{v}") for v in variants)) if len(variants) > 1 else F.col(f"mean_{variants[0]}")
    winners = F.array_join(F.array(*(F.when(F.col(f"mean_{v}") == best, F.lit(v)) for v in variants)), "+")
    return d.withColumn("best_mean_score", best).withColumn("winner", winners)


def _scoped(attempts: DataFrame) -> DataFrame:
    """Adds what an attempt comes to. Without a prediction a question is let through; only a plain `false` is a block."""
    said, wanted = F.col("prediction"), F.col("expected_in_scope")
    lets = F.coalesce(said.isin(YES, ALLOW), F.lit(True))
    right = F.when(F.col("expected_decision").isNotNull(), said == F.col("expected_decision")).otherwise(said == F.when(wanted, YES).otherwise(NO))
    return attempts.select(
        "*",
        said.isNull().alias("failure"),
        F.coalesce(right, F.lit(False)).alias("right"),
        (lets == wanted).alias("effective"),
        (wanted & F.coalesce(said == NO, F.lit(False))).alias("false_block"),
        (~wanted & lets).alias("false_allow"),
    )


def scope_summary(attempts: DataFrame) -> DataFrame:
    """Of (model, category, case_id, expected_in_scope, expected_decision, prediction) a row a model, and one a category (null: all).

    Accuracy over the attempts that gave a prediction, as given and as let through or not, and over all with failures let through.
    """
    valid = ~F.col("failure")
    n, said, inside = F.count(F.lit(1)), F.count_if(valid), F.count_if("expected_in_scope")
    blocks = F.count_if("false_block")
    got = _scoped(attempts).groupingSets([["model"], ["model", "category"]], "model", "category").agg(
        F.grouping("category").alias("_all"),
        n.alias("total"),
        said.alias("valid_outputs"),
        _share(F.count_if(F.col("right")), said).alias("raw_accuracy"),
        _share(F.count_if(valid & F.col("effective")), said).alias("scope_accuracy"),
        _share(F.count_if("effective"), n).alias("fail_open_accuracy"),
        inside.alias("expected_in_scope_count"),
        blocks.alias("false_block_count"),
        _share(blocks, inside).alias("false_block_rate"),
        F.count_if("false_allow").alias("false_allow_count"),
    )
    return got.withColumn("level", F.when(F.col("_all") == 1, "model").otherwise("category")).drop("_all")


def scope_errors(attempts: DataFrame) -> DataFrame:
    """A row (model, category, case_id, error) for each failure, false block and false allow; an attempt may be two of them."""
    names = ["failure", "false_block", "false_allow"]
    found = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in names)), F.isnotnull)
    return _scoped(attempts).select("model", "category", "case_id", F.explode(found).alias("error"))


def latency_summary(attempts: DataFrame) -> DataFrame:
    """Of (model, latency_ms): mean, median, nearest-rank p95 and maximum to three places, from counts of distinct values."""
    c, n = counted_values(attempts, ["model"], "latency_ms"), F.col("total")
    middle = (at_index(F.floor((n - 1) / 2)) + at_index(F.floor(n / 2))) / 2
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    got = c.groupBy("model").agg(mean.alias("mean"), middle.alias("p50"), at_index(F.ceil(n * F.lit(0.95)) - 1).alias("p95"), F.max("value").alias("max"))
    return got.select("model", *(F.round(x, 3).alias(x) for x in ("mean", "p50", "p95", "max")))


def label_sensitivity(majority: DataFrame, independent: DataFrame, reviewed: DataFrame, on: list[str], positive: int = 2) -> DataFrame:
    """(on, majority, independent, sensitive, unchecked) of rows whose side of the threshold hangs on the label policy, and of
    positives of the majority that no review has looked at. A row that one policy lacks counts as 0 there."""
    a, b = majority.select(*on, F.col("grade").alias("majority")), independent.select(*on, F.col("grade").alias("independent"))
    seen = reviewed.select(*on).distinct().withColumn("_seen", F.lit(True))
    d = a.join(b, on, "full_outer").fillna(0, ["majority", "independent"]).join(seen, on, "left")
    one, other = F.col("majority") >= positive, F.col("independent") >= positive
    d = d.withColumn("sensitive", one != other).withColumn("unchecked", one & F.col("_seen").isNull())
    return d.where("sensitive or unchecked").drop("_seen")


def policy_misses(grades: DataFrame, ranked: DataFrame, models: list[str], positive: int = 2, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of (policy, query_id, id, grade) and (model, query_id, id, rank up to 10) a row a policy, query and model: relevant,
    found in 5, shared_missing (no model has it), own_missing (another has it) and late (rank 6 to 10).

    Grades may be counted by a key of ids that `ranked` has too, as (policy, query_id, key, grade, n). Ranks of all models meet
    in one row, so that hits alone are joined with their grades; what no model has is the rest of what is relevant."""
    per = ranked.where("rank <= 10").groupBy(*dict.fromkeys(["query_id", "id", *key])).agg(*(F.min(F.when(F.col("model") == m, F.col("rank"))).alias(f"_r{k}") for k, m in enumerate(models)))
    good = grades.where(F.col("grade") >= positive)
    n = F.sum("n") if "n" in grades.columns else F.count(F.lit(1))
    relevant = good.groupBy("policy", "query_id").agg(n.alias("relevant"))
    each = lambda name, of: [F.count_if(of(F.col(f"_r{k}"))).alias(f"_{name}{k}") for k in range(len(models))]
    hits = good.select("policy", "query_id", *key).join(per, ["query_id", *key]).groupBy("policy", "query_id").agg(
        F.count(F.lit(1)).alias("_any"), *each("found", lambda r: r <= 5), *each("own", lambda r: r.isNull()), *each("late", lambda r: r >= 6)
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), zero(f"_found{k}").alias("found5"), zero(f"_own{k}").alias("own_missing"), zero(f"_late{k}").alias("late")) for k, m in enumerate(models))))
    d = relevant.join(hits, ["policy", "query_id"], "left").select("policy", "query_id", "relevant", (F.col("relevant") - zero("_any")).alias("shared_missing"), rows.alias("m"))
    return d.select("policy", "query_id", "m.model", "relevant", "m.found5", "shared_missing", "m.own_missing", "m.late")

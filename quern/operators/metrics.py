"""Graded retrieval metrics. Two definitions of ideal gain and precision are in use and stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def ideal_gains(grades: DataFrame, ks: list[int], by: str = "query_id") -> DataFrame:
    """Of (query, grade, n): for each k the gain of the best order, ideal_k; n rows of a grade are never expanded beyond max(ks)."""
    most = max(ks)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = grades.where("n > 0").withColumn("before", before).where(F.col("before") < most)
    last = F.least(F.col("before") + F.col("n"), F.lit(most))
    placed = placed.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, last)))
    return placed.groupBy(by).agg(*(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias(f"ideal_{k}") for k in ks))


def query_metrics(ranked: DataFrame, grades: DataFrame, positive: int = 2, by: str = "query_id") -> DataFrame:
    """recall@5/10, MRR@10, nDCG@10 (ideal over all judged), precision@10 (of returned rows) and hit@10 of each query.

    `ranked` has (query, rank, grade); `grades` counts (query, grade, n) all judged rows. Queries without a positive are left out.
    """
    positives = grades.groupBy(by).agg(F.sum(F.when(F.col("grade") >= positive, F.col("n")).otherwise(0)).alias("positives"))
    hit, rank = F.col("grade") >= positive, F.col("rank")
    got = ranked.where("rank <= 10").groupBy(by).agg(
        F.count_if(hit & (rank <= 5)).alias("hits5"),
        F.count_if(hit).alias("hits10"),
        F.min(F.when(hit, rank)).alias("first"),
        F.sum(gain(F.col("grade"), rank)).alias("dcg"),
        F.count(F.lit(1)).alias("returned"),
    )
    d = got.join(positives, by).join(ideal_gains(grades, [10], by), by).where("positives > 0")
    r = lambda c: F.round(c, 6)
    return d.select(
        by,
        r(F.col("hits5") / F.col("positives")).alias("recall5"),
        r(F.col("hits10") / F.col("positives")).alias("recall10"),
        r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr10"),
        r(F.col("dcg") / F.col("ideal_10")).alias("ndcg10"),
        r(F.col("hits10") / F.col("returned")).alias("precision10"),
        (F.col("hits10") > 0).cast("int").alias("hit10"),
    )


def multi_k_metrics(ranked: DataFrame, grades: DataFrame, ks: list[int], positive: int = 2, by: str = "query_id") -> DataFrame:
    """recall, precision (over k), nDCG (ideal over positives alone) and MRR at each k, as rows (query, k)."""
    positives = grades.groupBy(by).agg(F.sum(F.when(F.col("grade") >= positive, F.col("n")).otherwise(0)).alias("positives"))
    ideal = ideal_gains(grades.where(F.col("grade") >= positive), ks, by)
    hit, rank = F.col("grade") >= positive, F.col("rank")
    each = ranked.groupBy(by).agg(*(x for k in ks for x in (F.count_if(hit & (rank <= k)).alias(f"hits_{k}"), F.sum(F.when(rank <= k, gain(F.col("grade"), rank))).alias(f"dcg_{k}"), F.min(F.when(hit & (rank <= k), rank)).alias(f"first_{k}"))))
    d = each.join(positives, by).join(ideal, by, "left")
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(k).alias("k"),
                    F.round(F.col(f"hits_{k}") / F.greatest(F.col("positives"), F.lit(1)), 6).alias("recall"),
                    F.round(F.col(f"hits_{k}") / k, 6).alias("precision"),
                    F.round(F.coalesce(F.col(f"dcg_{k}") / F.col(f"ideal_{k}"), F.lit(0.0)), 6).alias("ndcg"),
                    F.round(F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)), 6).alias("mrr"),
                )
                for k in ks
            )
        )
    )
    return d.select(by, rows.alias("m")).select(by, "m.*")


def rerank_metrics(scored: DataFrame, ideal: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Of (.., rank, score 1..3) and ideal counts (.., grade, n) of scores: gain 2**(s-1)-1, precision@k of 2+, MRR of 3, mean.

    A grade there is a score less one.
    """
    rank, score = F.col("rank"), F.col("score")
    got = scored.where(rank <= k).groupBy(*by).agg(F.sum(gain(score - 1, rank)).alias("dcg"), (F.count_if(score >= 2) / k).alias("precision"), F.coalesce(F.max(F.when(score == 3, 1 / rank)), F.lit(0.0)).alias("mrr"), F.avg(score).alias("mean"))
    best = ideal_gains(ideal, [k], by[-1])
    return got.join(best, by[-1], "left").select(*by, F.round(F.when(F.col(f"ideal_{k}") > 0, F.col("dcg") / F.col(f"ideal_{k}")).otherwise(0.0), 6).alias("ndcg"), F.round("precision", 6).alias("precision"), F.round("mrr", 6).alias("mrr"), F.round("mean", 6).alias("mean_score"))


def macro(per_query: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each column over queries, to 6 places, and the number of queries."""
    grouped = per_query.groupBy(*by) if by else per_query.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in columns))


def full_hits(ranked: DataFrame, by: str = "query_id", least: int = 10) -> DataFrame:
    """`ranked`, failing the job where a query has fewer than `least` hits."""
    n = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("_hits"))
    good = F.when(F.col("_hits") >= least, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {least} hits: "), F.col(by).cast("string"))).cast("boolean"))
    return ranked.join(n, by).where(good).drop("_hits")


def model_order(per_query: DataFrame, critical: Column) -> DataFrame:
    """A row a model of per-query metrics (model, query_id, ..): incomplete critical queries, macro metrics and place.

    Fewest critical queries with recall@10 below 1, then recall@10, nDCG@10, MRR@10, then name. Models that were not asked the same
    queries fail the job.
    """
    names = ["recall5", "recall10", "mrr10", "ndcg10", "precision10", "hit10"]
    missed = F.count_if(critical & (F.col("recall10") < 1)).alias("incomplete")
    asked = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("query_id")).alias("h")).alias("_asked")
    d = per_query.groupBy("model").agg(missed, asked, *(F.round(F.avg(c), 6).alias(c) for c in names))
    w = Window.orderBy("incomplete", F.desc("recall10"), F.desc("ndcg10"), F.desc("mrr10"), "model")  # a row a model
    same = F.min("_asked").over(Window.partitionBy()) == F.max("_asked").over(Window.partitionBy())
    good = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("models were asked different queries")).cast("boolean"))
    return d.withColumn("_good", good).withColumn("place", F.row_number().over(w)).where("_good").drop("_asked", "_good")


def order_changed(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether two model orders (model, place) under two label policies differ, and both orders."""
    said = lambda d, name: d.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda x: x["model"]).alias(name))  # noqa: E731  a row a model
    return said(one, "one").join(F.broadcast(said(other, "other"))).select((F.col("one") != F.col("other")).alias("changed"), "one", "other")

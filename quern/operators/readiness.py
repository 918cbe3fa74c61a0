"""Whether labels and rankings are sound and complete enough to publish metrics on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAULT = ("fault", "model", "query_id", "id")


def _fault(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one kind of fault; what a kind does not name is null."""
    there = set(rows.columns)
    return rows.select(F.lit(name).alias("fault"), *(F.col(c).cast("string").alias(c) if c in there else F.lit(None).cast("string").alias(c) for c in _FAULT[1:]))


def ranking_faults(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, models: list[str]) -> DataFrame:
    """(fault, model, query_id, id) of rankings (model, query_id, id, rank) of `queries` over `corpus` (id); none where they are sound.

    wrong_ranks: a query's ranks are not 1 to n, each once. repeated_hit: an id twice in a ranking. unknown_hit: an id that the
    corpus lacks. unasked_query: a query that is not in `queries`. missing_query: one that a model does not rank. Null ids,
    queries and ranks are faults too (unknown, unasked, wrong).
    """
    by = ["model", "query_id"]
    rank, n = F.col("rank"), F.count(F.lit(1))
    each = ranked.groupBy(*by).agg(n.alias("n"), F.count_distinct(rank).alias("d"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    sound = (F.col("d") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    asked = queries.select("query_id").distinct()
    has = ranked.groupBy("query_id").agg(F.collect_set("model").alias("has"))  # a name a model
    lacking = F.array_except(F.array(*map(F.lit, models)), F.coalesce("has", F.expr("cast(array() as array<string>)")))
    kinds = {
        "wrong_ranks": each.where(~F.coalesce(sound, F.lit(False))),
        "repeated_hit": ranked.groupBy(*by, "id").agg(n.alias("n")).where("n > 1"),
        "unknown_hit": ranked.join(corpus.select("id").distinct(), "id", "left_anti"),
        "unasked_query": each.join(asked, "query_id", "left_anti"),
        "missing_query": asked.join(has, "query_id", "left").select("query_id", F.explode(lacking).alias("model")),
    }
    return reduce(DataFrame.union, (_fault(d, name) for name, d in kinds.items()))


def label_faults(labels: DataFrame, corpus: DataFrame, positive: int = 2, grades: DataFrame | None = None) -> DataFrame:
    """(fault, model: null, query_id, id) of labels (query_id, id, grade): repeated_label, unknown_label (the corpus lacks it), no_positive.

    Where `grades` has every query's grades (query_id, grade), `labels` need only be those of ids that are repeated or unknown."""
    grades = labels if grades is None else grades
    kinds = {
        "repeated_label": labels.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "unknown_label": labels.join(corpus.select("id").distinct(), "id", "left_anti"),
        "no_positive": grades.groupBy("query_id").agg(F.max("grade").alias("g")).where(F.coalesce(F.col("g") < positive, F.lit(True))),
    }
    return reduce(DataFrame.union, (_fault(d, name) for name, d in kinds.items()))


def required_sound(faults: DataFrame) -> DataFrame:
    """One row (sound: true); reading it fails with the least fault if there is any.

    The check stands on an aggregate, as a filter that raises would be pushed below the joins that find the faults.
    """
    first = faults.agg(F.min(F.concat_ws(" ", *(F.col(c) for c in _FAULT))).alias("first"))
    return first.select(F.when(F.col("first").isNull(), True).otherwise(F.raise_error(F.col("first")).cast("boolean")).alias("sound"))


def ranked_models(ranked: DataFrame) -> DataFrame:
    """A row a model: how many queries it ranks, and which numbers of hits they have, in order."""
    each = ranked.groupBy("model", "query_id").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("model", "n").agg(F.count(F.lit(1)).alias("q"))
    return counts.groupBy("model").agg(F.sum("q").alias("query_count"), F.array_sort(F.collect_set("n")).alias("result_counts"))


def _rows(d: DataFrame) -> Column:
    """How many rows each row stands for."""
    return F.col("n") if "n" in d.columns else F.lit(1)


def readiness(labels: DataFrame, ranked: DataFrame, blockers: DataFrame, positive: int = 2, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row on labels (query_id, id, grade of 0 to 3): questions, judgments, how many of each grade, positives, positives that
    no ranking has, blockers (rows that are not settled), and whether final metrics may be published, which blockers forbid.

    Labels may be counted by a key of ids that `ranked` has too, as (query_id, key, grade, n), and blockers by any, with their n."""
    seen = ranked.select(*dict.fromkeys(["query_id", "id", *key])).distinct().groupBy("query_id", *key).agg(F.count(F.lit(1)).alias("_seen"))
    d = labels.withColumn("_n", _rows(labels).cast("long")).join(seen, ["query_id", *key], "left")
    yes, n = F.col("grade") >= positive, F.col("_n")
    of = lambda c, x=n: F.sum(F.when(c, x).otherwise(0))
    one = d.groupBy("query_id").agg(
        F.sum(n).alias("j"),
        *(of(F.col("grade") == g).alias(f"g{g}") for g in range(4)),
        of(yes).alias("p"),
        of(yes, n - F.coalesce("_seen", F.lit(0))).alias("u"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = one.agg(F.count(F.lit(1)).alias("questions"), total("j").alias("judgments"), *(total(f"g{g}").alias(f"grade_{g}") for g in range(4)), total("p").alias("positives"), total("u").alias("positives_unranked"))
    open_ = blockers.agg(F.coalesce(F.sum(_rows(blockers)), F.lit(0)).cast("long").alias("blockers"))
    return one.join(F.broadcast(open_)).withColumn("final_ready", F.col("blockers") == 0)  # a row each


def merged_hits(hits: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """Every hit (key, query, rank, ..) with what its key comes to: hits, queries that found it, best_rank and first_query (the
    least). Hits without a key are left out; a key may have any number of hits, as none are gathered in one row."""
    d = hits.where(F.col(key).isNotNull())
    facts = d.groupBy(key, query).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r"))
    facts = facts.groupBy(key).agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("queries"), F.min("r").alias("best_rank"), F.min(query).alias("first_query"))
    return d.join(facts, key)

"""Relevance labels from several raters: strict joins, votes, precedence, overrides, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A 1:1 inner join that fails where a key is on one side only or twice on a side."""
    l = left.withColumn("_l", F.count(F.lit(1)).over(Window.partitionBy(*on)))  # noqa: E741
    r = right.withColumn("_r", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    d = l.join(r, on, "full_outer")
    ok = (F.coalesce("_l", F.lit(0)) == 1) & (F.coalesce("_r", F.lit(0)) == 1)
    return d.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the sides do not have the same keys once each")).cast("boolean"))).drop("_l", "_r")


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None, positive: int = 2) -> DataFrame:
    """rows, exact and binary agreement of two graded columns, 6 places; null rates of no rows."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    same = F.avg((F.col(a) == F.col(b)).cast("double"))
    binary = F.avg(((F.col(a) >= positive) == (F.col(b) >= positive)).cast("double"))
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.round(same, 6).alias("exact"), F.round(binary, 6).alias("binary"))


def majority(votes: list[Column]) -> Column:
    """The value that most votes give, if two or more do; of equally many the one that is given first. Nulls are no votes."""
    given = F.filter(F.array(*votes), lambda x: x.isNotNull())
    counts = F.transform(F.array_distinct(given), lambda v: F.struct(F.size(F.filter(given, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.array_max(F.transform(counts, lambda c: c["n"]))
    top = F.filter(counts, lambda c: c["n"] == best)
    return F.when(best >= 2, top[0]["v"])


def binary_majority(votes: list[Column], positive: int = 2) -> Column:
    """Whether more than half of the given votes are positive."""
    given = F.filter(F.array(*votes), lambda x: x.isNotNull())
    return F.size(F.filter(given, lambda x: x >= positive)) * 2 > F.size(given)


def by_precedence(base: DataFrame, on: list[str], sources: list[tuple[str, DataFrame]], value: str = "grade") -> DataFrame:
    """Adds value and label_source: of the first source that has the key; rows of no source have nulls."""
    d = base
    for k, (_, s) in enumerate(sources):
        d = d.join(s.select(*on, F.col(value).alias(f"_v{k}")), on, "left")
    tag = reduce(lambda w, k: w.when(F.col(f"_v{k}").isNotNull(), sources[k][0]), range(len(sources)), F)
    return d.withColumn(value, F.coalesce(*(F.col(f"_v{k}") for k in range(len(sources))))).withColumn("label_source", tag).drop(*(f"_v{k}" for k in range(len(sources))))


def override(base: DataFrame, changes: DataFrame, on: list[str], value: str = "grade") -> DataFrame:
    """Adds the changed value as `final` and whether it differs; a change whose `expected` is not the base's value fails."""
    d = base.join(changes.select(*on, F.col(value).alias("_new"), "expected"), on, "left")
    good = F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col(value))
    final = F.when(good, F.coalesce("_new", value)).otherwise(F.raise_error(F.lit("a change does not start from the label it names")).cast("int"))
    return d.withColumn("final", final).withColumn("changed", F.col("_new").isNotNull() & (F.col("_new") != F.col(value))).drop("_new", "expected")


def confusion(df: DataFrame, truth: Column, decision: Column, by: list[str] | None = None) -> DataFrame:
    """Of a true class and a decision that may be null: coverage and accuracy (0 of none), precision of each side (null of none)."""
    d = df.withColumn("_t", truth).withColumn("_d", decision)
    grouped = d.groupBy(*by) if by else d.groupBy()
    n, made = F.count(F.lit(1)), F.count("_d")
    rate = lambda a, b, none: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), none), 6)
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    right = F.count_if(F.col("_t") == F.col("_d"))
    return grouped.agg(
        n.alias("rows"),
        made.alias("decided"),
        rate(made, n, zero).alias("coverage"),
        rate(right, made, zero).alias("accuracy"),
        rate(F.count_if((F.col("_t") == 1) & (F.col("_d") == 1)), F.count_if(F.col("_d") == 1), none).alias("include_precision"),
        rate(F.count_if((F.col("_t") == 0) & (F.col("_d") == 0)), F.count_if(F.col("_d") == 0), none).alias("exclude_precision"),
    )


def first_by_source(sources: list[DataFrame], on: list[str], order: list[str]) -> DataFrame:
    """The union in which the first source that has a key gives its row, and of that the first in order."""
    tagged = [s.withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    d = reduce(DataFrame.unionByName, tagged)
    w = Window.partitionBy(*on).orderBy("source_no", *order)
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value of each group's last row."""
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))

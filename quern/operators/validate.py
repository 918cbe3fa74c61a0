"""Checks that give rows, and normalisers of outside verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a job over them fails at the first key that occurs twice."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    said = F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("_n")


def links(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(check, failures) of parents (key) and children (key, child): orphans, childless parents, duplicates on both sides."""
    tests = {
        "orphans": children.join(parents, "key", "left_anti"),
        "childless": parents.join(children, "key", "left_anti"),
        "duplicate_parents": duplicates(parents, ["key"]),
        "duplicate_children": duplicates(children, ["key", "child"]),
    }
    out = None
    for name, d in tests.items():
        one = d.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.union(one)
    return out


def first_failing(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; nulls do not hold."""
    out = F
    for name, rule in rules:
        out = out.when(rule, name)
    return out.otherwise(otherwise)


def all_failing(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda x: x.isNotNull())


def choice(raw: Column, allowed: list[str], default: str) -> Column:
    """An allowed word: the text itself, else a part between separators, else, in the list's order, one it contains, else the default."""
    t = F.lower(F.trim(raw))
    parts = F.split(t, r"[/|, ]+")
    exact = F.filter(F.array(*map(F.lit, allowed)), lambda a: (a == t) | F.array_contains(parts, a))
    within = F.filter(F.array(*map(F.lit, allowed)), lambda a: F.contains(t, a))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(within, F.lit(0)), F.lit(default))


def verdicts(raw: DataFrame) -> DataFrame:
    """Columns verdict and confidence as allowed words, needs_review (uncertain or low) and a default reason of exclusion."""
    d = raw.withColumn("verdict", choice(F.col("verdict"), ["unrelated", "related", "uncertain"], "uncertain")).withColumn("confidence", choice(F.col("confidence"), ["high", "medium", "low"], "low"))
    return d.withColumn("needs_review", (F.col("verdict") == "uncertain") | (F.col("confidence") == "low")).withColumn("exclusion", F.when(F.col("verdict") == "unrelated", "outside scope"))

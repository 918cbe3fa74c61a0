"""Deterministic samples: by hash order, by strata, round robin, evenly spaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import numbered, written


def hash_key(seed: str, *parts: str) -> Column:
    """sha256(seed NUL part NUL part ..): an order that does not depend on the rows' order."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *(F.col(p).cast("string") for p in parts)), 256)


def hash_sample(df: DataFrame, rate: float, seed: str, by: list[str], keys: list[str], rounding: str = "half_even") -> DataFrame:
    """Of each group of n rows the round(n rate) (or, rounding up, ceil) that come first in hash order.

    Counts by the hash's first digits say from which on no row can be taken, so that only about a share `rate` of the rows,
    and not whole groups, is sorted.
    """
    d = df.withColumn("_h", hash_key(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 a group
    w = Window.partitionBy(*by)
    size = F.sum("_c").over(w) * F.lit(rate)
    quota = F.bround(size, 0) if rounding == "half_even" else F.ceil(size)
    reach = counts.withColumn("_quota", quota).withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c"))
    last = reach.where("_before < _quota").groupBy(*by).agg(F.max("_b").alias("_last"), F.max("_quota").alias("_quota"))
    same = F.lit(True)
    for k, c in enumerate(by):
        last = last.withColumnRenamed(c, f"_by{k}")
        same = same & d[c].eqNullSafe(F.col(f"_by{k}"))
    near = d.join(last, same & (F.col("_b") <= F.col("_last")))
    near = near.withColumn("sample_rank", F.row_number().over(w.orderBy("_h"))).where("sample_rank <= _quota")
    return near.select(*df.columns, "sample_rank")


def stratified(df: DataFrame, strata: Column, total: int, seed: str, keys: list[str]) -> DataFrame:
    """`total` rows: an equal quota of each stratum by hash order (earlier strata get the rest of the division), then, where
    strata are short, more of the others by hash order. Adds stratum and how the row was taken (quota, refill)."""
    d = df.withColumn("stratum", strata).withColumn("_h", hash_key(seed, *keys))
    names = d.select("stratum").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stratum"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    quota = F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_i") <= F.lit(total) % F.col("_n"), 1).otherwise(0)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy("_h", *keys))).where(F.col("_r") <= total)
    d = d.join(F.broadcast(names.select("stratum", quota.alias("_quota"))), "stratum")  # a row a stratum
    taken = d.where("_r <= _quota").withColumn("taken", F.lit("quota"))
    short = taken.groupBy().agg((F.lit(total) - F.count(F.lit(1))).alias("_left"))
    rest = d.where("_r > _quota").orderBy("_h", *keys).limit(total).withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *keys)))  # at most `total` rows
    more = rest.join(F.broadcast(short)).where("_k <= _left").withColumn("taken", F.lit("refill"))
    return taken.select(*df.columns, "stratum", "taken").union(more.select(*df.columns, "stratum", "taken"))


def round_robin(df: DataFrame, strata: str, total: int, seed: str, keys: list[str]) -> DataFrame:
    """One row of each stratum in turn, strata in order and rows by hash order, until there are `total`; adds round."""
    d = df.withColumn("_h", hash_key(seed, *keys))
    d = d.withColumn("round", F.row_number().over(Window.partitionBy(strata).orderBy("_h"))).where(F.col("round") <= total)
    return d.orderBy("round", strata).limit(total).drop("_h")


def evenly_spaced(df: DataFrame, count: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows round-half-even(i (n - 1) / (count - 1)) of each group in order; the middle one if count is 1."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if count == 1:
        return d.where("_i = floor(_n / 2)").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(count - 1), 0).cast("long"))
    return d.where(F.array_contains(wanted, F.col("_i").cast("long")) | (F.col("_n") <= count)).drop("_i", "_n")


def most_senses_then_spaced(df: DataFrame, senses: str, total: int, length: str, key: str) -> DataFrame:
    """`total` rows of two or more senses: those of three and more, most first, then shortest, then by key; for the rest of the
    sample rows of two senses at places spaced evenly over (length, key).

    Places are numbered in ranges. Too few rows of two senses fail the job.
    """
    order = [F.desc(senses), F.col(length), F.col(key)]
    many = df.where(F.col(senses) >= 3).orderBy(*order).limit(total)
    left = total - many.count()
    if not left:
        return many
    two = df.where(F.col(senses) == 2)
    n = two.count()
    if n < left:
        raise ValueError(f"{left} rows of two senses wanted, {n} there")
    at = [n // 2] if left == 1 else [round(k * (n - 1) / (left - 1)) for k in range(left)]
    spaced = numbered(two, [F.col(length), F.col(key)], "_i").where((F.col("_i") - 1).isin(at)).drop("_i")
    return many.unionByName(spaced)


def required_then_spaced(df: DataFrame, key: str, required: list, total: int, order: list[Column]) -> DataFrame:
    """`total` rows: the required keys that are there, then places spaced evenly over the order, then the first rows that are left.

    Adds step (0 required, 1 spaced, 2 fill). Rows are numbered in ranges; only `total` places and as many first rows are looked at beyond that.
    """
    d = written(numbered(df, order, "_i").withColumn("_i", F.col("_i") - 1), "numbered")
    wanted = d.where(F.col(key).isin(required)).select(key)
    n, asked = df.count(), min(total, wanted.count())
    slots = total - asked
    at = sorted({round(k * (n - 1) / max(slots - 1, 1)) for k in range(slots)}) if n else []
    first = F.when(F.col(key).isin(required), 0).when(F.col("_i").isin(at), 1)
    d = d.withColumn("step", F.coalesce(first, F.lit(2)))
    return d.orderBy("step", "_i").limit(total).drop("_i")


def preferred(df: DataFrame, cell: Column, cells: list[str], total: int, by: str, order: list[str], most_each: int = 2) -> DataFrame:
    """`total` rows: cells give one row in turn, no value of `by` more than `most_each`; then the first rows that are left.

    A row that stands beyond place `total` * `most_each` of its cell and `by` cannot be taken, so no more than the first
    `most_each` of each (cell, by) and `total` of what is left reach the one task that takes turns.
    """
    d = df.withColumn("_cell", cell)
    near = F.row_number().over(Window.partitionBy("_cell", by).orderBy(*order))
    ahead = d.withColumn("_n", near).where(F.col("_n") <= most_each).where(F.col("_cell").isin(cells))
    ahead = ahead.withColumn("_n", F.row_number().over(Window.partitionBy("_cell").orderBy(*order))).where(F.col("_n") <= total * most_each * len(cells)).drop("_n")
    rest = d.orderBy(*order).limit(total)
    columns = df.columns
    both = ahead.withColumn("_first", F.lit(True)).unionByName(rest.withColumn("_first", F.lit(False)))

    def run(frame):
        got = frame.drop_duplicates(subset=[*order, "_first"]).sort_values(order)
        turns = {c: list(g.itertuples()) for c, g in got[got["_first"]].groupby("_cell")}
        taken, used, seen = [], {}, set()
        while len(taken) < total:
            moved = False
            for c in cells:
                queue = turns.get(c, [])
                for k, r in enumerate(queue):
                    if used.get(getattr(r, by), 0) < most_each:
                        taken.append(r.Index)
                        seen.add(tuple(getattr(r, o) for o in order))
                        used[getattr(r, by)] = used.get(getattr(r, by), 0) + 1
                        turns[c] = queue[:k] + queue[k + 1 :]
                        moved = True
                        break
                if len(taken) == total:
                    break
            if not moved:
                break
        for r in got[~got["_first"]].itertuples():
            if len(taken) < total and tuple(getattr(r, o) for o in order) not in seen:
                taken.append(r.Index)
        return got.loc[taken, columns]

    return both.groupBy().applyInPandas(run, df.schema)

"""Order-dependent operators without a task that sees all: numbering, running sums, state maps, greedy cuts.

Rows are dealt out in ranges of their order and written with their block (the range) and their row in it. What a block needs
to know of those before it is one row a block, so only as many rows as there are partitions meet in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.files import scratch

_LOW = (1 << 33) - 1


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the folder that executors share and read it back, so that what follows never computes it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocked(df: DataFrame, order: list) -> DataFrame:
    """`df` in ranges of `order` with _block and _row, which count up along the order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.col("_at")
    return written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_block", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit(_LOW))).drop("_at")


def accumulated(df: DataFrame, order: list, **values: tuple[str, Column]) -> DataFrame:
    """Adds running values along `order`, each row's own included: name=("sum" or "max", value), or ("count", None) for numbers from 1.

    `order` must place every row; of equal ones the running values are in any order. Within a block a window runs, between blocks
    one row each does.
    """
    fold = {"sum": F.sum, "count": F.sum, "max": F.max}
    d = blocked(df.withColumns({f"_v_{k}": F.lit(1) if how == "count" else v for k, (how, v) in values.items()}), order)
    blocks = d.groupBy("_block").agg(*(fold[how](f"_v_{k}").alias(f"_t_{k}") for k, (how, _) in values.items()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = blocks.select("_block", *(fold[how](f"_t_{k}").over(before).alias(f"_c_{k}") for k, (how, _) in values.items()))
    d = d.join(F.broadcast(carried), "_block")
    here = Window.partitionBy("_block").orderBy("_row")
    out = {}
    for k, (how, _) in values.items():
        own = F.col("_row") + 1 if how == "count" else fold[how](f"_v_{k}").over(here)
        out[k] = F.greatest(own, f"_c_{k}") if how == "max" else own + F.coalesce(f"_c_{k}", F.lit(0))
    return d.withColumns(out).drop("_block", "_row", *(f"_{x}_{k}" for k in values for x in "vc"))


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Adds the place of each row along `order`, from 1; no task sorts more than its range."""
    return accumulated(df, order, **{name: ("count", None)})


# ---- states ----


def _prefixes(maps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Composition of each row's map after all before it in its run (rows x states), by doubling."""
    out, run = maps.copy(), np.cumsum(begins)
    step = 1
    while step < len(out):
        same = np.flatnonzero(run[step:] == run[:-step]) + step
        out[same] = np.take_along_axis(out[same], out[same - step].astype(np.int64), 1)
        step *= 2
    return out


def states(df: DataFrame, by: list[str], order: list, action: Column, moves: dict[str, list[int]], begin: int = 0) -> DataFrame:
    """Adds `state`, a machine's state before each row of its key: `moves` has each action's next state of each state; others keep it.

    Each row is a map of states, and maps compose associatively: in a block they are composed from its start, blocks of one key
    are chained by their totals, and each row applies what is before it to the state in which its block is entered. A key with
    all rows is as many tasks as it has blocks. `by` and `order` place every row.
    """
    n = len(next(iter(moves.values())))
    tables = {k: np.array(v, np.uint8) for k, v in moves.items()}
    same = np.arange(n, dtype=np.uint8)
    d = blocked(df.withColumn("_key", F.to_json(F.struct(*by), {"ignoreNullFields": "false"})).withColumn("_action", action), [*by, *order])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        coded = table.column("_key").combine_chunks().dictionary_encode().indices.to_numpy()
        begins = np.r_[True, coded[1:] != coded[:-1]]
        maps = np.stack([tables.get(a, same) for a in table.column("_action").to_pylist()])
        upto = _prefixes(maps, begins)
        before = np.where(begins[:, None], same, np.r_[upto[:1], upto[:-1]])
        last = np.zeros(len(coded), bool)
        last[-1] = True
        add = {"_before": pa.array(list(before.astype(np.int32)), pa.list_(pa.int32())), "_upto": pa.array(list(upto.astype(np.int32)), pa.list_(pa.int32())), "_first": pa.array(coded == coded[0]), "_last": pa.array(last)}
        for k, v in add.items():
            table = table.append_column(k, v)
        return table

    schema = d.schema.simpleString()[7:-1]
    c = written(d.groupBy("_block").applyInArrow(compose, f"{schema},_before:array<int>,_upto:array<int>,_first:boolean,_last:boolean"), "maps")

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        key, state, out = None, begin, []
        for r in rows.sort_values("_block").itertuples():
            entered = state if r.first_key == key else begin
            out.append((r.block, entered))
            key, state = r.key, int(r.upto[entered if r.whole else begin])
        return pd.DataFrame(out, columns=["_block", "_entered"])

    heads = c.where("_first").groupBy("_block").agg(F.min("_key").alias("first_key"))
    ends = c.where("_last").select("_block", F.col("_block").alias("block"), F.col("_key").alias("key"), F.col("_first").alias("whole"), F.col("_upto").alias("upto")).join(heads, "_block")
    entered = ends.groupBy().applyInPandas(chain, "_block long, _entered int")  # a row a block
    d = c.join(F.broadcast(entered), "_block")
    at = F.when(F.col("_first"), F.col("_entered")).otherwise(F.lit(begin))
    return d.withColumn("state", F.element_at("_before", at + 1)).drop("_block", "_row", "_key", "_action", "_before", "_upto", "_first", "_last", "_entered")


# ---- greedy cuts ----


def reached(pointers: DataFrame, bucket: int = 4096) -> DataFrame:
    """Of (at, next), at from 0 and next larger, the places that pointers lead to from 0: `at` of each, its own included.

    Pointers are followed to the end of each bucket of places in the bucket's task. Of what is left, the places where any pointer
    enters a bucket, the reach from 0 is doubled by joins of the pointers with themselves, log(buckets) times; then each bucket
    follows its pointers from the place where it was entered.
    """
    spark = pointers.sparkSession
    p = pointers.select(F.col("at").cast("long"), F.col("next").cast("long"), F.floor(F.col("at") / bucket).cast("long").alias("_bucket"))

    def leave(table: pa.Table) -> pa.Table:
        at, to = (table.column(c).to_numpy() for c in ("at", "next"))
        order = np.argsort(at)
        at, to = at[order], to[order]
        end = at[-1] + 1
        while len(inside := np.flatnonzero(to < end)):
            to[inside] = to[to[inside] - at[0]]
        return pa.table({"at": at, "exit": to})

    jumps = written(p.groupBy("_bucket").applyInArrow(leave, "at long, exit long"), "exits")
    start = spark.range(1).select(F.col("id").alias("at"))
    doors = jumps.select(F.col("exit").alias("at")).union(start).distinct()
    jump = written(jumps.join(doors, "at", "left_semi"), "doors")
    found = start
    while jump.limit(1).count():
        on = jump.select(F.col("at").alias("exit"), F.col("exit").alias("further"))
        found = written(found.union(found.join(jump, "at").select(F.col("exit").alias("at"))).distinct(), "reached")
        jump = written(jump.join(on, "exit").select("at", F.col("further").alias("exit")), "jumps")
    entries = found.groupBy(F.floor(F.col("at") / bucket).cast("long").alias("_bucket")).agg(F.min("at").alias("_entry"))

    def follow(table: pa.Table) -> pa.Table:
        at, to = (table.column(c).to_numpy() for c in ("at", "next"))
        order = np.argsort(at)
        at, to = at[order], to[order]
        out, i = [], int(table.column("_entry")[0].as_py())
        while i <= at[-1]:
            out.append(i)
            i = int(to[i - at[0]])
        return pa.table({"at": pa.array(out, pa.int64())})

    return p.join(entries, "_bucket").groupBy("_bucket").applyInArrow(follow, "at long")


def cut(df: DataFrame, at: str, next_at: str, name: str) -> DataFrame:
    """Adds `name`, the number from 1 of the stretch each row is in, when the next stretch begins at `next_at` of the row that begins one; `at` counts from 0."""
    d = written(df, "pointers")
    begins = reached(d.select(F.col(at).alias("at"), F.col(next_at).alias("next"))).withColumn("_begins", F.lit(1))
    flagged = d.join(begins.withColumnRenamed("at", at), at, "left").withColumn("_begins", F.coalesce("_begins", F.lit(0)))
    return accumulated(flagged, [at], **{name: ("sum", F.col("_begins"))})


def greedy_batches(df: DataFrame, order: list, size: Column, most_items: int, most_total: int) -> DataFrame:
    """Adds `batch`: rows in `order` go into one batch until it has `most_items` rows or the next row would raise its total over `most_total`.

    A row larger than `most_total` fails the job. Where the next batch begins is a rank among running totals, so no array of
    sizes is made.
    """
    checked = F.when(size > most_total, F.raise_error(F.concat(F.lit(f"a row is larger than {most_total}: "), size.cast("string"))).cast("long")).otherwise(size.cast("long"))
    d = written(accumulated(df.withColumn("_size", checked), order, _n=("count", None), _upto=("sum", F.col("_size"))), "totals")
    ends = d.select(F.col("_upto").alias("x"), F.lit(0).alias("kind"), F.col("_n"))
    probes = d.select((F.col("_upto") - F.col("_size") + most_total).alias("x"), F.lit(1).alias("kind"), F.col("_n"))
    ranks = accumulated(ends.union(probes), ["x", "kind", "_n"], _rank=("sum", 1 - F.col("kind"))).where("kind = 1").select("_n", "_rank")
    placed = d.join(ranks, "_n").withColumns({"_at": F.col("_n") - 1, "_next": F.least(F.col("_n") - 1 + most_items, "_rank")})
    return cut(placed, "_at", "_next", "batch").drop("_n", "_upto", "_size", "_rank", "_at", "_next", "_begins")


def greedy_sessions(df: DataFrame, by: str, time: Column, key: str, length: int) -> DataFrame:
    """Adds `session`, from 1 for each value of `by`: one lasts `length` from the row that opens it, the first later row opens the next.

    The row that would open the next session is the rank, among all rows by (by, time), of the time at which this one ends; the
    first row of the next key at the latest, so that one chain of openings runs through all keys.
    """
    d = written(accumulated(df.withColumn("_t", time), [by, "_t", key], _n=("count", None)), "numbers")
    rows = d.select(F.col(by).alias("b"), F.col("_t").alias("x"), F.lit(1).alias("kind"), "_n")
    probes = d.select(F.col(by).alias("b"), (F.col("_t") + length).alias("x"), F.lit(0).alias("kind"), "_n")
    ranks = accumulated(rows.union(probes), ["b", "x", "kind", "_n"], _rank=("sum", F.col("kind"))).where("kind = 0").select("_n", "_rank")
    placed = d.join(ranks, "_n").withColumns({"_at": F.col("_n") - 1, "_next": F.col("_rank")})
    opened = written(cut(placed, "_at", "_next", "_stretch"), "stretches")
    firsts = opened.groupBy(by).agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("_own"))
    base = F.when(F.col("_own"), F.col("_stretch") - 1)
    d = accumulated(opened.join(firsts, "_n", "left"), ["_n"], _base=("max", base))
    return d.withColumn("session", (F.col("_stretch") - F.col("_base")).cast("int")).select(*df.columns, "session")


def evicted(opens: DataFrame, order: list, time: Column, length: int, most: int) -> DataFrame:
    """Of opened sessions (of all keys): ends, when each is over, and evicted, whether the store of `most` open ones ended it early.

    All sessions last `length`, so those open at a time are the last ones opened; the one opened `most` places later ends a
    session if it is still open then. Places are numbered in ranges; a join brings the later opening.
    """
    d = written(numbered(opens.withColumn("_t", time), order, "_place"), "opens")
    later = d.select((F.col("_place") - most).alias("_place"), F.col("_t").alias("_later"))
    early = F.coalesce(F.col("_later") < F.col("_t") + length, F.lit(False))
    return d.join(later, "_place", "left").select(*opens.columns, F.when(early, F.col("_later")).otherwise(F.col("_t") + length).alias("ends"), early.alias("evicted"))


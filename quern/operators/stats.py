"""Summaries: percentiles by three rules, profiles, buckets, duplicates, hashes."""

from __future__ import annotations

import _hashlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.sources.files import scratch


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with their number and the rows before them (n, before, total), so that a percentile needs
    no array of a whole group. Nulls are left out."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return c.withColumn("before", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(w))


def at_index(index: Column) -> Column:
    """The value of a group's rows in order, from 0, at an index; of a counted_values() table in an aggregate."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value")))


def length_summary(df: DataFrame, by: list[str], value: str, rule: str) -> DataFrame:
    """rows, min, max, mean (2 places) and percentiles of each group.

    `rounded`: p50, p90, p95, p99 at round-half-even((n - 1) r). `nearest`: true median, p95 and p99 at ceil(n r) - 1.
    """
    d, n = counted_values(df, by, value), F.col("total")
    if rule == "rounded":
        parts = [at_index(F.bround((n - 1) * F.lit(r), 0)).alias(f"p{r * 100:.0f}") for r in (0.5, 0.9, 0.95, 0.99)]
    else:
        parts = [((at_index(F.floor((n - 1) / 2)) + at_index(F.floor(n / 2))) / 2).alias("median")]
        parts += [at_index(F.floor(n * F.lit(r) + 0.999999) - 1).alias(f"p{r * 100:.0f}") for r in (0.95, 0.99)]
    return d.groupBy(*by).agg(F.sum("n").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 2).alias("mean"), *parts)


def ceil_percentiles(df: DataFrame, by: list[str], value: str, ratios: list[float]) -> DataFrame:
    """The value at max(0, ceil(n r) - 1) of each group, 3 places."""
    d = counted_values(df, by, value)
    return d.groupBy(*by).agg(*(F.round(at_index(F.greatest(F.lit(0), F.ceil(F.col("total") * F.lit(r)) - 1)), 3).alias(f"p{r * 100:.0f}") for r in ratios))


def blank_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, blank, rate): rows whose field is null or only white space, and their share in percent, 2 places. One pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("blank")) for c in columns)))
    return one.select("n", rows.alias("r")).select("r.field", "r.blank", F.round(F.coalesce(F.col("r.blank") * 100 / F.nullif("n", F.lit(0)), F.lit(0.0)), 2).alias("rate"))


def buckets(df: DataFrame, value: str, edges: list[int], closed: str = "right") -> DataFrame:
    """(bucket, rows) between edges, empty ones too; (a, b] if closed right, [a, b) if left; the last has no end."""
    n, low, high = F.col(value), [*edges], [*edges[1:], None]
    k = F
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        ok = (n > a) if closed == "right" else (n >= a)
        if b is not None:
            ok = ok & ((n <= b) if closed == "right" else (n < b))
        k = k.when(ok, i)
    counts = df.select(k.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("rows"))


def duplicate_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """(digest, rows, first key) of texts that occur more than once."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first")).where("rows > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond those of b, as often as they are beyond."""
    return a.exceptAll(b)


def ordered_hash(df: DataFrame, by: list[str], order: list[str], row: Column) -> DataFrame:
    """(.., rows, digest) of each group: SHA-256 over the digests of its rows in order, so that order counts.

    A group's digests (65 bytes a row) meet in one row, for groups that are bounded, such as a document's parts.
    """
    each = F.struct(*order, F.sha2(row, 256).alias("h"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["h"]), "\n"), 256).alias("digest"))


class _Sha256(ctypes.Structure):
    """OpenSSL's SHA256_CTX, which holds no pointers: its bytes are a digest's state, to be taken up elsewhere."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("n", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


def _openssl() -> ctypes.CDLL:
    """The library behind hashlib."""
    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return lib


def _go_on(batches: Iterator[pa.RecordBatch], state: bytes, first: bool) -> Iterator[pa.RecordBatch]:
    """The digest's state after a range of texts, and how many they are."""
    lib, at, n = _openssl(), _Sha256.from_buffer_copy(state), 0
    for batch in batches:
        for t in batch.column(0):
            text = (b"" if first and not n else b"\n") + t.as_py().encode()
            lib.SHA256_Update(ctypes.byref(at), text, len(text))
            n += 1
    yield pa.RecordBatch.from_pydict({"state": [bytes(at)], "n": [n]})


def corpus_digest(df: DataFrame, order: list[str], row: Column) -> tuple[int, str]:
    """(rows, SHA-256) of all rows' text in order, a line feed between.

    A digest over all rows in one order cannot be put together from parts, but it can be taken up: rows are put into ranges, each
    range is hashed by a task of its own from where the one before ended, and the driver hands on a state of 112 bytes. So ranges
    are hashed one after the other, and no task or driver has more than one.
    """
    path = scratch(df.sparkSession, "ranges")
    ranged = df.select(*order, row.alias("_text")).repartitionByRange(*order)
    ranged.withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    d = df.sparkSession.read.schema(StructType([*ranged.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    lib, at, n = _openssl(), _Sha256(), 0
    lib.SHA256_Init(ctypes.byref(at))
    for part in sorted(r[0] for r in d.select("_part").distinct().collect()):
        state, first = bytes(at), n == 0
        one = d.where(F.col("_part") == part).coalesce(1).sortWithinPartitions(*order).select("_text")
        got = one.mapInArrow(lambda it, state=state, first=first: _go_on(it, state, first), "state binary, n long").first()
        at, n = _Sha256.from_buffer_copy(bytes(got.state)), n + got.n
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctypes.byref(at))
    return n, out.raw.hex()


def batches(sizes: Column, most_items: int, most_total: int) -> Column:
    """The batch (from 0) of each of an array of sizes, filled greedily in order up to a number of items and a total."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, x):
        full = (acc["items"] > 0) & ((acc["items"] >= most_items) | (acc["total"] + x > most_total))
        b = F.when(full, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(b.alias("b"), F.when(full, F.lit(1)).otherwise(acc["items"] + 1).cast("long").alias("items"), F.when(full, x).otherwise(acc["total"] + x).cast("long").alias("total"), F.array_append(acc["out"], b).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])

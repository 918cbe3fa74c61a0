"""What the operators of this subpackage share: work tables, connected components, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache holds at most before it starts anew (about 200 bytes each).
CACHE_WORDS = 300_000
#: Groups of more rows than this share of a table, and of HOT_LEAST rows, are joined in their rows' own tasks.
HOT_SHARE, HOT_LEAST = 500, 500


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and all run in this process, one of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quern-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder; a session that has ended has nothing to remove with."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def work_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: what follows never recomputes it, whatever executor is lost."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def bucketed_table(spark: SparkSession, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """work_table() with rows bucketed by `key`: joins by it move the other side alone."""
    path = fresh_path(spark, name)
    table = "quern_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out._quern_path = path
    return out


def drop_table(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more.

    The plans that read them hold tables they were sent on the driver until both of its sides collect their garbage.
    """
    for df in tables:
        drop(spark, df._quern_path)
    give_back()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[str, Callable[[], None]] = {}
_USER: list[str] = [""]


def holds(user: str, clear: Callable[[], None]) -> None:
    """`clear` empties what a worker keeps between tasks for `user`."""
    _HELD[user] = clear


def working(user: str) -> None:
    """Called first in a task: what other users left in this worker is dropped, and its memory given back."""
    if _USER[0] == user:
        return
    for name, clear in _HELD.items():
        if name != user:
            clear()
    _USER[0] = user
    give_back()


def give_back() -> None:
    """Collect this process's garbage and give free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call outside glibc
        return


class Cache(dict):
    """word -> value, filled by `make`; starts anew when full, so that memory stays bounded."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def docs_of(batch, most_chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of an Arrow batch of (id, text), null texts as empty, in runs of bounded characters."""
    ids, texts, chars = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(i)
        texts.append(t or "")
        chars += len(texts[-1])
        if chars >= most_chars:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def text_runs(batch: pa.RecordBatch, at: int = 0, most_bytes: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a batch's column, null texts as empty, in runs of bounded size: at least one text each."""
    texts = batch.column(at).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = int(ends[row - 1]) if row else 0
        after = max(row + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield row, texts.slice(row, after - row)
        row = after


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    r"""The words `[^\x20\x09-\x0D]+` of all texts one after another, A-Z lower-cased if asked, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, own = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "")
    words, own = words.filter(full), own[full.to_numpy(zero_copy_only=False)]
    return words, np.bincount(own, minlength=len(texts))


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, each distinct one hashed once."""
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """hash_words() of split_words(), and how many each text has."""
    words, sizes = split_words(texts, lower)
    return hash_words(words), sizes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k word hashes, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * _ODD + words[j : j + n])
    return out


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `groups` (one row for each value of `keys`; `size` counts its rows), no task getting a large group.

    Groups of more than total / HOT_SHARE rows, of which there are HOT_SHARE at most, are sent to all tasks and meet their
    rows where these are; the others meet by a shuffle. `how`: inner, left or left_semi. Null keys meet nothing.
    """
    most = max(HOT_LEAST, total // HOT_SHARE)
    own, wanted = rows.columns, keys if how == "left_semi" else groups.columns
    large = groups.where(F.col(size) > most).select(*wanted)
    found = large.collect()  # at most HOT_SHARE rows, as sizes add up to `total`
    rest = groups.select(*wanted).hint("merge")
    if not found:
        return rows.join(rest, keys, how)
    told = rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, large.schema).withColumn("_met", F.lit(True))), keys, "left")
    others = told.where("_met is null").select(*own).join(rest, keys, how)
    return told.where("_met").select(*own, *(c for c in others.columns if c not in own)).unionByName(others)


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (a, b), component being the smallest node that links reach.

    Alternating large-star and small-star rounds; each round is a written table in the shared folder and only counts
    come to the driver. A node with a large share of the links meets them in their own tasks. The rounds end when one
    changes no link. Nulls and loops are left out; an empty table gives an empty one.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).withColumn("m", F.least("u", "m"))

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return by_group(both, least(both), ["u"], "links", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame, n: int) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(down)
        met = by_group(down, low, ["u"], "links", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return met.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    now = work_table(spark, edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").distinct(), "cc")
    n = now.count()
    for _ in range(most_rounds):
        after = work_table(spark, small(large(now, n).where("u <> v").distinct(), n), "cc")
        n_after = after.count()
        done = n_after == n and not after.join(now, ["u", "v"], "left_anti").limit(1).count()
        drop_table(spark, now)
        now, n = after, n_after
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._quern_path = now._quern_path
    return out

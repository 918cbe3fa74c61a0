"""Exact duplicate removal by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import by_group, prepare, work_table

#: Rows of some 24 bytes that are sent to all tasks at most; more meet their texts by a shuffle.
MOST_TOLD = 200_000


def normalised(text: Column) -> Column:
    r"""Each `[\x20\x09-\x0D]+` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]{2,}|[\t-\r]", " ")


def _shape(text: Column, prefix_chars: int) -> list[Column]:
    """What the first pass takes of a normalised text: its length and a hash of its first characters."""
    return [F.length(text).alias("n"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("ph")]


def _partnered(keys: DataFrame, total: int) -> DataFrame:
    """The rows of `keys` that share their length, and of these the ones that share length and prefix, with another."""
    one = F.count(F.lit(1)).alias("c")
    lengths = keys.groupBy("n").agg(one).where("c > 1")
    prefixes = keys.groupBy("n", "ph").agg(one).where("c > 1")
    prefixes = by_group(prefixes, lengths, ["n"], "c", total, "left_semi")
    return by_group(keys, prefixes, ["n", "ph"], "c", total, "left_semi")


def _told(rows: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks if it has MOST_TOLD rows at most."""
    return F.broadcast(rows) if rows.count() <= MOST_TOLD else rows


def _survivors(base: DataFrame, keys: DataFrame, total: int, prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, n0, ph0) of the rows that lengths and prefixes leave, and these rows with content and sha of their whole texts.

    A row is found again by id, length and prefix, which do not need the text's end; rows that share all three are all read.
    """
    spark = base.sparkSession
    some = work_table(spark, _partnered(keys, total).select(F.col("doc_id").alias("id"), F.col("n").alias("n0"), F.col("ph").alias("ph0")).distinct(), "exact-some")
    met = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n") == F.col("n0")) & (F.col("ph") == F.col("ph0"))
    again = base.select("doc_id", "t", *_shape(F.col("t"), prefix_chars)).join(_told(some), met, "left_semi")
    left = again.select("doc_id", "n", "ph", F.xxhash64("t").alias("content"), F.unhex(F.sha2(F.col("t"), 256)).alias("sha"))
    return some, work_table(spark, left, "exact-left")


def _same(left: DataFrame) -> DataFrame:
    """Of rows with sha a row for each digest that occurs more than once: the smallest id and the number of rows."""
    return left.groupBy("sha").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and `content`, a 64-bit hash of the text.

    Rows are grouped by length of the normalised text; lengths that occur once are done. The others are grouped by length
    and a hash of the first `prefix_chars` characters; what still has a partner is compared by the SHA-256 of the whole text.
    All grouping is on narrow rows, aggregated before it is shuffled, and groups with a large share of the rows meet their
    rows in these rows' own tasks. With `digest_all` the digest, a result column, is made for each row in the only pass over
    the content, and the refinement only narrows what is grouped by it; without, the first pass takes lengths and prefixes
    alone, whole texts are hashed for surviving rows alone, and text_sha256 and content are null elsewhere.

    A null text counts as empty; empty texts equal each other. A null id is a row of its own in the group: it never becomes
    keep_id unless all ids of the group are null, and kept is then false. Rows that repeat an id are separate rows (both kept
    where that id stays). Other columns are not read. An empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    whole = [F.xxhash64("t").alias("content"), F.unhex(F.sha2(F.col("t"), 256)).alias("sha")] if digest_all else []
    keys = work_table(spark, base.select("doc_id", *_shape(F.col("t"), prefix_chars), *whole), "exact-keys")
    total = keys.count()
    if digest_all:
        out = by_group(keys.select("doc_id", "content", "sha"), _same(_partnered(keys, total)), ["sha"], "c", total, "left")
    else:
        some, left = _survivors(base, keys, total, prefix_chars)
        done = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n") == F.col("n0")) & (F.col("ph") == F.col("ph0"))
        rest = keys.join(some, done, "left_anti").select("doc_id")
        out = by_group(left, _same(left), ["sha"], "c", total, "left").unionByName(rest, allowMissingColumns=True)
    keep = F.coalesce("keep", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("c", F.lit(1)).cast("long").alias("group_size"), F.coalesce(keep == F.col("doc_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "content")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """The rows of `docs`, all columns, without those whose text another row with a smaller id has.

    Whole texts are hashed for rows alone whose length and prefix another row shares, and once more for those whose id, length
    and prefix a dropped row has. Rows are told apart by id and content, so rows that share an id and no text are judged each
    by its own text; rows that share both stay or go together. Null texts count as empty. Rows with a null id stay. An empty
    table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    keys = work_table(spark, base.select("doc_id", *_shape(F.col("t"), prefix_chars)), "exact-keys")
    total = keys.count()
    _, left = _survivors(base, keys, total, prefix_chars)
    judged = by_group(left, _same(left), ["sha"], "c", total, "left")
    gone = work_table(spark, judged.where("doc_id <> keep").select("doc_id", "n", "ph", "content").distinct(), "exact-gone")
    t = normalised(docs[text_col])
    n, ph = _shape(t, prefix_chars)
    alike = (docs[id_col] == gone["doc_id"]) & (n == gone["n"]) & (ph == gone["ph"])
    same = F.xxhash64(t).bitwiseXOR(gone["content"]) == 0  # no join key, so that it is looked at where the rest meets only
    return docs.join(_told(gone), alike & same, "left_anti").select(*(docs[c] for c in docs.columns))
